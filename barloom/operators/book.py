"""Order-book snapshots: top of book, depth, and independent sweeps.

Resting orders are `instrument, id, side, price, quantity, ts` with side `buy` or
`sell`; `ts, id` give arrival order. A hot instrument's orders are first summed
per price level, so what remains per instrument is its number of levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.lookup import last_step, running
from barloom.operators.positions import KEY
from barloom.session import materialized

BUY, SELL = "buy", "sell"
FULL = 1e-12


def top_of_book(orders: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Best prices, mid (NULL if a side is empty), spread (then 0), order counts."""
    buy, sell = F.col("side") == BUY, F.col("side") == SELL
    best = orders.groupBy(*keys).agg(
        F.max(F.when(buy, F.col("price"))).alias("best_bid"),
        F.min(F.when(sell, F.col("price"))).alias("best_ask"),
        F.count_if(buy).alias("bid_orders"),
        F.count_if(sell).alias("ask_orders"),
    )
    bid, ask = F.col("best_bid"), F.col("best_ask")
    return best.withColumn("mid_price", (bid + ask) / 2.0).withColumn(
        "spread", F.coalesce(ask - bid, F.lit(0.0))
    )


def price_levels(orders: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Total quantity and orders per side and price."""
    return orders.groupBy(*keys, "side", "price").agg(
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("orders")
    )


def depth_at(orders: DataFrame, probes: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Bid and ask quantity resting exactly at each probed `(instrument, price)`."""
    levels = price_levels(orders, keys)
    at = levels.groupBy(*keys, "price").agg(
        F.coalesce(F.sum(F.when(F.col("side") == BUY, F.col("quantity"))), F.lit(0.0)).alias("bid"),
        F.coalesce(F.sum(F.when(F.col("side") == SELL, F.col("quantity"))), F.lit(0.0)).alias("ask"),
    )
    return (
        probes.join(at, [*keys, "price"], "left")
        .withColumn("bid_depth", F.coalesce("bid", F.lit(0.0)))
        .withColumn("ask_depth", F.coalesce("ask", F.lit(0.0)))
        .drop("bid", "ask")
    )


def depth_within(orders: DataFrame, levels: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Quantity on the best `levels` price levels of each side.

    Ranking stops at `levels` rows per key before the shuffle.
    """
    distance = F.when(F.col("side") == BUY, -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy("_distance")
    near = (
        price_levels(orders, keys)
        .withColumn("_distance", distance)
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= levels)
    )
    return near.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("side") == BUY, F.col("quantity"))), F.lit(0.0)).alias("bid_depth"),
        F.coalesce(F.sum(F.when(F.col("side") == SELL, F.col("quantity"))), F.lit(0.0)).alias("ask_depth"),
    )


def _opposite() -> Column:
    return F.when(F.col("side") == BUY, SELL).otherwise(BUY)


def _queue_and_reach(orders: DataFrame, requests: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Orders in priority, and requests with what they fill.

    Each order gets `ahead` and `notional_ahead`: quantity and value of its side before it, and
    `distance`, its price as a cost to the taker. A request's `reach` is the quantity it fills,
    from what it wants and what rests on the other side within its limit. Limits are sorted in
    behind the orders of their price, so the same sums tell both.
    """
    side = [*keys, "side"]
    distance = F.when(F.col("side") == BUY, -F.col("price")).otherwise(F.col("price"))
    rows = orders.withColumns({"distance": distance, "_limit": F.lit(0)})
    limited = "limit_price" in requests.columns
    if limited:
        # A buyer accepts prices up to the limit, a seller down to it.
        cost = F.when(F.col("side") == BUY, F.col("limit_price")).otherwise(-F.col("limit_price"))
        requests = requests.withColumn("distance", cost)
        limits = requests.where(F.col("distance").isNotNull()).select(*keys, _opposite().alias("side"), "distance", F.lit(1).alias("_limit"))
        rows = rows.unionByName(limits.distinct(), allowMissingColumns=True)
    sums = {"ahead": F.coalesce("quantity", F.lit(0.0)), "notional_ahead": F.coalesce(F.col("quantity") * F.col("price"), F.lit(0.0))}
    placed = materialized(running(rows, side, ["distance", "_limit", "ts", "id"], sums))
    queue = placed.where("_limit = 0").drop("_limit")
    total = queue.groupBy(*keys, _opposite().alias("side")).agg(F.max(F.col("ahead") + F.col("quantity")).alias("_total"))
    wanted = requests.join(total, side, "left")
    reach = F.least(F.col("quantity"), F.coalesce("_total", F.lit(0.0)))
    if not limited:
        return queue, wanted.withColumn("reach", reach).drop("_total")
    within = placed.where("_limit = 1").select(*keys, _opposite().alias("side"), "distance", F.col("ahead").alias("_within"))
    capped = F.least(reach, F.coalesce("_within", F.lit(0.0)))
    return queue, (
        wanted.join(within, [*side, "distance"], "left")
        .withColumn("reach", F.when(F.col("distance").isNull(), reach).otherwise(capped))
        .drop("_total", "_within", "distance")
    )


def sweep(orders: DataFrame, requests: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Fills of each request against the unchanged snapshot.

    Requests are `instrument, request_id, side, quantity[, limit_price]`. A request
    takes the opposite side by price, then arrival, within its limit; it fills the
    orders whose `ahead` lies below its reach. The join cuts `ahead` into cells of
    the mean reach: a request enters about two cells, all orders of all but its
    last cell are fills, and no others are paired. What rounding leaves of a sum of
    quantities, up to `FULL`, is no fill.
    """
    side = [*keys, "side"]
    queue, wanted = _queue_and_reach(orders, requests, keys)
    wanted = materialized(wanted.where(F.col("reach") > 0).select(*side, "request_id", "reach"))
    width = wanted.groupBy(*side).agg(F.avg("reach").alias("_width"))
    cells = (
        wanted.join(width, side)
        .withColumn("_last", F.floor(F.col("reach") / F.col("_width")))
        .select(*side, "request_id", "reach", F.explode(F.sequence(F.lit(0), "_last")).alias("_cell"))
    )
    resting = (
        queue.select(
            *keys,
            _opposite().alias("side"),
            F.col("id").alias("order_id"),
            F.col("price").alias("fill_price"),
            F.col("quantity").alias("_resting"),
            "ahead",
        )
        .join(width, side)
        .withColumn("_cell", F.floor(F.col("ahead") / F.col("_width")))
        .drop("_width")
    )
    fill = F.least(F.col("_resting"), F.col("reach") - F.col("ahead"))
    return (
        cells.join(resting, [*side, "_cell"])
        .select(*side, "request_id", "order_id", "fill_price", fill.alias("fill_quantity"))
        .where(F.col("fill_quantity") > FULL)
    )


def execution_report(
    orders: DataFrame,
    requests: DataFrame,
    latency: int = 0,
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """Filled and remaining quantity, average price, slippage against the mid.

    No fills are listed for this: the value of a fill is the value ahead of the
    last order it reaches plus the part taken from that order.
    """
    side = [*keys, "side"]
    queue, reached = _queue_and_reach(orders, requests, keys)
    steps = queue.select(
        *keys,
        _opposite().alias("side"),
        F.col("ahead").alias("reach"),
        F.col("ahead").alias("_from"),
        F.col("notional_ahead").alias("_value"),
        F.col("price").alias("_price"),
    )
    probes = reached.where(F.col("reach") > 0).select(*side, "reach").distinct()
    last = last_step(steps, probes, side, "reach", ["_from", "_value", "_price"], True)
    mids = top_of_book(orders, keys).select(*keys, "mid_price")
    zero = F.lit(0.0)
    notional = F.col("_value") + (F.col("reach") - F.col("_from")) * F.col("_price")
    direction = F.when(F.col("side") == BUY, 1.0).otherwise(-1.0)
    known = F.col("mid_price").isNotNull() & (F.col("reach") > 0)
    average = F.coalesce(ratio(notional, "reach"), zero)
    return (
        reached.join(last, [*side, "reach"], "left")
        .join(mids, list(keys), "left")
        .withColumn("average_price", average)
        .withColumn("remaining_quantity", F.col("quantity") - F.col("reach"))
        .select(
            *keys,
            "request_id",
            "side",
            F.col("reach").alias("filled_quantity"),
            "remaining_quantity",
            "average_price",
            F.when(known, direction * (F.col("average_price") - F.col("mid_price")))
            .otherwise(zero)
            .alias("slippage"),
            (F.col("submit_time") + latency).alias("execution_time"),
            (F.col("remaining_quantity") <= FULL).alias("fully_filled"),
        )
    )
