"""The 34 look-back features and the forward targets.

Frames end at the current row. `pos` orders the rows of a slice; `part` is either
(instrument, chunk) with a halo, or (instrument, fold) for a slice that restarts.
Every window below has the same partition and a sort that the others share, so
one shuffle and one sort serve them all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.operators.positions import CHUNK_ROWS, KEY, core_only, with_halo

LAGS = (5, 10, 20, 50)
VOLS = (10, 20, 50)
SPANS = (10, 30)
DEFAULT_HORIZONS = (1, 5, 10, 20)

# Exponential sums restart every BLOCK rows and take over the block before. What
# lies further back weighs less than (29/31)^1024, about 1e-30, of the total.
BLOCK = 1_024

PRICE = (
    ["log_return_1"]
    + [f"{kind}_{n}" for n in LAGS for kind in ("return", "momentum")]
    + ["zscore_20", "zscore_50", "dist_from_ma_20"]
)
VOLATILITY = (
    [f"realized_vol_{n}" for n in VOLS]
    + [f"ewma_vol_{n}" for n in SPANS]
    + ["vol_ratio_10_50", "vol_change_10", "parkinson_vol_20"]
)
VOLUME = ["volume_change_5", "volume_zscore_20", "volume_norm_return", "activity_intensity_10"]
RANGE = ["close_loc_in_range", "bar_range_pct", "range_zscore_20"]
CLOCK = [
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "session_london",
    "session_ny",
    "session_tokyo",
]
FEATURES = PRICE + VOLATILITY + VOLUME + RANGE + CLOCK


def target_column(horizon: int, kind: str = "return") -> str:
    return f"future_{kind}_{horizon}"


def is_target(name: str) -> bool:
    return name.startswith("future_")


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that are neither keys, bar fields nor forward targets."""
    return [c for c in df.columns if c in set(FEATURES) and not is_target(c)]


CLOCK_SQL = {
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)",
    "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    "dow_sin": "sin(2 * pi() * weekday(ts) / 7)",
    "dow_cos": "cos(2 * pi() * weekday(ts) / 7)",
    # Session hours in UTC, end exclusive.
    "session_london": "cast(hour(ts) >= 7 AND hour(ts) < 16 AS int)",
    "session_ny": "cast(hour(ts) >= 12 AND hour(ts) < 21 AS int)",
    "session_tokyo": "cast(hour(ts) < 9 AS int)",
}

# Which frames (aggregate, column, rows) each rolling feature is made of. Deviations are
# Spark's, which starts every frame afresh: what has left a frame leaves no rounding behind.
FRAMES = {
    "zscore_20": [("avg", "close", 20), ("stddev_samp", "close", 20)],
    "zscore_50": [("avg", "close", 50), ("stddev_samp", "close", 50)],
    "dist_from_ma_20": [("avg", "close", 20)],
    **{f"realized_vol_{n}": [("stddev_samp", "log_return_1", n)] for n in VOLS},
    "parkinson_vol_20": [("avg", "_hl2", 20)],
    "volume_zscore_20": [("avg", "volume", 20), ("stddev_samp", "volume", 20)],
    "volume_norm_return": [("avg", "volume", 20)],
    "activity_intensity_10": [("avg", "volume", 10), ("avg", "volume", 50)],
    "range_zscore_20": [("count", "_rng", 20), ("avg", "_rng", 20), ("stddev_samp", "_rng", 20)],
}

# Features made of other features.
BUILT_ON = {
    "vol_ratio_10_50": ["realized_vol_10", "realized_vol_50"],
    "vol_change_10": ["realized_vol_10"],
}


def _ewma_terms(span: int) -> dict[str, str]:
    up = f"(CASE WHEN log_return_1 IS NOT NULL THEN 1 / _d{span} END)"
    return {
        f"e{span}_w": up,
        f"e{span}_s": f"{up} * {up}",
        f"e{span}_x": f"{up} * log_return_1",
        f"e{span}_q": f"{up} * log_return_1 * log_return_1",
    }


def _ewma_sums(span: int) -> dict[str, str]:
    """Decayed sums up to this row: the block so far plus the block before."""
    decay = 1.0 - 2.0 / (span + 1.0)
    here, carry = f"_d{span}", f"(_d{span} * {decay**BLOCK!r}D)"
    out = {}
    for k in "wsxq":
        power = (f"{here} * {here}", f"{carry} * {carry}") if k == "s" else (here, carry)
        out[f"_ew{span}_{k}"] = f"_e{span}_{k} * {power[0]} + _q_e{span}_{k} * {power[1]}"
    return out


def _ewma_deviation(span: int) -> str:
    """Bias-corrected deviation; one observation leaves only noise below the line."""
    w, s, x, q = (f"_ew{span}_{k}" for k in "wsxq")
    biased = f"greatest(try_divide({q}, {w}) - pow(try_divide({x}, {w}), 2), 0D)"
    spread = f"(CASE WHEN {w} * {w} - {s} > {w} * {w} * 1e-12 THEN {w} * {w} - {s} END)"
    return f"sqrt({biased} * {w} * {w} / {spread})"


def add_features(
    bars: DataFrame, part: Sequence[str], horizons: Sequence[int] = (), keep: Sequence[str] | None = None
) -> DataFrame:
    """Widen `ts, pos, open..volume` rows by the features in `keep` and by targets.

    Bars must be normalized: positive prices, high >= low, no NULLs.

    All rolling features come from three sliding frames, of 10, 20 and 50 rows, whose
    aggregates are updated together; they cost 80 updates per row. Exponential sums reach
    back without end, so they are running sums, which restart every BLOCK rows.
    """
    # A feature that does not exist is left out, and signals that need it are skipped.
    names = [f for f in (FEATURES if keep is None else keep) if f in set(FEATURES)]
    wanted = set(names) | {d for f in names for d in BUILT_ON.get(f, [])}
    spans = [n for n in SPANS if f"ewma_vol_{n}" in wanted]
    frames = sorted({frame for f in wanted for frame in FRAMES.get(f, [])}, key=lambda f: (f[2], f))
    terms: dict[str, str] = {}
    for span in spans:
        terms |= _ewma_terms(span)

    keys = ", ".join(part)
    w = f"(PARTITION BY {keys} ORDER BY _blk, pos)"
    running = f"PARTITION BY {keys}, _blk ORDER BY pos ROWS UNBOUNDED PRECEDING"
    by_block = f"PARTITION BY {keys} ORDER BY _blk"

    def add(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        return df.selectExpr("*", *[f"{e} AS {n}" for n, e in columns.items()]) if columns else df

    df = add(
        bars,
        {
            "_blk": f"pos DIV {BLOCK}",
            "_j": f"pos % {BLOCK}",
            "_lc": "ln(close)",
            "_rng": "nullif(high - low, 0D)",
            "_hl2": "ln(high / low) * ln(high / low)",
        },
    )

    # Differences against single earlier or later rows.
    def lagged(x: str, n: int) -> str:
        return f"lag({x}, {n}) OVER {w}"

    single = {"_row": f"row_number() OVER {w}", "log_return_1": f"_lc - {lagged('_lc', 1)}"}
    for n in LAGS:
        single[f"return_{n}"] = f"try_divide(close, {lagged('close', n)}) - 1"
        single[f"momentum_{n}"] = f"_lc - {lagged('_lc', n)}"
    single["volume_change_5"] = f"try_divide(volume, {lagged('volume', 5)}) - 1"
    if "volume_norm_return" in wanted:
        single["_ret1"] = f"try_divide(close, {lagged('close', 1)}) - 1"
    helpers = {"_row", "_ret1", "log_return_1"}
    single = {k: e for k, e in single.items() if k in wanted | helpers}
    for h in horizons:
        single[target_column(h)] = f"lead(_lc, {h}) OVER {w} - _lc"
    df = add(df, single)

    def frame(fn: str, x: str, n: int) -> str:
        return f"{fn}({x}) OVER (PARTITION BY {keys} ORDER BY _blk, pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    df = add(df, {f"_{fn}_{x}_{n}": frame(fn, x, n) for fn, x, n in frames})
    df = add(df, {f"_d{n}": f"pow({1.0 - 2.0 / (n + 1.0)!r}D, _j)" for n in spans})
    df = add(df, {f"_t_{k}": e for k, e in terms.items()})
    df = add(df, {f"_{k}": f"coalesce(sum(_t_{k}) OVER ({running}), 0D)" for k in terms})
    previous = f"{by_block} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING"
    df = add(df, {f"_q_{k}": f"coalesce(sum(_t_{k}) OVER ({previous}), 0D)" for k in terms})
    sums: dict[str, str] = {}
    for span in spans:
        sums |= _ewma_sums(span)
    df = add(df, sums)

    def once(rows: int, e: str) -> str:
        return f"CASE WHEN _row >= {rows} THEN {e} END"

    vols = {f"realized_vol_{n}": once(n + 1, f"_stddev_samp_log_return_1_{n} * {math.sqrt(n)!r}D") for n in VOLS}
    df = add(df, {k: e for k, e in vols.items() if k in wanted})

    def score(x: str, n: int) -> str:
        return f"try_divide({x} - _avg_{x}_{n}, _stddev_samp_{x}_{n})"

    final = {
        "zscore_20": once(20, score("close", 20)),
        "zscore_50": once(50, score("close", 50)),
        "dist_from_ma_20": once(20, "close / _avg_close_20 - 1"),
        **{f"ewma_vol_{n}": _ewma_deviation(n) for n in spans},
        "vol_ratio_10_50": "try_divide(realized_vol_10, realized_vol_50)",
        "vol_change_10": f"realized_vol_10 - {lagged('realized_vol_10', 5)}",
        "parkinson_vol_20": once(20, f"sqrt(_avg__hl2_20 / {4 * math.log(2)!r}D)"),
        "volume_zscore_20": once(20, score("volume", 20)),
        "volume_norm_return": once(20, "try_divide(_ret1, _avg_volume_20)"),
        "activity_intensity_10": once(50, "try_divide(_avg_volume_10, _avg_volume_50)"),
        "close_loc_in_range": "(close - low) / _rng",
        "bar_range_pct": "_rng / close",
        "range_zscore_20": f"CASE WHEN _count__rng_20 = 20 THEN {score('_rng', 20)} END",
        **CLOCK_SQL,
    }
    directions = {target_column(h, "direction"): f"signum({target_column(h)})" for h in horizons}
    df = add(df, {k: e for k, e in final.items() if k in names} | directions)
    targets = [target_column(h, kind) for h in horizons for kind in ("return", "direction")]
    return df.select(*bars.columns, *names, *targets)


def drop_unscorable(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Keep rows with every target. Clock features are never NULL, so warm-up
    rows always have some feature and stay."""
    return df.dropna(subset=[target_column(h) for h in horizons])


def feature_matrix(
    bars: DataFrame,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    dropna: bool = True,
    keep: Sequence[str] | None = None,
    keys: Sequence[str] = KEY,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Features and targets of whole series (`pos` must be present)."""
    if chunk_rows % BLOCK:
        raise ValueError(f"chunk_rows must be a multiple of {BLOCK}")
    spread = with_halo(bars, back=BLOCK, forward=max(horizons, default=0), chunk_rows=chunk_rows)
    wide = core_only(add_features(spread, [*keys, "_chunk"], horizons, keep))
    return drop_unscorable(wide, horizons) if dropna else wide


def future_named(columns: Sequence[str]) -> list[str]:
    """Forward targets among columns offered as features; must be empty."""
    return [c for c in columns if is_target(c)]
