"""Order book, regimes, quality, ingest, stores and the whole run."""

import csv

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.catalogue.market import QUERIES as MARKET
from barloom.catalogue.text import QUERIES
from barloom.operators.book import depth_at, execution_report, sweep, top_of_book
from barloom.operators.folds import FoldPlan, assign_folds
from barloom.operators.ladder import NAIVE, ladder_errors, predict_ladder
from barloom.operators.quality import row_accounting, validate
from barloom.operators.regimes import causal_regimes, current_regime, detect_regimes
from barloom.plans.backtest import Research, regime_evidence
from barloom.plans.ingest import ingest, ingest_directory
from barloom.plans.research import load_bars, research_summary, run_research, run_settings
from barloom.sources import tables
from barloom.sources.delimited import LayoutError, choose_layout, read_lines
from barloom.sources.ranges import coverage, research_range
from barloom.sources.schema import SchemaError, header_test, map_headers, tick_layout

from ranges import cut_into

ORDER = "instrument string, id bigint, side string, price double, quantity double, ts bigint"
REQUEST = (
    "instrument string, request_id bigint, side string, quantity double, limit_price double, submit_time bigint"
)


def test_sweep_respects_limit_and_arrival(spark):
    orders = spark.createDataFrame(
        [("A", 1, "sell", 1.701, 100.0, 1), ("A", 2, "sell", 1.7012, 50.0, 2),
         ("B", 1, "buy", 1.7, 10.0, 1), ("B", 2, "buy", 1.7, 10.0, 2)], ORDER,
    )
    wanted = spark.createDataFrame(
        [("A", 1, "buy", 120.0, 1.7011, 3), ("B", 2, "sell", 15.0, 1.7, 3)], REQUEST
    )
    fills = sweep(orders, wanted).orderBy("request_id", "order_id").collect()
    assert [(f.request_id, f.order_id, f.fill_quantity) for f in fills] == [(1, 1, 100), (2, 1, 10), (2, 2, 5)]
    report = {r.request_id: r for r in execution_report(orders, wanted, 5).collect()}
    assert report[1].remaining_quantity == 20 and not report[1].fully_filled
    assert report[2].fully_filled and report[2].execution_time == 8 and report[2].slippage == 0


def test_top_of_book_with_empty_side(spark):
    orders = spark.createDataFrame([("A", 1, "buy", 1.7, 10.0, 1)], ORDER)
    row = top_of_book(orders).first()
    assert row.best_bid == 1.7 and row.best_ask is None and row.mid_price is None and row.spread == 0
    probes = spark.createDataFrame([("A", 1.7), ("A", 2.0)], "instrument string, price double")
    depths = {r.price: (r.bid_depth, r.ask_depth) for r in depth_at(orders, probes).collect()}
    assert depths == {1.7: (10, 0), 2.0: (0, 0)}


def test_split_books_equal_a_walk(spark, monkeypatch):
    """One book holds most orders and is cut; every fill equals a direct walk."""
    cut_into(monkeypatch, 9)
    rng = np.random.default_rng(1)
    n = 900
    side = rng.choice(["buy", "sell"], n)
    step = rng.integers(0, 15, n) * 0.25
    book = pd.DataFrame(
        {
            "instrument": rng.choice(["A", "A", "B"], n), "id": range(n), "side": side,
            "price": np.where(side == "buy", 100 - step, 100.5 + step),
            "quantity": rng.integers(1, 9, n).astype(float), "ts": rng.integers(0, 30, n),
        }
    )
    m = 60
    ask = pd.DataFrame(
        {
            "instrument": rng.choice(["A", "B"], m), "request_id": range(m),
            "side": rng.choice(["buy", "sell"], m), "quantity": rng.integers(1, 900, m) * 1.0,
            "limit_price": np.where(rng.random(m) < 0.3, np.nan, 100 + rng.integers(-8, 9, m) * 0.5),
            "submit_time": range(m),
        }
    )
    want = {}
    for q in ask.itertuples():
        other = book[(book.instrument == q.instrument) & (book.side != q.side)]
        sign = 1 if q.side == "buy" else -1
        other = other.assign(d=sign * other.price).sort_values(["d", "ts", "id"])
        left = q.quantity
        for o in other.itertuples():
            if left <= 0 or (q.limit_price == q.limit_price and o.d > sign * q.limit_price):
                break
            want[(q.request_id, o.id)] = min(left, o.quantity)
            left -= o.quantity
    orders = spark.createDataFrame(book)
    wanted = spark.createDataFrame(ask).withColumn("limit_price", F.nanvl("limit_price", F.lit(None)))
    got = {(f.request_id, f.order_id): f.fill_quantity for f in sweep(orders, wanted).collect()}
    assert got == pytest.approx(want)
    for r in execution_report(orders, wanted).collect():
        mine = {o: f for (q, o), f in want.items() if q == r.request_id}
        assert r.filled_quantity == pytest.approx(sum(mine.values()))
        if mine:
            value = sum(f * book.price[o] for o, f in mine.items())
            assert r.average_price == pytest.approx(value / sum(mine.values()))


def test_regimes(bars):
    labelled = detect_regimes(bars, iterations=4)
    sums = labelled.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    low, high = sums.agg(F.min("s"), F.max("s")).first()
    assert low == pytest.approx(1) and high == pytest.approx(1)
    names = {r[0] for r in labelled.select("regime").distinct().collect()}
    assert names <= {"high_vol", "trend_up", "trend_down", "mean_revert"}
    assert labelled.where("causal").count() == 0
    assert current_regime(labelled).count() == 2


def test_causal_regimes_feed_the_evidence(bars):
    run = Research(plan=FoldPlan(300, 120, 400, 10))
    train = assign_folds(bars, run.plan, run.tail, ["train"]).drop("role")
    test = assign_folds(bars, run.plan, run.tail, ["test"]).drop("role")
    keys = ["instrument", "fold_id"]
    labelled = causal_regimes(train, test, keys, iterations=3)
    assert labelled.where("not causal").count() == 0
    first = labelled.groupBy(*keys).agg(F.count("*").alias("n")).first()
    assert first.n == 100  # the first 20 rows of a slice have no inputs
    found = regime_evidence(bars, run, labelled)
    assert found.agg(F.sum("n_obs")).first()[0] == labelled.count() * 7


def test_research_run(bars):
    run = Research(plan=FoldPlan(400, 150, 400, 10))
    result = run_research(bars, run)
    summary = {r.instrument: r.n_folds for r in research_summary(result).collect()}
    assert summary == {"A": 8, "B": 2}
    assert result.leakage.where("not ok").count() == 0
    assert result.curve.count() == 10 and result.signals.count() == 14
    assert run_settings(run)["train_bars"] == 400
    with pytest.raises(ValueError):
        Research(primary_horizon=3)


def test_ladder_beats_nothing_by_construction(spark):
    pdf = pd.DataFrame({"x": np.arange(100.0), "y": 2 * np.arange(100.0) + 1})
    df = spark.createDataFrame(pdf)
    rungs = [NAIVE, "linear_regression"]
    errors = {r.model: r.rmse for r in ladder_errors(predict_ladder(df, df, ["x"], "y", rungs), "y", rungs).collect()}
    assert errors["linear_regression"] < 1e-6 < errors[NAIVE]


def test_regime_groups_stop_when_settled(spark):
    sf = "/root/testdata/sf0.001"
    inputs = MARKET["regime_inputs"][0](spark, sf).toPandas()
    got = MARKET["regime_components"][0](spark, sf).toPandas()
    assert set(got.instrument) == set(inputs.instrument)
    for instrument, rows in inputs.groupby("instrument"):
        x = rows[["ret", "vol", "trend"]].to_numpy(float)
        center, scale = x.mean(0), x.std(0)
        z, angle = (x - center) / scale, np.pi * np.arange(4) / 2
        w, m, v = np.full(4, 0.25), np.c_[np.zeros(4), np.cos(angle), np.sin(angle)], np.ones((4, 3))
        before = None
        for _ in range(100):
            s = np.log(w) - ((np.log(v) + (z[:, None] - m) ** 2 / v) / 2).sum(2)
            p = np.exp(s - s.max(1, keepdims=True))
            level = (s.max(1) + np.log(p.sum(1))).mean()
            p /= p.sum(1, keepdims=True)
            n = p.sum(0)[:, None] + 1e-10
            w, m = n[:, 0] / len(z), p.T @ z / n
            v = np.maximum(p.T @ z**2 / n - m**2, 0) + 1e-6
            if before is not None and abs(level - before) < 1e-3:
                break
            before = level
        mine = got[got.instrument == instrument].sort_values("component")
        assert np.allclose(mine.vol, m[:, 1] * scale[1] + center[1], atol=1e-4)
        assert np.allclose(mine.trend, m[:, 2] * scale[2] + center[2], atol=1e-4)


def test_model_ladder_takes_the_features_and_default_sizes(spark, monkeypatch):
    seen = []

    def predict(train, test, features, target, rungs, trees=200, rounds=200):
        seen.append((list(features), trees, rounds))
        return predict_ladder(train, test, features[:1], target, rungs, 2, 2)

    monkeypatch.setattr("barloom.catalogue.market.predict_ladder", predict)
    MARKET["model_ladder"][0](spark, "/root/testdata/sf0.001")
    assert len(seen[0][0]) == 33 and seen[0][1:] == (200, 200)


# --- text ----------------------------------------------------------------------


def table(n=300, sep=",", comma=False, header=True, join=False, compact=False):
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    rng = np.random.default_rng(2)
    base = 1.5 + np.cumsum(rng.normal(0, 0.001, n))
    close = base + rng.normal(0, 0.0004, n)
    rows = ["Date Time Open High Low Close Tick_Volume".replace(" ", sep)] if header else []
    for t, o, c in zip(ts, base, close):
        prices = [f"{p:.5f}" for p in (o, max(o, c) + 0.0003, min(o, c) - 0.0003, c)]
        if comma:
            prices = [p.replace(".", ",") for p in prices]
        day = f"{t:%Y%m%d}" if compact else f"{t:%Y-%m-%d}"
        clock = str(int(f"{t:%H%M}")) if compact else f"{t:%H:%M}"
        rows.append(sep.join([day, clock, *prices, str(int(o * 100))]))
    return rows


def lines_of(spark, rows):
    return spark.createDataFrame([(0, i, r) for i, r in enumerate(rows)], "block int, line bigint, value string")


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"sep": ";", "comma": True},
        {"sep": "\t", "header": False},
        {"sep": " "},
        {"header": False, "compact": True},
        {"compact": True},
    ],
    ids=str,
)
def test_layouts_keep_every_row(spark, options):
    found = ingest(lines_of(spark, table(**options)), "EUR_USD")
    got = found.bars.orderBy("ts").toPandas()
    assert len(got) == 300 and found.kind == "OHLCV"
    assert str(got.ts[0]) == "2024-01-01 00:00:00" and str(got.ts[299]) == "2024-01-13 11:00:00"
    assert (got.high >= got.low).all() and (got.volume > 100).all()


def test_the_profile_counts_fields_as_csv_does(spark, tmp_path):
    """A quote opens a field only at its start, and a doubled one inside stays inside."""
    texts = ['a,"b,c",d\n"x;y";z\n\nplain, line', 'say "a, b" and, "c\n"",,"', '"a,",' * 20000 + "end", 'a,"b ""q,"" c",d', '"open, end']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for line in "\n".join(texts).split("\n"):
        if line.strip(" "):
            for name, mark in (("comma", ","), ("semicolon", ";"), ("tab", "\t")):
                n = len(next(csv.reader([line], delimiter=mark)))
                want[name, n] = want.get((name, n), 0) + 1
            n = len(line.split())
            want["space", n] = want.get(("space", n), 0) + 1
    got = {(r.separator, r.fields): r.n_lines for r in QUERIES["field_profile"][0](spark, str(tmp_path)).collect()}
    assert got == want


def test_an_odd_head_decides_nothing(spark):
    day = pd.date_range("2024-01-01", periods=2500, freq="h")
    flat = [f"{t:%Y-%m-%d %H:%M},1.5,1.5,1.5,1.5" for t in day[:2100]]
    # Close, low, open, high; each bar opens at the close before.
    moved = [f"{t:%Y-%m-%d %H:%M},{2 + k % 7 + 1},{1 + k % 7},{2 + (k - 1) % 7 + 1},{12 + k % 7}" for k, t in enumerate(day[2100:])]
    last = ingest(lines_of(spark, flat + moved), "A").bars.orderBy(F.col("ts").desc()).first()
    cells = [float(x) for x in moved[-1].split(",")[1:]]
    assert [last.close, last.low, last.open, last.high] == cells

    rows = ["When,Open,High,Low,Close"] + [f"{'' if k < 60 else t.strftime('%Y-%m-%d %H:%M')},2,3,1,2" for k, t in enumerate(day[:1000])]
    found = ingest(lines_of(spark, rows), "A")
    assert found.mapping.columns["timestamp"] == "When" and found.bars.count() == 940

    rows = [f"{t:%Y-%m-%d},5;1,5;2,5;1,5;2,5;9,5" for t in day[:100]] + [f"{t:%Y-%m-%d},5;1;2;1;2,5;9" for t in day[100:]]
    layout = choose_layout(lines_of(spark, rows))
    assert (layout.separator, layout.fields) == (";", 6)


def test_four_defects_are_counted(spark):
    rows = table()
    cells = [r.split(",") for r in rows]
    cells[50][2] = "n/a"
    cells[60][3] = "-1"
    cells[70][3], cells[70][4] = cells[70][4], cells[70][3]
    rows = [",".join(c) for c in cells] + [rows[100]]
    found = ingest(lines_of(spark, rows), "EUR_USD")
    a = found.accounting.first()
    assert (a.uploaded_rows, a.usable_rows) == (301, 297)
    assert (a.non_numeric_price, a.invalid_price, a.invalid_ohlc, a.duplicate_timestamp) == (1, 1, 1, 1)
    codes = {r.code for r in found.issues.collect()}
    assert {"duplicate_timestamps", "ohlc_inconsistency", "rows_removed_accounting"} <= codes


def test_files_are_read_and_malformed_lines_refused(spark, tmp_path):
    (tmp_path / "good.csv").write_text("\n".join(table()))
    assert ingest(read_lines(spark, str(tmp_path / "good.csv")), "EUR_USD").bars.count() == 300
    (tmp_path / "bad.csv").write_text("\n".join([*table(), "2024-02-01,00:00,1,2"]))
    with pytest.raises(LayoutError):
        ingest(read_lines(spark, str(tmp_path / "bad.csv")), "EUR_USD")


def test_directory_names_give_instruments(spark, tmp_path):
    for name in ("EURUSD60.csv", "GBPCAD60.csv"):
        (tmp_path / name).write_text("\n".join(table(header=False)))
    found = ingest_directory(spark, str(tmp_path))
    sizes = {r.instrument: r["count"] for r in found.bars.groupBy("instrument").count().collect()}
    assert sizes == {"EUR_USD": 300, "GBP_CAD": 300}
    assert {r.timeframe for r in found.timeframes().collect()} == {"1h"}
    assert found.spacing_issues().count() == 0
    (tmp_path / "mydata.csv").write_text("\n".join(table(header=False)))
    with pytest.raises(SchemaError):
        ingest_directory(spark, str(tmp_path))


def test_missing_columns_are_an_issue(spark):
    rows = ["Time,Open,High,Low"] + [f"2024-01-01 00:{i:02d},1,2,1" for i in range(30)]
    found = ingest(lines_of(spark, rows), "A")
    assert [r.code for r in found.issues.collect()] == ["missing_columns"]
    assert found.bars.count() == 0 and found.mapping.missing == ["close"]


def test_swapped_high_low_is_an_error(spark):
    rows = spark.range(300).selectExpr(
        "'A' AS instrument", "0 AS block", "id AS line",
        "cast(timestamp_seconds(id * 60) AS timestamp_ntz) AS ts",
        "2D AS open", "1D AS high", "3D AS low", "2D AS close", "1D AS volume",
    )
    assert [r.code for r in validate(rows).collect()] == ["systematic_high_low_swap_suspected"]
    assert row_accounting(rows).first().usable_rows == 0


def test_tick_layouts():
    assert tick_layout(["Timestamp", "Bid", "Ask", "Last", "Volume"])["price"] == "Last"
    assert tick_layout(["Timestamp", "Bid"])["price"] == "Bid"
    assert tick_layout(["Time", "Open", "High", "Low", "Close"]) is None
    with pytest.raises(SchemaError):
        tick_layout(["Timestamp", "Bid", "Ask"])


def test_tick_file_without_timeframe_is_refused(spark):
    rows = ["Timestamp,Bid,Last"] + [f"2024-01-01 00:00:{i:02d},1.0,1.1" for i in range(60)]
    with pytest.raises(SchemaError):
        ingest(lines_of(spark, rows), "A")
    found = ingest(lines_of(spark, rows), "A", "1min")
    assert found.bars.count() == 1 and found.bars.first().volume == 60
    assert found.issues.first().code == "insufficient_rows_after_aggregation"


def test_headers(spark):
    rows = spark.createDataFrame([(["date", "time", "x"],), (["1 5", "2"],), (["open", "x"],), (["open", "vol"],)], "f array<string>")
    assert [r[0] for r in rows.select(header_test(F.col("f"))).collect()] == [True, False, False, True]
    m = map_headers(["Gmt time", "Open", "High", "Low", "Last", "Vol"])
    assert m.columns["close"] == "Last" and "last" not in m.columns and not m.missing
    assert map_headers(["Open", "High"]).missing == ["low", "close"]


# --- stores --------------------------------------------------------------------


def test_dataset_store(spark, bars, tmp_path):
    store = str(tmp_path)
    one = bars.where("instrument = 'B'").select("ts", "open", "high", "low", "close", "volume")
    key = tables.register_dataset(one, store, "x.csv", "EUR_USD", "1h")
    loaded = tables.load_dataset(spark, store, key)
    assert loaded.count() == 1300 and loaded.first().source == "UPLOADED_CSV"
    assert tables.list_datasets(spark, store, 1).first().n_rows == 1300
    assert load_bars(loaded, "1h", "4h", "2024-01-03").agg(F.max("n_bars")).first()[0] == 313
    extra = one.limit(1).selectExpr("*", "'EUR_USD' AS instrument")
    tables.write_bars(extra, f"{store}/bars/{key}", "1h")
    with pytest.raises(tables.StoreError):
        tables.load_dataset(spark, store, key)


def test_experiment_store(spark, tmp_path):
    store = str(tmp_path)
    assert tables.list_experiments(spark, store).count() == 0
    key = tables.log_experiment(spark, store, "A", "1h", "m", "uploaded", 42, {"a": 1}, {"s": 0.5}, ["x"])
    assert tables.get_experiment(spark, store, key)["metrics"] == {"s": 0.5}
    assert tables.delete_experiment(spark, store, key) and not tables.delete_experiment(spark, store, key)
    assert tables.get_experiment(spark, store, key) is None


def test_ranges(bars):
    got = research_range(bars, "2024-01-01T05:00:00", "2024-01-01T08:00:00Z")
    assert got.where("instrument = 'A'").count() == 4
    assert research_range(bars, "2020-01-01", "2024-01-01T01:00:00").where("instrument = 'A'").count() == 2
    for start, end in (("2024-02-01", "2024-01-01"), ("2030-01-01", None)):
        with pytest.raises(ValueError):
            research_range(bars, start, end)
    row = coverage(bars, "2024-01-10", None).where("instrument = 'A'").first()
    assert row.bars_selected == 3500 - 216 and not row.requested_out_of_range


def test_sweep_leaves_no_rounding_fill(spark):
    from barloom.operators.book import sweep

    orders = [("A", 1, "sell", 10.0, 0.7, 1), ("A", 2, "sell", 11.0, 0.1, 2), ("A", 3, "sell", 99.0, 5.0, 3)]
    kinds = "instrument string, id long, side string, price double, quantity double, ts long"
    asked = spark.createDataFrame([("A", 1, "buy", 0.8)], "instrument string, request_id long, side string, quantity double")
    fills = sweep(spark.createDataFrame(orders, kinds), asked).collect()
    assert sorted((f.order_id, round(f.fill_quantity, 9)) for f in fills) == [(1, 0.7), (2, 0.1)]
