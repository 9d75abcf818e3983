"""Features, folds, signals, ranks and risk on random walks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.student_t import two_sided_tail
from barloom.operators import lookup
from barloom.operators.bars import resample, tick_bars
from barloom.operators.evaluation import bootstrap_mean, evaluate_signals, information_coefficient, rolling_ic
from barloom.operators.execution import Costs, cost_sensitivity, simulate_execution
from barloom.operators.features import FEATURES, feature_matrix, future_named
from barloom.operators.folds import FoldPlan, assign_folds, detect_leakage
from barloom.operators.positions import with_gap, with_position
from barloom.operators.ranks import exact_percentile, spearman_matrix
from barloom.operators.risk import risk_report, stopped_position, with_drawdown
from barloom.operators.execution import in_order
from barloom.operators.signals import combine_scores, momentum, needed_features, score_signals
from barloom.functions.timeframes import TimeframeError

from ranges import cut_into


def local(df, name="A"):
    return df.where(F.col("instrument") == name).orderBy("pos").toPandas()


def test_features_match_rolling_windows(bars):
    got = local(feature_matrix(bars, (), dropna=False))
    c, v = got.close, got.volume
    lr, rng = np.log(c).diff(), (got.high - got.low).replace(0, np.nan)
    want = {
        "momentum_20": np.log(c).diff(20),
        "zscore_50": (c - c.rolling(50).mean()) / c.rolling(50).std(),
        "realized_vol_10": lr.rolling(10).std() * np.sqrt(10),
        "ewma_vol_30": lr.ewm(span=30).std(),
        "volume_zscore_20": (v - v.rolling(20).mean()) / v.rolling(20).std(),
        "activity_intensity_10": v.rolling(10).mean() / v.rolling(50).mean(),
        "range_zscore_20": (rng - rng.rolling(20).mean()) / rng.rolling(20).std(),
    }
    for name, series in want.items():
        assert (got[name].isna() == series.isna()).all(), name
        assert np.allclose(got[name].dropna(), series.dropna(), rtol=1e-7, atol=1e-10), name


def test_chunks_do_not_change_features(bars):
    whole = local(feature_matrix(bars, (1, 20), dropna=False))
    cut = local(feature_matrix(bars, (1, 20), dropna=False, chunk_rows=1024))
    pd.testing.assert_frame_equal(whole, cut, check_exact=False, rtol=1e-9, atol=1e-12)


def test_no_look_ahead(bars):
    names = [f for f in FEATURES]
    full = local(feature_matrix(bars, (), dropna=False))
    early = local(feature_matrix(bars.where("pos < 700"), (), dropna=False))
    pd.testing.assert_frame_equal(full[names].head(700), early[names], check_exact=False, rtol=1e-9, atol=1e-12)
    assert future_named(names) == []


def test_constant_prices_have_no_score(spark):
    rows = spark.range(120).selectExpr(
        "'A' AS instrument", "cast(timestamp_seconds(id * 3600) AS timestamp_ntz) AS ts",
        "1.1D AS open", "1.1D AS high", "1.1D AS low", "1.1D AS close", "0.1D AS volume",
    )
    out = local(feature_matrix(with_position(rows), (), dropna=False))
    for name in ("zscore_20", "zscore_50", "volume_zscore_20", "close_loc_in_range", "vol_ratio_10_50"):
        assert out[name].isna().all(), name
    assert (out["realized_vol_20"].dropna() == 0).all()


def exact_scores(values, n):
    """Two-pass scores of the last value of each window; NaN where a window does not vary."""
    windows = np.lib.stride_tricks.sliding_window_view(np.asarray(values), n).astype(np.longdouble)
    mean = windows.mean(axis=1, keepdims=True)
    spread = np.sqrt(((windows - mean) ** 2).sum(axis=1) / (n - 1))
    out = np.full(len(values), np.nan)
    flat = (windows == windows[:, :1]).all(axis=1)
    out[n - 1 :] = np.where(flat, np.nan, (windows[:, -1] - mean[:, 0]) / np.where(flat, 1, spread))
    return out


def test_scores_are_exact_beside_spikes_and_jumps(spark):
    """Volumes of 1e3 with spikes of 1e12, of 1e9 that vary by 100, and a price that jumps from 1
    to 1e4: what has left a window, or lies before it in its block, changes no digit."""
    rng = np.random.default_rng(8)
    spikes = 1e3 + rng.integers(0, 50, 3000).astype(float)
    spikes[::997] = 1e12
    large = np.r_[np.full(1024, 5.0), 1e9 + rng.integers(-100, 101, 1976)]
    price = np.r_[1 + rng.random(1500) / 100, 1e4 + rng.random(1500)]
    price[2000:2030] = 1e4
    for volume in (spikes, large):
        pdf = pd.DataFrame({"i": range(3000), "volume": volume, "price": price, "wide": 1 + rng.random(3000)})
        rows = spark.createDataFrame(pdf).selectExpr(
            "'A' AS instrument", "cast(timestamp_seconds(i * 3600) AS timestamp_ntz) AS ts",
            "price AS open", "price + wide AS high", "price AS low", "price AS close", "volume",
        )
        got = local(feature_matrix(with_position(rows), (), dropna=False))
        ranges = (price + pdf.wide) - price
        for name, values, n in (("volume_zscore_20", volume, 20), ("zscore_20", price, 20), ("zscore_50", price, 50), ("range_zscore_20", ranges, 20)):
            want = exact_scores(values, n)
            assert (got[name].isna() == np.isnan(want)).all(), name
            assert np.allclose(got[name].dropna(), want[~np.isnan(want)], rtol=1e-6, atol=1e-6), name
        assert np.allclose(got.activity_intensity_10[49:], [volume[i - 9 : i + 1].mean() / volume[i - 49 : i + 1].mean() for i in range(49, 3000)], rtol=1e-9)


def test_absent_inputs_skip_a_signal(bars):
    signals = (momentum(5), momentum(99))
    wide = feature_matrix(bars, (1,), keep=needed_features(signals))
    scored = score_signals(wide, ["instrument"], True, signals)
    found = evaluate_signals(scored, ["instrument"], ["pos"], [1], False, signals)
    assert {r.signal for r in found.select("signal").distinct().collect()} == {"momentum_5"}
    weights = scored.select("instrument").distinct().selectExpr("*", "1D AS weight_momentum_5", "NULL AS weight_momentum_99")
    combined = combine_scores(scored, weights, ["instrument"], signals)
    assert combined.where("combined_score <> score_momentum_5").count() == 0


def test_positions_and_gaps(bars, walk):
    got = local(with_gap(bars, chunk_rows=1024))
    assert got.pos.tolist() == list(range(3500)) and (got.n_bars == 3500).all()
    assert got.gap_us.isna().sum() == 1 and (got.gap_us.dropna() == 3_600_000_000).all()


def test_resample_refuses_finer(bars):
    with pytest.raises(TimeframeError):
        resample(bars, "1h", "5min")
    assert resample(bars, "1h", "1h") is bars
    assert resample(bars, "1h", "1d").where("instrument = 'A'").count() == 146


def test_second_ticks_to_minutes(spark):
    ticks = spark.range(18_000).selectExpr(
        "'A' AS instrument", "cast(timestamp_seconds(id) AS timestamp_ntz) AS ts", "1D + id % 7 AS price"
    )
    out = tick_bars(ticks, "1min")
    assert out.count() == 300
    assert out.agg(F.sum("volume")).first()[0] == 18_000


PLAN = FoldPlan(train=200, test=50, step=50, embargo=5)


def test_folds_match_loop(bars):
    got = assign_folds(bars, PLAN, tail=20).where("instrument = 'B'").select("fold_id", "role", "pos").toPandas()
    want, start, k = set(), 0, 0
    while start + 255 <= 1280:
        want |= {(k, "train", p) for p in range(start, start + 200)}
        want |= {(k, "test", p) for p in range(start + 205, start + 255)}
        start, k = start + 50, k + 1
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)


def test_short_series_has_no_fold(bars):
    assert assign_folds(bars.where("pos < 100").withColumn("n_bars", F.lit(100)), PLAN).count() == 0


def test_leakage_is_reported(bars):
    folded = assign_folds(bars, PLAN, 20)
    assert detect_leakage(folded).where("not ok").count() == 0
    extra = folded.where("role = 'train' and pos % 200 = 199").withColumn("role", F.lit("test"))
    assert detect_leakage(folded.unionByName(extra)).where("overlap > 0 and not ok").count() > 0


def test_monotone_score_has_full_correlation(spark):
    df = spark.range(200).selectExpr("'A' AS instrument", "id AS pos", "id * 1D AS s", "exp(id / 50D) AS f", "1D AS flat")
    for bounded in (True, False):
        row = information_coefficient(df, ["instrument"], ["pos"], "s", "f", bounded).first()
        assert row.ic == pytest.approx(1) and row.p_value == 0 and row.significant
    flat = information_coefficient(df, ["instrument"], ["pos"], "flat", "f", True).first()
    assert flat.ic is None and flat.n_obs == 200 and not flat.significant
    few = information_coefficient(df.limit(29), ["instrument"], ["pos"], "s", "f", True).first()
    assert few.ic is None and few.n_obs == 29


@pytest.fixture
def tiny_pieces(monkeypatch):
    cut_into(monkeypatch, 7)


def test_split_ranks_equal_plain_ranks(spark, tiny_pieces):
    """A value holds a third of the rows, and every group is cut."""
    rng = np.random.default_rng(3)
    n = 4000
    x = np.where(rng.random(n) < 1 / 3, 0.0, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "i": range(n), "x": x, "y": x + rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    want = {g: d.x.rank().corr(d.y.rank()) for g, d in pdf.groupby("g")}
    for bounded in (True, False):
        got = spearman_matrix(df, ["g"], ["i"], ["x"], ["y"], bounded).toPandas()
        assert got.n_obs.sum() == n
        for row in got.itertuples():
            assert row.rho == pytest.approx(want[row.g], abs=1e-12)


def test_split_percentiles_equal_numpy(spark, tiny_pieces):
    rng = np.random.default_rng(4)
    values = np.where(rng.random(3000) < 0.3, 1.0, rng.exponential(size=3000))
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values}))
    row = exact_percentile(df, ["g"], "v", [0.05, 0.5], ["lo", "mid"]).first()
    assert row.lo == pytest.approx(np.percentile(values, 5))
    assert row.mid == pytest.approx(np.percentile(values, 50))


def test_last_step_equals_search(spark, tiny_pieces):
    rng = np.random.default_rng(5)
    at, probe = rng.integers(0, 300, 400), rng.integers(-10, 320, 200)
    steps = spark.createDataFrame(pd.DataFrame({"k": 1, "at": np.unique(at), "v": np.unique(at) * 10}))
    probes = spark.createDataFrame(pd.DataFrame({"k": 1, "at": np.unique(probe)}))
    known = np.unique(at)
    for strict, side in ((False, "right"), (True, "left")):
        got = lookup.last_step(steps, probes, ["k"], "at", ["v"], strict).toPandas()
        for row in got.itertuples():
            i = np.searchsorted(known, row.at, side) - 1
            assert (pd.isna(row.v) and i < 0) or row.v == known[i] * 10


def test_rolling_ic_equals_direct(bars):
    m = score_signals(feature_matrix(bars, (1,), keep=needed_features()), ["instrument"], False)
    got = rolling_ic(m, "score_momentum_5", "future_return_1", 100, chunk_rows=1024)
    got = got.where("instrument = 'B'").orderBy("pos").toPandas()
    raw = local(m, "B")
    for end in (99, 500, 1100, 1298):
        part = raw.iloc[end - 99 : end + 1]
        want = part.score_momentum_5.rank().corr(part.future_return_1.rank())
        assert got.ic[end] == pytest.approx(want, abs=1e-12)
    assert got.ic.head(99).isna().all() and len(got) == 1299


def test_scores_stay_in_range(bars):
    m = score_signals(feature_matrix(bars, keep=needed_features()), ["instrument"], False)
    cols = [c for c in m.columns if c.startswith("score_")]
    worst = m.select(F.max(F.greatest(*[F.abs(c) for c in cols]))).first()[0]
    assert len(cols) == 7 and worst <= 1 and m.dropna(subset=cols).count() == m.count()


def test_student_tail_known_values():
    # Fixed values from published t tables.
    got = two_sided_tail(np.array([2.228, 1.96, 12.706, 0.0, np.inf]), np.array([10, 1e7, 1, 5, 3]))
    assert np.allclose(got, [0.05, 0.05, 0.05, 1.0, 0.0], atol=5e-5)


def test_bootstrap_copies_no_row(spark):
    df = spark.range(10).selectExpr("id % 2 AS g", "id AS i", "CAST(id AS double) AS v")
    plan = bootstrap_mean(df, ["g"], "v", "i")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInPandas" in plan


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(1.0, 2.0, 800)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "i": range(800), "v": values}))
    row = bootstrap_mean(df, ["g"], "v", "i", resamples=400).first()
    half = 1.96 * values.std() / np.sqrt(800)
    assert row["mean"] == pytest.approx(values.mean())
    assert row.lower == pytest.approx(values.mean() - half, abs=0.04)
    assert row.upper == pytest.approx(values.mean() + half, abs=0.04)


@pytest.fixture(scope="module")
def executed(spark):
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame(
        {
            "instrument": "A",
            "fold_id": 0,
            "pos": range(n),
            "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))),
            "desired_position": rng.uniform(-2, 2, n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_execution_rules(executed):
    pdf, df = executed
    free = simulate_execution(df, Costs(0, 0, 0)).orderBy("pos").toPandas()
    assert np.allclose(free.gross_return, free.net_return)
    late = simulate_execution(df, Costs(latency_bars=3)).orderBy("pos").toPandas()
    want = pdf.desired_position.clip(-1, 1).shift(3).fillna(0)
    assert np.allclose(late.position, want) and (late.cost >= 0).all()
    assert late.position.abs().max() <= 1


def test_cost_drag_grows(executed):
    table = cost_sensitivity(simulate_execution(executed[1], Costs())).orderBy("cost_multiplier").toPandas()
    assert table.total_cost_drag.is_monotonic_increasing and table.total_cost_drag[0] == 0
    assert table.net_sharpe[0] == pytest.approx(table.gross_sharpe[0])


def test_stop_equals_loop(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(-0.001, 0.03, 400)
    pdf = pd.DataFrame({"instrument": "A", "fold_id": 0, "pos": range(400), "r": r, "position": 1.0})
    path = with_drawdown(spark.createDataFrame(pdf), "r")
    got = path.withColumn("p", stopped_position("position", 0.1, in_order())).orderBy("pos").toPandas()
    equity = np.cumprod(1 + r)
    hit = equity / np.maximum.accumulate(equity) - 1 <= -0.1
    want, stopped = [], False
    for h in hit:
        stopped = stopped or h
        want.append(0.0 if stopped else 1.0)
        stopped = stopped and h
    assert got.p.tolist() == want and 0 < hit.sum() < 400


def test_chunked_drawdown_and_report(spark):
    rng = np.random.default_rng(10)
    r = rng.normal(0, 0.02, 1000)
    pdf = pd.DataFrame({"instrument": "A", "fold_id": 0, "pos": range(1000), "r": r, "p": np.sign(r)})
    df = spark.createDataFrame(pdf)
    plain = risk_report(df, "r", "p").drop("fold_id").first().asDict()
    split = risk_report(df, "r", "p", ["instrument"], False, 64).first().asDict()
    for k, v in plain.items():
        assert split[k] == pytest.approx(v), k
    assert plain["expected_shortfall_95"] >= plain["var_95"]
    equity = np.cumprod(1 + r)
    assert plain["max_drawdown"] == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min())
