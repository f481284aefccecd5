"""Metrics, alert thresholds, drift detectors and their parallel forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowstream.functions.drift import Adwin, Ddm
from flowstream.functions import evt
from flowstream.functions.evt import fit_gpd
from flowstream.operators import drift as D
from flowstream.operators import evaluation as E
from flowstream.operators import thresholds as T


def gpd_log_density(shape, scale, y):
    """Sum of the log density of the generalised Pareto law, as published."""
    if shape == 0:
        return float(np.sum(-np.log(scale) - y / scale))
    return float(np.sum(-np.log(scale) - (1 / shape + 1) * np.log1p(shape * y / scale)))


def preds(spark, pairs):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "seq long, truth int, pred int")


def one(df):
    r = df.first()
    return None if r is None else tuple(round(r[c], 6) for c in ("f1", "precision", "recall"))


def test_zero_division_and_single_class(spark):
    assert one(E.binary_metrics(preds(spark, [(0, 0), (0, 0)]))) == (0, 0, 0)
    assert one(E.binary_metrics(preds(spark, [(0, 0), (0, 0)]), target=None)) == (100, 100, 100)
    assert one(E.binary_metrics(preds(spark, []), target=None)) == (0, 0, 0)
    assert one(E.binary_metrics(preds(spark, []))) == (0, 0, 0)
    assert one(E.binary_metrics(preds(spark, [(1, 0), (0, 0), (2, 2)]), target=None)) == (round(100 * (2 / 3 + 1) / 3, 6), 50, round(200 / 3, 6))


def test_history_sample_points(spark):
    pairs = [(1, 1), (0, 1), (1, 1), (1, 0), (0, 0), (1, 1), (0, 1), (1, 1), (1, 1), (1, 0)]
    got = E.prequential_history(preds(spark, pairs), 3, warmup=2, block_rows=2).orderBy("at_seq").collect()
    assert [r["at_seq"] for r in got] == [3, 6, 9]
    for r in got:
        rows = pairs[2:r["at_seq"] + 1]
        tp, fp, fn = (sum(1 for t, p in rows if (t, p) == k) for k in ((1, 1), (0, 1), (1, 0)))
        assert r["f1"] == pytest.approx(200 * tp / (2 * tp + fp + fn))


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 12, 400) / 4
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, truth int")
    pos, neg = s[y == 1], s[y == 0]
    expect = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert E.auc(df, block_rows=3).first()["auc"] == pytest.approx(expect)
    assert E.auc(df.filter("truth = 1")).first()["auc"] is None


def test_warmup_keeps_short_streams(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)], "k string, seq long")
    assert dict(E.exclude_warmup(df, 3, "k").groupBy("k").count().collect()) == {"a": 2, "b": 3}


@pytest.mark.parametrize("gamma", [-0.3, 0.001, 0.3, 0.8])
@pytest.mark.parametrize("n", [50, 800])
def test_pareto_fit_against_brute_force(gamma, n):
    rng = np.random.default_rng(n)
    y = ((1 - rng.random(n)) ** -gamma - 1) / gamma
    xs = np.concatenate([-np.geomspace(1e-5 / y.mean(), 0.999 / y.max(), 1500), np.geomspace(1e-6 / y.mean(), 1e3 / y.mean(), 1500)])
    g = [np.log1p(x * y).mean() for x in xs]
    best = max([gpd_log_density(a, a / x, y) for a, x in zip(g, xs) if a > -1] + [gpd_log_density(0, y.mean(), y)])
    assert gpd_log_density(*fit_gpd(y), y) > best - 0.05


def plain_dspot(xs, q, d, tq, warmup):
    """The step rules once more, without any shared state code."""
    out, w = [], []
    shifted = []
    for i, x in enumerate(xs[:warmup]):
        if i >= d:
            shifted.append(x - np.mean(w[-d:]))
        w.append(x)
        out.append((0, 0.0, 0.0))
    if len(xs) < warmup:
        return out
    base = np.array(shifted or xs[:warmup])
    t = np.quantile(base, tq)
    peaks, k = list(base[base > t] - t), len(base)

    def level():
        g, s = fit_gpd(peaks)
        r = q * k / len(peaks)
        return t - s * math.log(r) if g == 0 else t + s / g * (r ** -g - 1)

    z = level() if peaks else t + 0.1
    for x in xs[warmup:]:
        m = np.mean(w[-d:])
        if x - m > z:
            out.append((1, m + z, m))
            continue
        k += 1
        if x - m > t:
            peaks.append(x - m - t)
            z = level()
        w.append(x)
        m = np.mean(w[-d:])
        out.append((0, m + z, m))
    return out


@pytest.fixture(scope="module")
def score_rows():
    rng = np.random.default_rng(5)
    out = {}
    for k, n in (("a", 400), ("b", 260), ("short", 40), ("flat", 200)):
        x = rng.exponential(1.0, n) + np.linspace(0, 2, n)
        if n > 100:
            x[rng.integers(100, n, n // 40)] += 15  # spikes after the warm-up, so that alerts do occur
        out[k] = np.ones(n) if k == "flat" else x
    return out


@pytest.mark.parametrize("segment_rows", [1_000_000, 97])
def test_dspot_equals_plain_rules(spark, score_rows, segment_rows):
    rows = [(k, i, float(x)) for k, xs in score_rows.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, score double").repartition(3)
    got = {}
    for r in T.dspot(df, q=0.01, depth=20, t_quantile=0.9, warmup=80, segment_rows=segment_rows).orderBy("stream_id", "seq").collect():
        got.setdefault(r["stream_id"], []).append((r["pred"], r["threshold"], r["trend"]))
    for k, xs in score_rows.items():
        expect = plain_dspot(list(xs), 0.01, 20, 0.9, 80)
        assert [g[0] for g in got[k]] == [e[0] for e in expect]
        assert np.allclose(np.array(got[k]), np.array(expect), rtol=1e-6, atol=1e-9)
    assert sum(g[0] for g in got["a"]) > 0


def test_dspot_warmup_not_longer_than_depth(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(60)], "stream_id string, seq long, score double")
    rows = T.dspot(df, depth=50, warmup=30, t_quantile=0.5, q=0.01).orderBy("seq").collect()
    assert rows[29]["threshold"] == 0.0 and rows[30]["threshold"] > 0
    with pytest.raises(Exception, match="warm-up"):
        T.dspot(df, warmup=0).collect()


def drift_rows():
    rng = np.random.default_rng(11)
    return (rng.random(1000) < np.where(np.arange(1000) < 500, 0.1, 0.6)).astype(float)


def test_ddm_forms_agree(spark):
    e = drift_rows()
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(e)] + [("b", i, float(x)) for i, x in enumerate(e[::-1])],
                               "stream_id string, seq long, error double")
    states = D.ddm(df).filter("state = 'change'")
    first = {r[0]: r[1] for r in states.groupBy("stream_id").agg(F.min("seq")).collect()}
    for block_rows in (16, 100_000):
        assert {r[0]: r[1] for r in D.ddm_first(df, "stream_id", block_rows=block_rows).collect()} == first
    assert any(500 <= r["seq"] < 560 for r in states.filter("stream_id = 'a'").collect())
    cut = D.ddm(df, segment_rows=130).orderBy("stream_id", "seq").collect()
    assert cut == D.ddm(df).orderBy("stream_id", "seq").collect()


def test_adwin_adapts():
    e = drift_rows()
    a = Adwin()
    hits = np.nonzero(a.process(e))[0]
    assert any(500 <= h < 600 for h in hits) and not any(h < 500 for h in hits)
    assert a.width < 600 and a.total / a.width == pytest.approx(0.6, abs=0.1)
    flat = Adwin()
    assert flat.process(np.tile([0.0, 1.0], 1500)).sum() == 0 and flat.width == 3000


def test_adwin_totals_match_its_buckets():
    a = Adwin()
    for x in np.random.default_rng(3).random(700):
        a.add(float(x))
    assert sum(s for row in a.rows for s, _ in row) == pytest.approx(a.total)
    assert sum(len(row) * 2**r for r, row in enumerate(a.rows)) == a.width


def test_ddm_quiet_stream():
    assert Ddm().process(np.zeros(200)).sum() == 0


def test_monitor(spark):
    e = drift_rows()
    df = spark.createDataFrame([("a", i, 1, int(1 - x)) for i, x in enumerate(e)], "stream_id string, seq long, truth int, pred int")
    got = D.drift_monitor(df)
    assert {r["detector"] for r in got.collect()} == {"DDM", "ADWIN"}


def test_sweep_and_best_trial(spark):
    df = spark.createDataFrame([(s / 10, int(s > 6)) for s in range(11)] + [(0.2, 1)], "score double, truth int")
    got = E.threshold_sweep(df, [0.2, 0.6, 0.9]).collect()
    assert got[0]["threshold"] == 0.6
    for r in got:
        flags = df.withColumn("pred", (F.col("score") > r["threshold"]).cast("int"))
        assert one(E.binary_metrics(flags)) == tuple(round(r[c], 6) for c in ("f1", "precision", "recall"))
    trials = spark.createDataFrame([("x", "s", 0, 5.0), ("x", "s", 1, 9.0), ("x", "s", 2, 9.0)], "algorithm string, stream_id string, trial int, f1 double")
    assert E.best_trial(trials).first()["trial"] == 1


def test_missing_predictions_are_misses(spark):
    rows = [(0, 1, 1, 0.9), (1, 1, None, None), (2, 1, None, None), (3, 0, 0, 0.1)]
    df = spark.createDataFrame(rows, "seq long, truth int, pred int, score double")
    one = E.binary_metrics(df).first()
    assert (one["f1"], one["precision"]) == (50.0, 100.0) and abs(one["recall"] - 100 / 3) < 1e-9
    win = E.windowed_metrics(df, 4).first()
    assert win["accuracy"] == 50.0 and abs(win["recall"] - 100 / 3) < 1e-9
    areas = {r["window_id"]: r["auc"] for r in E.windowed_auc(df.withColumn("seq", F.when(F.col("score").isNull(), F.col("seq")).otherwise(F.col("seq") + 10)), 5).collect()}
    assert areas[0] is None


def test_dspot_with_a_bound_on_its_peaks(spark, score_rows):
    from flowstream.functions.evt import Dspot

    x = score_rows["a"]
    settings = {"q": 0.01, "depth": 20, "t_quantile": 0.9, "warmup": 80}
    free, wide, tight = Dspot(**settings), Dspot(**settings, max_peaks=1000), Dspot(**settings, max_peaks=5)
    for a, b in zip(free.process(x), wide.process(x)):
        assert (a == b).all()
    flag, threshold, _ = tight.process(x)
    assert len(tight.peaks) == 5 and tight.n_peaks > 10 and np.isfinite(threshold).all() and flag.sum() > 0
    assert list(free.peaks)[-5:] != [] and len(free.peaks) == free.n_peaks
    with pytest.raises(ValueError, match="max_peaks"):
        Dspot(max_peaks=0)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "stream_id string, seq long, score double")
    got = T.dspot(rows, **settings, max_peaks=5, segment_rows=90).orderBy("seq").collect()
    assert [r["threshold"] for r in got] == threshold.tolist()


def test_dspot_sweep_over_one_shuffle(spark, score_rows):
    rows = spark.createDataFrame([(k, i, float(v), int(v > 10)) for k in ("a", "b") for i, v in enumerate(score_rows[k])], "stream_id string, seq long, score double, truth int")
    grid = [(0.01, 20, 0.9), (0.05, 10, 0.95)]
    got = {(r["stream_id"], r["trial"]): r for r in T.dspot_sweep(rows, grid, 80, target=1).collect()}
    assert len(got) == 4
    for i, (q, depth, t) in enumerate(grid):
        for r in T.dspot_evaluation(rows, 80, 1, ["stream_id"], q=q, depth=depth, t_quantile=t).collect():
            mine = got[(r["stream_id"], i)]
            assert (mine["q"], mine["depth"], mine["t_quantile"], mine["f1"], mine["precision"], mine["recall"]) == (q, depth, t, r["f1"], r["precision"], r["recall"])


def test_parity_holds_the_trial_of_a_sweep_too(spark, tmp_path, monkeypatch):
    from catalog import facts

    rows = [(i, f"2024-01-0{1 + i % 2} 00:{i // 60 % 60:02d}:{i % 60:02d}", float(i * 37 % 101 + i % 7)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    days = {"2024-01-01", "2024-01-02"}
    assert {(r["stream_id"], r["n"], r["differences"]) for r in facts.dspot_parity(spark, str(tmp_path)).collect()} == {(d, 150, 0) for d in days}
    steps = T.run_steps
    monkeypatch.setattr(T, "run_steps", lambda *a, **k: steps(*a, **k).withColumn("threshold", F.col("threshold") + F.when(F.col("seq") >= 140, 1.0).otherwise(0.0)))
    assert {(r["stream_id"], r["n"], r["differences"]) for r in facts.dspot_parity(spark, str(tmp_path)).collect()} == {(d, 150, 10) for d in days}


def test_segments_of_a_stream_need_no_jobs_of_their_own(spark):
    df = spark.range(400).select(F.lit("a").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") * 7 % 31).cast("double").alias("score"))
    spark.sparkContext.setJobGroup("segments", "segments")
    try:
        got = T.dspot(df, q=0.01, depth=5, t_quantile=0.9, warmup=20, segment_rows=10)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("segments")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    whole = T.dspot(df, q=0.01, depth=5, t_quantile=0.9, warmup=20)
    assert got.orderBy("seq").collect() == whole.orderBy("seq").collect() and got.count() == 400


@pytest.mark.parametrize("shape", [-0.3, 0.0, 0.4])
def test_tail_fits_of_many_peaks_by_products(monkeypatch, shape):
    u = np.random.default_rng(4).uniform(size=1501)
    y = -3 * np.log(u) if shape == 0 else 3 * (u**-shape - 1) / shape
    fast = fit_gpd(y)
    logs = evt._mean_logs(np.array([-0.5 / y.max(), 0.0, 2.0]), y)[1]
    assert logs == pytest.approx([np.log1p(x * y).mean() for x in (-0.5 / y.max(), 0.0, 2.0)], rel=1e-12, abs=1e-15)
    monkeypatch.setattr(evt, "PRODUCT_PEAKS", len(y) + 1)
    assert fast == pytest.approx(fit_gpd(y), rel=1e-8)


@pytest.mark.parametrize("shape", [-0.6, 0.0, 0.4])
def test_tail_fits_of_many_peaks_see_cells(shape, monkeypatch):
    u = np.random.default_rng(6).uniform(size=1200)
    y = -3 * np.log(u) if shape == 0 else 3 * (u**-shape - 1) / shape
    peaks = evt.Peaks()
    for v in y.tolist():
        peaks.append(v)
        if len(peaks) % 7 == 0:
            peaks.tail()  # fits on the way, so that cells grow peak by peak
    tail = peaks.tail()
    assert tail.clusters.n == len(y) and len(tail.clusters.center) < 70
    for x in (-0.999999 / y.max(), -0.5 / y.max(), 1e-4, 1.0, 1e6):
        inverse, log = tail.clusters.sums(np.array([x]))
        assert inverse[0] == pytest.approx((1 / (1 + x * y)).mean(), rel=1e-11) and log[0] == pytest.approx(np.log1p(x * y).mean(), rel=1e-10)
    assert evt.fit_many([tail])[0] == pytest.approx(fit_gpd(y), rel=1e-7)
    others = [evt._Tail(y[:n]) for n in (3, 70, 500)]
    assert evt.fit_many([*others, tail]) == [evt.fit_many([t])[0] for t in [*others, tail]]  # to the last bit
    # a fit's time does not grow with the peaks: neither logarithms nor reciprocals of all of them are taken
    monkeypatch.setattr(evt, "_mean_logs", None)
    assert evt.fit_many([tail])[0] == pytest.approx(fit_gpd_of_cells(y), rel=1e-7)


def fit_gpd_of_cells(y):
    return evt.fit_many([evt._Tail(y, evt.Clusters(y))])[0]


def test_dspot_sweep_steps_each_stream_once(spark, score_rows):
    steps = spark.sparkContext.accumulator(0)

    class Counted(T.DspotStep):
        def init(self, key):
            steps.add(1)
            return super().init(key)

    rows = [(k, i, float(v), int(v > 10)) for k in ("a", "b", "short") for i, v in enumerate(score_rows[k])] + [("a", 400, 1.0, None)]
    df = spark.createDataFrame([(None if k == "b" else k, *r) for k, *r in rows], "stream_id string, seq long, score double, truth int")
    grid = [(0.01, 20, 0.9), (0.05, 10, 0.95), (0.05, 10, 0.9)]
    for target in (1, None):
        want = {(r["stream_id"], i): tuple(r)[1:] for i, (q, d, t) in enumerate(grid)
                for r in T.dspot_evaluation(df, 80, target, ["stream_id"], q=q, depth=d, t_quantile=t).collect()}
        got = {(r["stream_id"], r["trial"]): tuple(r)[5:] for r in T.dspot_sweep(df, grid, 80, target).collect()}
        assert got == want and len(got) == 9
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "DspotStep", Counted)
        T.dspot_sweep(df, grid, 80, 1).collect()
    assert steps.value == 9
