"""Scorers, learners, sweeps and live forms: properties and planted signals."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import facts, learned
from flowstream.functions import hoeffding as H
from flowstream.functions.partitions import collusive_displacement
from flowstream.operators import evaluation as E
from flowstream.operators import learners as L
from flowstream.operators import ranking as R
from flowstream.operators import scoring as S
from flowstream.operators import sweeps as W
from flowstream.operators.thresholds import dspot
from flowstream.plans.experiments import anomaly_experiment, classification_experiment, drift_study
from flowstream.streaming import live as V


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 1500
    y = (rng.random(n) < 0.03).astype(int)
    x = np.where(y[:, None] == 1, rng.random((n, 3)) * 0.2 + 0.8, rng.normal(0.35, 0.06, (n, 3)))
    rows = [(int(i), int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "seq long, truth int, a double, b double, c double").cache()


FEATURES = ["a", "b", "c"]
SMALL = {"HST": {"window": 300, "trees": 15}, "OIF": {"window": 300, "trees": 15}, "RRCF": {"tree_size": 250, "trees": 8},
         "AIF": {"window": 200, "trees": 12, "m_trees": 4}, "AE": {"hidden": 1, "learning_rate": 0.05}}


@pytest.mark.parametrize("short", ["HST", "OIF", "RRCF", "AIF"])
def test_window_scorers_find_planted_rows(planted, short):
    scorer = next(iter(S.scorers([short], SMALL).values()))
    got = S.window_scores(planted, FEATURES, scorer, keep=["truth"])
    assert got.count() == 1500 and got.select("seq").distinct().count() == 1500
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1
    assert got.filter("score is null").count() == scorer.window
    assert E.auc(got.filter("score is not null")).first()["auc"] > 0.95
    again = S.window_scores(planted.repartition(7), FEATURES, scorer).orderBy("seq").collect()
    assert [r["score"] for r in again] == [r["score"] for r in got.orderBy("seq").collect()]


def test_frozen_runs(planted):
    for short in ("AE", "HST"):
        scorer = next(iter(S.scorers([short], SMALL).values()))
        got = S.freeze_after_warmup(planted, FEATURES, scorer, 400, keep=["truth"], block_rows=333)
        assert got.count() == 1500 and got.filter("score is null").count() == 0
        assert E.auc(got.filter("seq >= 400")).first()["auc"] > 0.9
    assert S.freeze_after_warmup(planted, FEATURES, scorer, 0).filter("score is not null").count() == 0


def test_unknown_parameter():
    with pytest.raises(TypeError):
        S.scorers(["HST"], {"HST": {"depht": 3}})
    with pytest.raises(TypeError):
        L.learners(["HT"], {"HT": {"nope": 3}})
    assert set(S.scorers()) == {"HalfSpaceTrees", "OnlineIsolationForest", "Autoencoder", "RobustRandomCutForest", "AdaptiveIsolationForest"}


def test_codisp_of_an_outlier_is_large():
    rng = np.random.default_rng(1)
    train = rng.normal(0, 1, (200, 2))
    query = np.array([[30.0, 30.0], [0.0, 0.0]])
    mean = np.mean([collusive_displacement(train, query, np.random.default_rng(s)) for s in range(20)], axis=0)
    assert mean[0] > 100 and mean[1] < 60


def test_pluggable_scorer(planted):
    class Distance:
        window, back, seed = 500, 1, 0

        def score(self, train, ages, query, rng):
            return np.abs(query - train.mean(axis=0)).sum(axis=1)

    assert E.auc(S.window_scores(planted, FEATURES, Distance(), keep=["truth"])).first()["auc"] > 0.99


def test_windows_scored_together_get_the_scores_they_get_alone(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 2)).round(1)
    x[rng.random((700, 2)) < 0.02] = np.nan
    rows = [(k, i, *(None if np.isnan(v) else float(v) for v in p)) for k in ("u", None) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, seq long, a double, b double")
    small = {"HST": {"window": 90, "trees": 4}, "OIF": {"window": 90, "trees": 4, "max_leaf": 4}, "RRCF": {"tree_size": 90, "trees": 3}}
    for scorer in S.scorers(list(small), small).values():
        got = {(r["k"], r["seq"]): r["score"] for r in S.window_scores(df, ["a", "b"], scorer, keys="k").collect()}
        assert len(got) == 1400
        for k in ("u", None):
            for w in range(8):
                here = range(90 * w, min(90 * w + 90, 700))
                alone = [None] * len(here)
                if w:
                    alone = list(scorer.score(x[90 * w - 90:90 * w], np.ones(90, int), x[here], S._rng(scorer.seed, *S._plain((k, w)))))
                assert [got[k, i] for i in here] == alone


def test_scorers_see_many_windows_in_one_call(spark):
    class Together:
        window, back, seed = 10, 2, 0

        def score_windows(self, trains, ages, queries, rngs):
            return [np.full(len(q), 1000.0 * len(trains) + 100 * a.max() + t[0, 0]) for t, a, q in zip(trains, ages, queries)]

    df = spark.range(40).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("a"))
    got = [r["score"] for r in S.window_scores(df, ["a"], Together()).orderBy("seq").collect()]
    # three windows in one call; each learns from the latest window first
    assert got == [None] * 10 + [3100.0] * 10 + [3210.0] * 10 + [3220.0] * 10


def test_forests_of_many_equal_rows_grow_on_counts(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    a, b, c = rng.integers(0, 2, n), rng.integers(0, 2, n), np.where(rng.random(n) < 0.9, 0.0, rng.random(n))
    y = np.where((a > 0) & (rng.random(n) < 0.5), 1, np.where(c > 0, 2, 0))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c, "y": y}))
    vectors = R._vectors(df, ["a", "b", "c"], "y", 4, 1)
    rows = vectors.collect()
    assert len(rows) < n / 50 and abs(sum(r["w3"] for r in rows) - n) < 6 * n**0.5
    got, plain = R.rf_importances(df, ["a", "b", "c"], "y", trees=4, depth=3), dict(R._importances(R._assembled(R._flat(df, ["a", "b", "c"], "y")), ["a", "b", "c"], 4, 42, 3))
    assert [f for f, _ in got][2] == "b" and abs(sum(v for _, v in got) - 1) < 1e-9
    assert all(abs(v - plain[f]) < 0.25 for f, v in got)
    ranked = {(r["class"], r["rank"]): r["feature"] for r in R.ovr_feature_importance(df, ["a", "b", "c"], "y", ["x", "big", "rare"], 1, trees=2, depth=3).collect()}
    assert (ranked["big", 0], ranked["rare", 0]) == ("a", "c")


def test_forests_refuse_missing_values_also_on_counts(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(float(i % 3), i % 2) for i in range(500)] + [(bad, 1)], "a double, y int")
        with pytest.raises(Exception, match="(?i)null|nan"):
            R.rf_importances(df, ["a"], "y", trees=2, depth=2)


def test_experiment_tables(planted):
    df = planted.withColumnRenamed("truth", "class_idx")
    for mode in ("fixed", "dspot", "frozen"):
        run = anomaly_experiment(df, FEATURES, S.scorers(["HST", "AE"], SMALL), 300, 300, mode, 0.6, target=1,
                                 dspot={"q": 0.02, "depth": 20, "t_quantile": 0.9})
        assert {r["algorithm"] for r in run.report.collect()} == {"HalfSpaceTrees", "Autoencoder"}
        assert run.scores.count() == 3000
        assert {r["at_seq"] for r in run.history.collect()} <= {300, 600, 900, 1200}
    assert run.regions.agg(F.sum("n")).first()[0] == df.filter("class_idx = 1").count()
    assert run.smoothed().count() == 3000


def test_grids(spark, planted):
    assert len(W.parameter_grid(W.SPACES["AIF"])) == 8 * 16
    assert W.parameter_grid(W.SPACES["ARF"], 5) == W.parameter_grid(W.SPACES["ARF"], 5)
    assert W.axis_values((0.05, 0.95, 0.05))[-1] == 0.95
    g = W.experiment_grid(spark, category=["x", "y"], size=[25, 250, 500])
    assert [tuple(r) for r in g.orderBy("idx").collect()][3] == (3, "y", "25")
    got = W.scorer_sweep(planted, FEATURES, "HST", [{"window": 300, "trees": 10}, {"window": 500, "trees": 10}], [0.4, 0.6, 0.8])
    assert {r["trial"] for r in got.collect()} == {0, 1}
    assert W.best_params(got).count() == 1


@pytest.fixture(scope="module")
def concept(spark):
    rng = np.random.default_rng(4)
    x = rng.random((6000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(int)
    rows = [(int(i), int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "seq long, class_idx int, a double, b double, c double").cache()


def test_learners_learn(concept):
    configured = L.learners(overrides={"LB": {"members": 4}, "ARF": {"members": 4}})
    preds = L.prequential_classify(concept, FEATURES, configured, 1000, 2, block_rows=700)
    assert preds.count() == 4 * 6000
    acc = {r["learner"]: r["accuracy"] for r in E.cumulative_accuracy(preds.filter("seq >= 2000")).collect()}
    majority = 100 - concept.agg(F.avg("class_idx")).first()[0] * 100
    assert all(a > majority + 15 for a in acc.values()), acc
    # the first window is predicted by empty trees
    assert preds.filter("seq < 1000 and pred <> 0").count() == 0


def test_adaptive_learners_recover(concept):
    turned = concept.withColumn("class_idx", F.when(F.col("seq") < 3000, F.col("class_idx")).otherwise(1 - F.col("class_idx")))
    configured = L.learners(["HT", "HAT", "LB", "ARF"], {"LB": {"members": 3}, "ARF": {"members": 3}})
    preds = L.prequential_classify(turned, FEATURES, configured, 300, 2)
    acc = {r["learner"]: r["accuracy"] for r in E.cumulative_accuracy(preds.filter("seq >= 4500")).collect()}
    assert acc["HoeffdingAdaptiveTree"] > 75 and acc["LeveragingBagging"] > 75 and acc["AdaptiveRandomForest"] > 75, acc


@pytest.mark.parametrize("segment_rows", [1_000_000, 900])
def test_keyed_learners_equal_single_streams(concept, monkeypatch, segment_rows):
    """Trees per stream, also over several segments, predict as a run over that stream alone; a null key is a stream."""
    monkeypatch.setattr(L, "SEGMENT_ROWS", segment_rows)
    # whole numbers, so that sums do not depend on their order
    rows = concept.withColumns({c: F.round(F.col(c) * 1000) for c in FEATURES})
    rows = rows.select(F.when(F.col("seq") % 3 == 0, "x").alias("stream_id"), F.expr("seq div 3").alias("seq"), "class_idx", *FEATURES).filter("stream_id = 'x' or seq % 2 = 1")
    rows = rows.filter("stream_id = 'x'").unionByName(rows.filter("stream_id is null").dropDuplicates(["seq"]).withColumn("seq", F.expr("seq div 2")))
    configured = L.learners(["HT", "HAT", "LB"], {"LB": {"members": 2}})
    keyed = L.prequential_classify(rows, FEATURES, configured, 300, 2, keys="stream_id")
    for name in ("x", None):
        alone = L.prequential_classify(rows.filter(F.col("stream_id").eqNullSafe(F.lit(name))), FEATURES, configured, 300, 2)
        got = keyed.filter(F.col("stream_id").eqNullSafe(F.lit(name))).select(*alone.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.collect()))


def test_experiments_by_stream(concept):
    rows = concept.select((F.col("seq") % 2).alias("stream_id"), F.expr("seq div 2").alias("seq"), "class_idx", *FEATURES)
    run = classification_experiment(rows, FEATURES, L.learners(["HT"]), 1000, 300, 2, warmup=300, keys="stream_id")
    assert {r["stream_id"] for r in run.report.collect()} == {0, 1}
    assert run.predictions.count() == 6000 and run.accuracy.count() == 2
    turned = rows.withColumn("class_idx", F.when(F.col("seq") < 1500, F.col("class_idx")).otherwise(1 - F.col("class_idx")))
    study = drift_study(turned, FEATURES, L.hoeffding_adaptive_tree(), 1000, 100, 2, keys="stream_id")
    assert study.windows.count() == 6
    assert {r["stream_id"] for r in study.detections.filter("seq >= 1500").collect()} == {0, 1}


def _shares(tmp_path, spark, name, wheres):
    """Folders with the rows of the smallest table for which each condition holds."""
    src = os.path.join(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), f"{name}.parquet")
    if not os.path.exists(src):
        pytest.skip("test data not present")
    for i, where in enumerate(wheres):
        spark.read.parquet(src).filter(where).write.parquet(str(tmp_path / str(i) / f"{name}.parquet"))
    return [str(tmp_path / str(i)) for i in range(len(wheres))]


@pytest.mark.parametrize("query", [learned.classifier_grid, learned.drift_report])
def test_more_suppliers_do_not_change_a_suppliers_trees(spark, tmp_path, query):
    small, large = _shares(tmp_path, spark, "lineitem", ["l_suppkey = 1", "l_suppkey <= 3"])
    alone, beside = query(spark, small).collect(), query(spark, large).filter("l_suppkey = 1").collect()
    assert alone and sorted(map(repr, alone)) == sorted(map(repr, beside))


def test_drift_report_holds_both_detectors(spark, tmp_path):
    folder, = _shares(tmp_path, spark, "lineitem", ["l_suppkey <= 4"])
    got = learned.drift_report(spark, folder).collect()
    windows, found = ([r for r in got if r["kind"] == kind] for kind in ("window", "detection"))
    assert {r["l_suppkey"] for r in windows} == {0, 1, 2, 3, 4} and len(windows) + len(found) == len(got)
    assert {r["detector"] for r in found} == {"DDM", "ADWIN"} and all(r["seq"] >= 0 and r["window_id"] is None for r in found)


def test_later_rows_do_not_change_earlier_predictions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(learned, "WIDE_ROWS", 30, raising=False)
    small, large = _shares(tmp_path, spark, "embeddings", ["vec_id < 70", "vec_id < 100"])
    before = {tuple(r) for r in learned.embedding_classes(spark, small).collect()}
    after = {tuple(r) for r in learned.embedding_classes(spark, large).filter("seq < 70").collect()}
    assert len(before) == 70 and before == after


def test_counts_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    x, y, w = rng.random((400, 3)), rng.integers(0, 2, 400), rng.integers(0, 4, 400).astype(float)
    tree = H.Split(0, 0.5, H.Leaf(2, 3), H.Split(2, 0.4, H.Leaf(2, 3), H.Leaf(2, 3)))
    whole = L._merge([{"main": H.count(tree, x, y, w, 2, "nba")}])["main"]
    parts = L._merge([{"main": H.count(tree, x[i:i + 90], y[i:i + 90], w[i:i + 90], 2, "nba")} for i in range(0, 400, 90)])["main"]
    assert set(whole) == {"l", "rl", "rr"} == set(parts)
    for p in whole:
        assert np.allclose(whole[p].n, parts[p].n) and np.allclose(whole[p].s2, parts[p].s2) and np.array_equal(whole[p].hi, parts[p].hi)


def test_poisson_weights():
    w = L._weights(L.leveraging_bagging(), 3, np.arange(20_000))
    assert w.mean() == pytest.approx(6, abs=0.15) and w.var() == pytest.approx(6, abs=0.4)
    assert np.array_equal(w[100:200], L._weights(L.leveraging_bagging(), 3, np.arange(100, 200)))


def test_classifier_sweep(concept):
    got = L.classifier_sweep(concept, FEATURES, "HT", [{"grace": 100}, {"leaf": "majority", "criterion": "gini"}], 1500, 2).collect()
    assert sorted(r["trial"] for r in got) == [0, 1] and all(r["f1"] > 50 for r in got)


@pytest.mark.parametrize("chunks", [1, 5])
def test_live_dspot_equals_batch(spark, planted, chunks):
    s = planted.select((F.col("seq") % 3).cast("string").alias("stream_id"), F.expr("seq div 3").alias("seq"),
                       F.timestamp_seconds(F.col("seq") * 7 + 1_700_000_000).alias("ts"), F.col("a").alias("score"))
    settings = {"q": 0.02, "depth": 15, "t_quantile": 0.9, "warmup": 60}
    batch = dspot(s, **settings).orderBy("stream_id", "seq").collect()
    path = V.replay_files(s, "ts", chunks, close_after="1 hour")
    live = V.run_to_table(V.dspot_stream(V.as_stream(spark, path), delay="10 minutes", **settings), "t")
    assert live.drop("ts").select(*batch[0].asDict()).orderBy("stream_id", "seq").collect() == batch


@pytest.mark.parametrize("scorer", [S.HalfSpaceTrees(window=200, trees=8), S.AdaptiveIsolationForest(window=100, trees=10, m_trees=3)])
def test_live_scores_equal_batch(spark, planted, scorer):
    rows = planted.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    batch = S.window_scores(planted, FEATURES, scorer).orderBy("seq").collect()
    live = V.score_stream(V.as_stream(spark, V.replay_files(rows, "ts", 4)), FEATURES, scorer).orderBy("seq").collect()
    assert [(r["seq"], r["score"]) for r in live] == [(r["seq"], r["score"]) for r in batch]


def test_trees_live_until_they_are_replaced(spark, planted):
    """30 of 100 trees are grown a window, and those of age 2 are the ones of age 1 in the window before."""
    from flowstream.functions.partitions import Trees

    scorer = S.AdaptiveIsolationForest(window=100, trees=100, m_trees=30)
    models = {r["window"]: bytes(r["model"]) for r in S.window_models(planted, FEATURES, scorer).collect()}
    assert {w: Trees.unpacked(m).trees for w, m in models.items()} == {w: 100 if w == 0 else 30 for w in range(15)}
    assert models == {r["window"]: bytes(r["model"]) for r in S.window_models(planted.repartition(9), FEATURES, scorer).collect()}

    def forest(w):
        return {(w - age, i) for age in range(1, scorer.back + 1) if w - age in models for i in range(min(Trees.unpacked(models[w - age]).trees, scorer.alive(age)))}

    for w in range(2, 15):
        assert len(forest(w)) == 100
        assert {t for t in forest(w) if t[0] < w - 1} <= forest(w - 1)  # nothing is grown anew
        assert len([t for t in forest(w) if t[0] == w - 1]) == 30
    x = {r["seq"]: [r[c] for c in FEATURES] for r in planted.collect()}
    got = {r["seq"]: r["score"] for r in S.window_scores(planted, FEATURES, scorer).collect()}
    for w in (1, 2, 7, 8, 14):  # runs of windows begin at 8
        mine = range(100 * w, 100 * w + 100)
        want = scorer.rate([(a, models[w - a]) for a in range(1, 5) if w - a in models], np.array([x[i] for i in mine]))
        assert [got[i] for i in mine] == want.tolist()


def test_packed_trees_equal_a_plain_walk():
    from flowstream.functions.partitions import Trees, grow_trees

    rng = np.random.default_rng(6)
    train = np.round(rng.random((120, 3)), 1)  # many ties, one leaf with equal rows
    grown = grow_trees(train, 7, np.random.default_rng(1), 6)
    again = Trees.unpacked(grown.packed())
    query = rng.random((50, 3)) * 2 - 0.5
    depth, size = again.depths(query, 7)
    rank = np.cumsum(grown.inner) - 1

    def walk(x, node):
        level = 0
        while grown.inner[node]:
            i = rank[node]
            node, level = grown.trees + 2 * i + int(x[grown.feature[i]] > grown.cut[i]), level + 1
        return level, node

    for t in range(7):
        ends = [walk(x, t)[1] for x in train]
        for q, x in enumerate(query):
            level, node = walk(x, t)
            assert (depth[t, q], size[t, q]) == (level, ends.count(node)) and level <= 6 and ends.count(node) > 0
    same = grow_trees(np.ones((5, 2)), 2, np.random.default_rng(1), 6)
    assert not same.inner.any() and same.size.tolist() == [5, 5]
    one = Trees.unpacked(grow_trees(np.ones((1, 2)), 3, np.random.default_rng(1), 6).packed())
    assert one.depths(np.zeros((2, 2)), 2)[1].tolist() == [[1, 1], [1, 1]]


def plain_cut(history, delta):
    """ADWIN's cut on a plain list of (rows, errors): (oldest entries to forget, difference of the rates, its bound) of every cut."""
    n, e = np.array(history).T
    rows, errors = n.sum(), e.sum()
    log_term = np.log(2 * np.log(max(rows, 3)) / delta)
    n0, e0 = np.cumsum(n)[:-1], np.cumsum(e)[:-1]
    m = 1 / n0 + 1 / (rows - n0)
    p = errors / rows
    return (errors - e0) / (rows - n0) - e0 / n0, np.sqrt(2 * m * p * (1 - p) * log_term) + 2 / 3 * log_term * m


def test_compressed_history_stays_small():
    h = H.RateHistory()
    for i in range(1_000_000):
        h.add(100.0, 10.0 + i % 2)
    assert len(h) <= 5 * 21 and h.rows == 1e8 and h.errors == 1_000_000 * 10.5
    assert h.changed(0.002) == 0


@pytest.mark.parametrize("after", [0.12, 0.2, 0.4])
def test_compressed_history_finds_what_a_plain_list_finds(after):
    rng = np.random.default_rng(12)
    h, plain, found, expected = H.RateHistory(), [], None, None
    for w in range(1200):
        e = float(rng.binomial(100, 0.1 if w < 700 else after))
        h.add(100.0, e)
        plain.append((100.0, e))
        if w:
            gap, eps = plain_cut(plain, 0.002)
            if expected is None and (gap > eps).any():
                expected = w
            cut = h.changed(0.002)
            if found is None and cut:
                found = w
                # the cut is one of the plain list's, at the same bound
                places = np.cumsum([2**r for r in range(len(h.levels) - 1, -1, -1) for _ in h.levels[r]])
                place = places[cut - 1]
                assert gap[place - 1] > eps[place - 1]
                h.forget(cut)
                assert h.rows == pytest.approx(100.0 * (w + 1 - place)) and h.errors == pytest.approx(sum(x for _, x in plain[place:]))
                break
    assert expected is not None and expected >= 700
    assert expected <= found <= expected + 8


def test_short_histories_are_kept_in_full():
    h = H.RateHistory()
    for i in range(5):
        h.add(10.0, float(i))
    assert h.levels == [[(10.0, float(i)) for i in range(5)]]
    assert len(h.forget(2)) == 3 and h.rows == 30 and h.errors == 9
    assert len(h.forget(3)) == 0 and h.changed(0.1) == 0


@pytest.mark.parametrize("scorer", [S.HalfSpaceTrees(window=100, trees=6), S.AdaptiveIsolationForest(window=50, trees=9, m_trees=3)])
def test_live_scores_of_a_resumed_run_equal_batch(spark, planted, scorer, tmp_path):
    """Three streams of unlike pace, one with a null key; the run is stopped after half of the input."""
    key = F.when(F.col("seq") < 300, "early").when(F.col("seq") % 3 > 0, "fast")
    rows = planted.withColumn("k", key).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("seq")).cast("long") - 1)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows.filter("ts < timestamp_seconds(1700000700)"), rows.filter("ts >= timestamp_seconds(1700000700)")):
        V.replay_files(part, "ts", 4, path=folder)
        got = V.score_stream(V.as_stream(spark, folder), FEATURES, scorer, keys=["k"], path=out, checkpoint=state)
    want = S.window_scores(rows, FEATURES, scorer, keys=["k"])
    assert sorted(map(repr, got.select("k", "seq", "score").collect())) == sorted(map(repr, want.select("k", "seq", "score").collect()))
    carried = spark.read.parquet(f"{out}/carried/epoch=7").groupBy("k").agg(F.countDistinct("_w").alias("n")).collect()
    assert {r["k"] for r in carried} == {"early", "fast", None} and all(r["n"] <= scorer.back + 1 for r in carried)
    assert len(list((tmp_path / "out" / "carried").iterdir())) == 2


@pytest.mark.parametrize("short,grid", [("HST", [{"window": 100, "trees": 5}, {"window": 170, "trees": 4, "depth": 4}]), ("RRCF", [{"tree_size": 90, "trees": 2}, {"tree_size": 60, "trees": 3}]),
                                        ("AIF", [{"window": 50, "trees": 9, "m_trees": 3}, {"window": 64, "trees": 5, "m_trees": 2}])])
@pytest.mark.parametrize("mode", ["independent", "shared"])
def test_sweep_over_one_shuffle_equals_trials_alone(planted, short, grid, mode):
    rows = planted.withColumn("k", F.when(F.col("seq") < 1460, "long").otherwise("short"))
    rows = rows.withColumn("seq", F.when(F.col("k") == "short", F.col("seq") - 1460).otherwise(F.col("seq")))
    levels = [0.3, 0.5, 0.6, 0.9]
    got = {(r["k"], r["trial"]): r for r in W.scorer_sweep(rows, FEATURES, short, grid, levels, 120, keys=["k"], threshold_mode=mode).collect()}
    for i, params in enumerate(grid):
        scorer = next(iter(S.scorers([short], {short: params}).values()))
        skip = scorer.window if short == "HST" else 120
        mine = [scorer.anomaly_threshold] if mode == "shared" and short == "HST" else levels
        swept = E.threshold_sweep(E.exclude_warmup(S.window_scores(rows, FEATURES, scorer, ["k"], keep=["truth"]), skip, ["k"]), mine, by=["k"])
        for k in ("long", "short"):
            best = max((r for r in swept.collect() if r["k"] == k), key=lambda r: (r["f1"], -r["threshold"]))
            r = got.pop((k, i))
            assert (r["f1"], r["precision"], r["recall"], r["threshold"]) == (best["f1"], best["precision"], best["recall"], best["threshold"])
            assert r["seconds"] > 0 and r["params"].startswith(next(iter(params)))
    assert not got


def test_counting_also_predicts():
    """Rows are routed once: the counts of a window and the tree's prediction of every row come together."""
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(600, 3))
    y = (x[:, 0] > 0.5).astype(int)
    root, cfg = H.Leaf(2, 3), L.hoeffding_tree(grace=50)
    for w in range(6):
        part = slice(100 * w, 100 * w + 100)
        before = H.predict(root, x[part], cfg.leaf, cfg.nb_threshold)
        preds = np.full(100, -1)
        got = H.count(root, x[part], y[part], np.ones(100), 2, cfg.leaf, cfg.nb_threshold, preds=preds)
        assert preds.tolist() == before.tolist() and sum(c.errors for c in got.values()) == (before != y[part]).sum()
        root = L._grow(root, got, cfg, 0, w)
    assert isinstance(root, H.Split)


def test_splits_look_at_all_features_at_once(monkeypatch):
    leaf = H.Leaf(3, 4)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(900, 4)), rng.integers(0, 3, 900)
    x[:, 2] += 2 * y
    x[:, 3] = 1.0
    c = H.count(leaf, x, y, np.ones(900), 3, "nba")[""]
    leaf.n, leaf.s1, leaf.s2, leaf.lo, leaf.hi = c.n, c.s1, c.s2, c.lo, c.hi
    calls = []
    plain = H._merit
    monkeypatch.setattr(H, "_merit", lambda *a: calls.append(1) or plain(*a))
    for criterion in ("infogain", "gini", "hellinger"):
        got = H.try_split(leaf, np.arange(4), criterion, 0.01, 0.05)
        best = []
        for f in range(3):  # the fourth is constant
            lo, hi = leaf.lo[:, f].min(), leaf.hi[:, f].max()
            mean = leaf.s1[:, f] / leaf.n
            sd = np.sqrt(leaf.s2[:, f] / leaf.n - mean**2)
            for cut in lo + (hi - lo) * np.arange(1, 11) / 11:
                left = leaf.n * 0.5 * (1 + H._erf((cut - mean) / (sd * np.sqrt(2))))
                best.append((float(plain(left, leaf.n - left, criterion)), -f, cut))
        assert isinstance(got, H.Split) and (got.feature, got.cut) == (-max(best)[1], pytest.approx(max(best)[2]))
    assert len(calls) == 3


def test_trees_counted_together():
    """A window's rows are counted into many trees in one go, with the counts and predictions of one tree after the other."""
    rng = np.random.default_rng(8)
    x, y = rng.uniform(size=(300, 3)), rng.integers(0, 3, 300)
    x[5, 1], every, grown, old = np.nan, np.arange(300), [], np.arange(200)
    for i, kind in enumerate(["nba", "nb", "majority", "nba", "nb", "nba", "nba"]):
        root, w = H.Leaf(3, 3), rng.poisson(0.7 * i, 300).astype(float)
        for window in range(i):
            root = L._grow(root, H.count(root, x[old], (x[old, 0] * 3).astype(int) if window % 2 else y[old], w[old] + 1, 3, kind), L.hoeffding_tree(grace=20, tie=2.0), i, window)
        grown.append((root, every if i != 4 else every[::3], w, kind, 0))
    got, preds = H.count_together(grown, x, y, 3)
    assert max(len(c) for c in got) > 2
    for (root, rows, w, kind, nb), counts, pred in zip(grown, got, preds):
        own = np.zeros(len(rows), dtype=np.int64)
        plain = H.count(root, x[rows], y[rows], w[rows], 3, kind, nb, preds=own)
        assert list(counts) == list(plain) and pred[rows].tolist() == own.tolist()
        for path, c in plain.items():
            for name in ("n", "s1", "s2", "lo", "hi", "majority_ok", "bayes_ok", "rows", "errors"):
                np.testing.assert_array_equal(getattr(counts[path], name), getattr(c, name))
    # a class the trees don't know is counted as it is tree by tree
    odd = np.where(every == 7, -1, y)
    assert H.count_together(grown, x, odd, 3)[0][0][""].n.sum() == H.count(grown[0][0], x, odd, grown[0][2], 3, "nba")[""].n.sum()


def test_splits_of_a_window_are_looked_for_once(monkeypatch):
    """The leaves of all members of all learners with one criterion share one look at their cuts."""
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(200, 3))
    y, seq = (x[:, 0] > 0.5).astype(int), np.arange(200)
    calls, plain = [], H.best_cuts
    monkeypatch.setattr(H, "best_cuts", lambda leaves, picks, criterion: calls.append(len(leaves)) or plain(leaves, picks, criterion))
    configured = L.learners(["LB", "ARF", "HT"], {"LB": {"members": 4}, "ARF": {"members": 3, "max_leaves": 2}, "HT": {"grace": 50}})
    members = {(name, i): (cfg, H.Member(H.Leaf(2, 3))) for name, cfg in configured.items() for i in range(cfg.members)}
    for window in range(4):
        calls.clear()
        got, _ = L._count_members(members, seq, x, y, 2)
        learned = L._learn([(cfg, m, g, key[1]) for (key, (cfg, m)), g in zip(members.items(), got)], window, 2, 3)
        assert len(calls) == 1 and calls[0] >= 5
        members = {key: (cfg, m) for (key, (cfg, _)), m in zip(members.items(), learned)}
    sizes = {name: [len(H.leaves(m.root)) for (n, _), (_, m) in members.items() if n == name] for name in configured}
    assert all(s > 1 for mine in sizes.values() for s in mine) and max(sizes["AdaptiveRandomForest"]) == 2


def test_scorer_facts_score_once(spark, tmp_path):
    """Counts and areas read written scores: the result's plan holds no scorer any more."""
    events = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.col("id") % 7).alias("user_id"),
                                     F.when(F.col("id") % 50 == 3, 200.0).otherwise(F.col("id") % 11).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = facts.scorer_facts(spark, str(tmp_path))
    assert "InPandas" not in got._jdf.queryExecution().toString()
    assert {(r["algorithm"], r["n"], r["outside"]) for r in got.collect()} == {(a, 600, 0) for a in [*facts.FOREST, "Autoencoder"]}


def test_trees_of_one_long_stream_stay_off_the_driver(spark, monkeypatch):
    """Per window and tree the driver gets two numbers and a size, and a window that has no rows changes nothing."""
    rng = np.random.default_rng(6)
    a, b = rng.uniform(size=900), rng.uniform(size=900)
    rows = [(i + (300 if i >= 600 else 0), int(a[i] > 0.5) ^ (i >= 600), float(a[i]), float(b[i])) for i in range(900)]
    table = spark.createDataFrame(rows, "seq long, class_idx int, a double, b double")
    seen, plain = [], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda df: seen.append(df.columns) or plain(df))
    configured = L.learners(["LB", "HT"], {"LB": {"members": 3, "delta": 0.9}, "HT": {"grace": 50}})
    got = L.prequential_classify(table, ["a", "b"], configured, 300, 2)
    assert seen and not any("blob" in columns for columns in seen)
    monkeypatch.undo()
    alone = L.prequential_classify(table.withColumn("one", F.lit(1)), ["a", "b"], configured, 300, 2, keys="one").drop("one")
    key = ["learner", "seq"]
    assert got.orderBy(*key).select(*key, "truth", "pred").collect() == alone.orderBy(*key).select(*key, "truth", "pred").collect()


def _turning_streams(sizes, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i, n in enumerate(sizes):
        x = rng.uniform(size=(n, 3)).round(3)
        y = (x[:, i % 3] > 0.5).astype(int) ^ (np.arange(n) >= n // 2)
        out.append(pd.DataFrame({"k": i, "seq": np.arange(n) * (2 if i == 3 else 1), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "class_idx": y}))
    return out


_GROVE = {"LB": {"members": 3}, "ARF": {"members": 3, "max_features": 0.7, "warning_delta": 0.2}, "HT": {"grace": 50, "criterion": "gini", "leaf": "nb"}}


def test_streams_that_learn_together(spark, monkeypatch):
    """Streams side by side get the predictions they get one by one: of several lengths, with gaps, without some values, longer than a segment, without a key."""
    streams = _turning_streams([700, 1, 333, 400, 25, 650, 300])
    streams[5].loc[7, "a"] = np.nan
    df = spark.createDataFrame(pd.concat(streams)).withColumn("k", F.when(F.col("k") != 2, F.concat(F.lit("s"), "k"))).repartition(3)
    configured = L.learners(["LB", "ARF", "HT"], _GROVE)
    rows = lambda: L.prequential_classify(df, ["a", "b", "c"], configured, 25, 2, keys="k").orderBy("learner", "k", "seq").collect()
    together = rows()
    assert len(together) == 3 * df.count()
    monkeypatch.setattr(L, "SEGMENT_ROWS", 500)
    assert rows() == together
    monkeypatch.setattr(L, "PACK_STREAMS", 0)
    assert rows() == together
    late = [r for r in together if r["k"] == "s0" and r["seq"] >= 525]
    assert np.mean([r["truth"] == r["pred"] for r in late]) > 0.6


def test_calls_of_a_window_do_not_grow_with_the_streams(monkeypatch):
    from flowstream.functions import groves

    streams, calls, plain = _turning_streams([200] * 60), [], groves.cut_gains
    monkeypatch.setattr(groves, "cut_gains", lambda *a: calls.append(1) or plain(*a))
    configured = L.learners(["LB", "ARF", "HT"], _GROVE)
    got = L._learn_together(streams, ["a", "b", "c"], configured, 25, 2, "seq", "class_idx", ["k", "seq"])
    assert len(got) == 3 * 60 * 200 and len(calls) <= 16 * 2  # windows (16 in the stream with gaps) and criteria
    few = L._learn_together(streams[40:43], ["a", "b", "c"], configured, 25, 2, "seq", "class_idx", ["k", "seq"])
    both = got[got["k"].between(40, 42)].reset_index(drop=True)
    pd.testing.assert_frame_equal(both, few)


def test_error_histories_in_arrays():
    from flowstream.functions.groves import Histories

    rng = np.random.default_rng(4)
    plain, held = [H.RateHistory() for _ in range(6)], Histories(6)
    forgotten = 0
    for w in range(300):
        some = np.nonzero(rng.uniform(size=6) < 0.8)[0]
        n, e = rng.integers(1, 30, len(some)).astype(float), np.zeros(len(some))
        e[:] = rng.binomial(n.astype(int), np.where((w // 60) % 2, 0.5, 0.1))
        held.add(some, n, e)
        deltas = rng.choice([0.002, 0.2], len(some))
        old = held.changed(some, deltas)
        for i, a, b, d, o in zip(some.tolist(), n.tolist(), e.tolist(), deltas.tolist(), old.tolist()):
            plain[i].add(a, b)
            assert plain[i].changed(d) == o
            if o:
                plain[i].forget(o)
                held.forget(i, o)
                forgotten += 1
    assert forgotten > 5
