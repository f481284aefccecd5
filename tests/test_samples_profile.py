"""Samples, scenario slices, statistics and feature selection."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowstream.operators import profile as P
from flowstream.operators import sampling as S
from flowstream.plans.preparation import apply_prepared, prepare
from flowstream.plans.scenarios import build_scenario


def rank(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_random_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(3000)
    expect = sorted(sorted(range(3000), key=rank)[:137])
    for parts in (1, 9):
        assert sorted(r[0] for r in S.random_sample(df.repartition(parts), 137, ["id"]).collect()) == expect
    assert S.random_sample(df, 5000, ["id"]).count() == 3000


def test_balanced_sample_with_a_hot_class(spark):
    df = spark.range(4000).withColumn("Label", F.when(F.col("id") < 3500, "hot").when(F.col("id") < 3990, " mid").otherwise("rare"))
    with pytest.raises(S.QuotaError, match="rare"):
        S.balanced_sample(df, 50, ["id"])
    got = S.balanced_sample(df, 50, ["id"], allow_insufficient=True)
    assert dict(got.groupBy(F.trim("Label")).count().collect()) == {"hot": 50, "mid": 50, "rare": 10}
    assert S.balanced_sample(df, 50, ["id"], ignored=["rare"]).count() == 100


@pytest.mark.parametrize("sizes, n, quotas", [((1, 3, 4), 4, {1: 2, 2: 2}), ((1, 1, 2, 5), 4, {2: 1, 3: 2})])
def test_stratified_quota_rounds_half_to_even(spark, sizes, n, quotas):
    rows = [(100 * k + i, k) for k, size in enumerate(sizes) for i in range(size)] + [(999, None)] * (len(sizes) == 3) * 0
    df = spark.createDataFrame(rows, "id long, `Destination Port` int")
    got = S.stratified_sample(df, n, ["id"])
    assert got.count() == n and got.distinct().count() == n
    per = dict(got.groupBy("Destination Port").count().collect())
    assert all(per.get(k, 0) >= q for k, q in quotas.items())


def test_stratified_null_keys_and_noop(spark):
    df = spark.createDataFrame([(i, None if i < 50 else 1) for i in range(100)], "id long, proto int")
    assert S.stratified_sample(df, None, ["id"]).count() == 100
    assert S.stratified_sample(df, 100, ["id"]).count() == 100
    assert S.stratified_sample(df, 20, ["id"], "proto").count() == 20


def cursor_rows(spark):
    labs = "ABBAABCABBAACBA"
    return labs, spark.createDataFrame([("f", i, lab) for i, lab in enumerate(labs)], "source_file string, seq long, Label string")


@pytest.mark.parametrize("config", [
    [("f", 3), ("f", 2, ["A"]), ("f", 2, ["B"]), ("f", 5, ["A"])],
    [("f", 2, ["B"]), ("f", 2, ["A", "B"]), ("f", 3), ("f", 9, "C"), ("f", 4, ["A", "C"])],
    [("f", 100), ("f", 1, "A")],
    [("f", 1, "Z"), ("g", 3), ("f", 2, ["A", "Z"])],
])
def test_blocks_share_a_cursor(spark, config):
    labs, df = cursor_rows(spark)
    left, expect = list(range(len(labs))), []
    for item in config:
        want = None if len(item) < 3 else ([item[2]] if isinstance(item[2], str) else item[2])
        mine = [i for i in left if item[0] == "f" and (want is None or labs[i] in want)][:item[1]]
        left = [i for i in left if i not in mine]
        if mine:
            expect.append(mine)
    out, sizes = S.take_blocks(df, config, block_rows=4)
    got = {}
    for r in out.collect():
        got.setdefault(r["block"], []).append(r["seq"])
    assert [sorted(got[b]) for b in sorted(got)] == expect
    assert sizes == [len(e) for e in expect]


def test_scenario_order_and_resort(spark):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "BENIGN" if i % 4 else "syn", "f") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, Timestamp string, Label string, source_file string").withColumn("Timestamp", F.to_timestamp("Timestamp"))
    out = build_scenario(df, [("f", 3, "syn"), ("f", 2, ["syn"])], ["id"], sort_by_timestamp=False)
    labs = [r["Label"] for r in out.orderBy("position").collect()]
    assert labs == ["BENIGN"] * 10 + ["syn"] * 3 + ["BENIGN"] * 10 + ["syn"] * 2 + ["BENIGN"] * 10
    out = build_scenario(df, [("f", 3, "syn")], ["id"], n_benign=12).orderBy("position").collect()
    assert [r["Timestamp"] for r in out] == sorted(r["Timestamp"] for r in out) and len(out) == 15


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_quantiles_beyond_the_exact_limit(spark, kind):
    rng = np.random.default_rng(1)
    v = {"normal": rng.normal(size=6000), "ties": rng.integers(0, 3, 6000).astype(float), "heavy": rng.pareto(0.5, 6000)}[kind]
    df = spark.createDataFrame([(float(x) if i % 50 else None,) for i, x in enumerate(v)], "x double").repartition(5)
    clean = np.array([x for i, x in enumerate(v) if i % 50])
    ps = [0.0, 0.013, 0.25, 0.5, 0.98, 1.0]
    got = P.exact_quantiles(df, ["x"], ps, exact_values=0, gather_values=600)["x"]
    assert got == pytest.approx(list(np.quantile(clean, ps)), rel=1e-12)


def test_quantiles_at_the_border_of_two_frequent_values(spark):
    """The bracket of a rank between two frequent values must still shrink."""
    df = spark.createDataFrame([(0.0,)] * 3000 + [(1.0,)] * 3000, "x double").repartition(3)
    assert P.exact_quantiles(df, ["x"], [0.25, 0.5, 0.98], exact_values=0, gather_values=60)["x"] == [0.0, 0.5, 1.0]


def test_robust_scale_of_many_columns_shares_its_passes(spark):
    """Outliers and infinities cost no passes of their own, and the passes do not grow with columns or ranks."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4001, 3))
    v[:5, 0], v[:7, 1], v[7:9, 1] = 1e300, np.inf, -np.inf
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "a double, b double, c double").repartition(3)
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    try:
        got = P.exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75], exact_values=0, gather_values=9000)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    s = np.sort(v, axis=0)
    assert [got[c] for c in "abc"] == [s[[1000, 2000, 3000], i].tolist() for i in range(3)] and jobs < 40


def test_impute_and_scale_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (None, 5.0, None), (1.0, 5.0, None), (2.0, 5.0, None), (2.0, 5.0, None)], "a double, c double, e double")
    assert P.fit_impute(df, ["a", "e"], "moda") == {"a": 1.0, "e": None}
    assert P.fit_impute(df, ["a"], "mediana") == {"a": 1.5}
    assert P.fit_impute(df, ["a"], "what") == {"a": 0.0}
    for method in ("MinMaxScaler", "StandardScaler", "RobustScaler"):
        assert {r["c"] for r in P.scale(df, ["c"], method).collect()} == {0.0}
    zero_iqr = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (0.0,), (9.0,)], "x double")
    assert sorted(r[0] for r in P.scale(zero_iqr, ["x"], "RobustScaler").collect()) == [0.0] * 4 + [9.0]
    with pytest.raises(ValueError):
        P.drop_low_variance(df, ["c"], 0.0)


@pytest.mark.parametrize("jvm_columns", [1, 10])
def test_correlation_with_nulls_and_constants(spark, jvm_columns):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    rows = [(float(a), float(2 * a + 1 + 0.01 * b), float(c) if i % 4 else None, 0.1) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(p, q): r for p, q, r in P.correlation_pairs(df, ["a", "b", "c", "k"], jvm_columns)}
    keep = np.arange(300) % 4 != 0
    assert got[("a", "b")] == pytest.approx(abs(np.corrcoef(x[:, 0], 2 * x[:, 0] + 0.01 * x[:, 1])[0, 1]), rel=1e-9)
    assert got[("a", "c")] == pytest.approx(abs(np.corrcoef(x[keep, 0], x[keep, 2])[0, 1]), rel=1e-9)
    assert got[("a", "k")] is None
    assert P.drop_correlated(df, ["a", "b", "c", "k"], 0.9) == ["a", "c", "k"]


def test_label_dictionary_and_lookup(spark):
    df = spark.createDataFrame([(0, "Syn"), (1, " normal"), (2, "Benign"), (3, "UDP"), (4, None)], "seq long, Label string")
    d = P.label_dictionary(df, "Label", "seq")
    assert [r["name"] for r in d.orderBy("idx").collect()] == ["normal", "Syn", "Benign", "UDP", "UNKNOWN"]
    assert [P.normal_class_index(spark.createDataFrame(list(enumerate(n)), "idx int, name string")) for n in (["Syn", "Benign"], ["a"])] == [1, 0]
    ids = spark.createDataFrame([(1,), (9,)], "i int")
    assert sorted(r["class_name"] for r in P.class_names(ids, d, "i").collect()) == ["Ataque 9", "Syn"]


def test_prepare_chain(spark):
    rows = [(f"2024-01-01 00:00:{i:02d}", f"id{i}", math.inf if i == 0 else float(i), None if i == 3 else float(i % 5), 7.0, " BENIGN" if i % 2 else "Syn")
            for i in range(30)]
    df = spark.createDataFrame(rows, "Timestamp string, `Flow ID` string, ` Rate` double, Bytes double, Const double, Label string")
    got = prepare(df, normalize="MinMaxScaler", imputation="mediana", threshold_var=0.0, binary=False)
    assert got.features == ["Rate", "Bytes"] and got.names == ["BENIGN", "Syn"]
    rows = got.table.orderBy("seq").collect()
    assert rows[0]["Rate"] == 1.0 and rows[0]["class_idx"] == 1 and rows[3]["Bytes"] == 0.5
    again = apply_prepared(df, got).select("Bytes").collect()
    assert max(r[0] for r in again) == 1.0


def test_quantiles_pass_over_the_rows_few_times(spark, monkeypatch):
    """One pass for sizes and extents, and one for each narrowing: two narrowings separate 20,000 values by 4,096 bins."""
    df = spark.range(20_000).select((F.col("id") * 7 % 20_000).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("b"))
    passes, first, collect = [], type(df).first, type(df).collect
    monkeypatch.setattr(type(df), "first", lambda d: passes.append("first") or first(d))
    monkeypatch.setattr(type(df), "collect", lambda d: passes.append("collect") or collect(d))
    got = P.exact_quantiles(df, ["a", "b"], [0.25, 0.5], exact_values=0)
    monkeypatch.undo()
    want = df.agg(*[F.percentile(c, [0.25, 0.5]) for c in ("a", "b")]).first()
    assert [got["a"], got["b"]] == [list(want[0]), list(want[1])]
    assert passes.count("first") == 1 and passes.count("collect") - passes.count("first") <= 3
