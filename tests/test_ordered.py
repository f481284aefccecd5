"""Row order, runs, windows, overlays, interval rules on hand fixtures and against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowstream.operators import ordering as O
from flowstream.operators import windowing as W

T0 = datetime(2024, 1, 1)


def labels(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, y int")


def regions(df, **kw):
    return sorted(tuple(r) for r in O.attack_regions(df, "y", 0, **kw).collect())


def test_seq_spreads_one_tied_value(spark):
    df = spark.range(5000).select(F.lit(7).alias("ts"), F.col("id")).repartition(7)
    got = O.with_seq(df, ["ts", "id"]).select("id", "seq").collect()
    assert all(r["id"] == r["seq"] for r in got) and len(got) == 5000


def test_seq_by_key_with_null_key(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i) for i in range(30)], "k int, t int")
    got = {}
    for r in O.with_seq(df, ["t"], by="k").orderBy("t").collect():
        assert r["seq"] == got.get(r["k"], -1) + 1
        got[r["k"]] = r["seq"]
    assert set(got.values()) == {9}


def test_regions_inclusive_and_open_end(spark):
    assert regions(labels(spark, [0, 0, 1, 1, 2, 0, 3])) == [(2, 3, 2, 1), (4, 4, 1, 2), (6, 6, 1, 3)]


@pytest.mark.parametrize("block_rows", [1, 2, 5, 64, 1000])
def test_regions_do_not_depend_on_blocks(spark, block_rows):
    rng = random.Random(3)
    ys = [rng.choice([0, 0, 0, 1, 1, 2]) if rng.random() < 0.3 else 1 for _ in range(200)]
    expect, start = [], None
    for i, y in enumerate([*ys, 0]):
        if start is not None and y != ys[start]:
            expect.append((start, i - 1, i - start, ys[start]))
            start = None
        if start is None and y != 0 and i < len(ys):
            start = i
    assert regions(labels(spark, ys), block_rows=block_rows) == sorted(expect)


def test_moving_averages_across_blocks(spark):
    df = spark.createDataFrame([(i, float(i + 1) if i != 4 else None) for i in range(20)], "seq long, v double")
    vals = [i + 1.0 if i != 4 else None for i in range(20)]
    mean = lambda xs: sum(x for x in xs if x is not None) / sum(x is not None for x in xs)
    got = O.moving_average(df, "v", 5, block_rows=7).orderBy("seq").collect()
    assert [r["moving_average"] for r in got] == pytest.approx([mean(vals[max(0, i - 5):i + 1]) for i in range(20)])
    got = O.rolling_mean(df, "v", 3, block_rows=4).orderBy("seq").collect()
    assert [r["rolling_mean"] for r in got] == pytest.approx([mean(vals[max(0, i - 2):i + 1]) for i in range(20)])


def test_slices_and_interleave(spark):
    base = spark.createDataFrame([(i, f"b{i}") for i in range(10)], "seq long, v string")
    assert [r[0] for r in O.slice_evenly(base, 2, 10).orderBy("seq").select("slice").collect()] == [0] * 3 + [1] * 3 + [2] * 4
    attack = spark.createDataFrame([(0, 0, "x0"), (0, 1, "x1"), (1, 0, "y0")], "block int, seq long, v string")
    order = [r["v"] for r in O.interleave(base, attack, 2, 10).orderBy("position").collect()]
    assert order == ["b0", "b1", "b2", "x0", "x1", "b3", "b4", "b5", "y0", "b6", "b7", "b8", "b9"]


def flow_rows(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=s), p, b, l) for s, p, b, l in rows],
                                 "Timestamp timestamp, `Src Port` long, Bytes long, Label string")


def test_window_summary_fills_gaps(spark):
    df = flow_rows(spark, [(0, 1, 5, "b"), (0, 2, 5, "a"), (0, None, 1, None), (3, 1, 7, "N/A")])
    got = [tuple(r) for r in W.window_summary(df, freq="1 second").orderBy("Timestamp").collect()]
    assert got == [(T0, 1.0, 11, "a"), (T0 + timedelta(seconds=1), 0.0, 0, "BENIGN"), (T0 + timedelta(seconds=2), 0.0, 0, "BENIGN"),
                   (T0 + timedelta(seconds=3), 0.0, 7, "BENIGN")]


def test_gap_fill_below_a_second(spark):
    df = spark.createDataFrame([(T0, 1.0), (T0 + timedelta(milliseconds=1000), 2.0)], "Timestamp timestamp, Bytes double")
    got = W.window_summary(df, freq="200 milliseconds").orderBy("Timestamp").collect()
    assert [r["Bytes"] for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 2.0]


def test_interval_rules(spark):
    at = lambda s: str(T0 + timedelta(seconds=s))
    rules = [(at(1), at(4), "one"), (at(3), at(5), "two"), (at(7), at(7), "instant")]
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=i)) for i in range(9)], "id long, ts timestamp")
    expect = ["BENIGN", "one", "one", "two", "two", "two", "BENIGN", "instant", "BENIGN"]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_id int, start string, end string, label string")
    for given in (rules, table):
        assert [r["Label"] for r in W.label_by_intervals(df, "ts", given).orderBy("id").collect()] == expect
    assert {r["Label"] for r in W.label_by_intervals(df, "ts", []).collect()} == {"BENIGN"}


def test_many_interval_rules(spark):
    rng = random.Random(1)
    at = lambda s: T0 + timedelta(seconds=s)
    rules = [(a := rng.randrange(3000), a + rng.choice([0, 5, 40, 2000]), f"r{i}") for i in range(1000)]
    df = spark.createDataFrame([(i, at(i)) for i in range(3100)] + [(-1, None)], "id long, ts timestamp")
    got = {r["id"]: r["Label"] for r in W.label_by_intervals(df, "ts", [(str(at(a)), str(at(b)), n) for a, b, n in rules]).collect()}
    expect = {i: next((n for a, b, n in reversed(rules) if a <= i <= b), "BENIGN") for i in range(3100)}
    assert got == expect | {-1: "BENIGN"}


@pytest.mark.parametrize("splits", [1 << 17, 50])
def test_rule_table_is_resolved_in_spark(spark, monkeypatch, splits):
    """A table of rules never passes through the driver, also where most of them crowd in a short time."""
    def never(*_):
        raise AssertionError("rules were resolved on the driver")
    monkeypatch.setattr(W, "_painted", never)
    monkeypatch.setattr(W, "SPLITS", splits)
    rng = random.Random(2)
    at = lambda s: T0 + timedelta(seconds=s)
    rules = [(a := rng.randrange(900), a + rng.choice([0, 5, 40, 700]), f"r{i}") for i in range(600)] + [(5_000_000, 5_000_010, "late"), (7, 3, "none")]
    df = spark.createDataFrame([(i, at(i)) for i in [*range(-5, 1800), 4_999_999, 5_000_000, 5_000_010, 5_000_011]] + [(-9, None)], "id long, ts timestamp")
    table = spark.createDataFrame([(i, at(a), at(b), n) for i, (a, b, n) in enumerate(rules)], "rule_id int, start timestamp, end timestamp, label string")
    got = {r["id"]: r["Label"] for r in W.label_by_intervals(df, "ts", table).collect()}
    assert got == {i: "BENIGN" if i == -9 else next((n for a, b, n in reversed(rules) if a <= i <= b), "BENIGN") for i in got} and len(got) == df.count()


def test_overlay_rules(spark):
    t = lambda s: T0 + timedelta(seconds=s)
    base = spark.createDataFrame([(t(1), 1.0, 9.0, "BENIGN"), (t(2), 2.0, 9.0, None), (t(3), 3.0, 9.0, "BENIGN")],
                                 "Timestamp timestamp, Bytes double, Packets double, Label string")
    over = lambda rows: spark.createDataFrame(rows, "Timestamp timestamp, seq long, Bytes double, Label string")
    out = W.overlay_by_timestamp(base, [over([(t(2), 1, 50.0, "x"), (t(2), 2, 60.0, "y"), (t(9), 3, 1.0, "z")]), over([(t(3), 0, None, None)])],
                                 order_by=["seq"])
    got = [tuple(r) for r in out.orderBy("Timestamp").collect()]
    assert got == [(t(1), 1.0, 9.0, "BENIGN", False), (t(2), 60.0, 0.0, "y", True), (t(3), 0.0, 0.0, "BENIGN", True)]
    assert tuple(W.overlay_counts(out).first()) == (3, 2)


def test_dedupe_null_safe(spark):
    df = spark.createDataFrame([(0, None, 1), (1, None, 1), (2, "a", 1)], "seq long, a string, b int")
    assert sorted(r["seq"] for r in W.dedupe_rows(df).collect()) == [0, 2]
