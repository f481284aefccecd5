"""Time windows, interval labels and timestamp overlays."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowstream.functions.columns import ENTROPY_FRAGMENTS, col, fill_flow_nulls, numeric_columns, without_nan
from flowstream.operators.ordering import with_seq
from flowstream.session import join_checked, written


MAX_PIECES = 200_000  # of interval rules that are broadcast, some 20 MB
SPLITS = 1 << 17  # bucket borders that are sent to every task, 1 MB
FAN = 8  # stretches of one level that make a stretch of the next


def drop_bad_times(df: DataFrame, ts: str, observation: Observation | None = None) -> DataFrame:
    """Drop rows without a readable time; ``observation`` receives the number dropped."""
    if observation is not None:
        df = df.observe(observation, F.count_if(col(ts).isNull()).alias("dropped"))
    return df.filter(col(ts).isNotNull())


def time_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows between two times, both included."""
    kind = dict(df.dtypes)[ts]
    return df.filter(col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def entropy_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(f in c for f in ENTROPY_FRAGMENTS)]


def _window_start(ts: str, freq: str) -> Column:
    return F.window(col(ts), freq)["start"]


def value_counts(df: DataFrame, ts: str, freq: str, cols: Sequence[str]) -> DataFrame:
    """Rows per (window, column, value) in long form; counted before the shuffle, so a crowded window
    or a dominant value costs one row per task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("value")) for c in cols])
    long = df.select(_window_start(ts, freq).alias("_w"), F.explode(pairs).alias("_p"))
    return (
        long.filter(F.col("_p.value").isNotNull())
        .groupBy("_w", F.col("_p.name").alias("name"), F.col("_p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _entropy_of(c: Column) -> Column:
    """Base-2 entropy of a column of counts (nulls are left out)."""
    total = F.sum(c)
    bits = F.log2(total) - F.sum(c * F.log2(c)) / total
    return F.coalesce(F.greatest(bits, F.lit(0.0)), F.lit(0.0)) + F.lit(0.0)


def shannon_entropy(df: DataFrame, column: str, by: Sequence[str], name: str = "entropy") -> DataFrame:
    """Base-2 entropy of ``column`` per group; nulls are not counted."""
    counts = df.groupBy(*by, column).agg(F.count(column).alias("_c"))
    return counts.groupBy(*by).agg(_entropy_of(F.when(F.col("_c") > 0, F.col("_c"))).alias(name))


def _mode_of(value: Column, c: Column) -> Column:
    """Most frequent value, the lowest one on ties."""
    return F.min_by(value, F.struct((-c).alias("c"), value.alias("v")))


def mode_label(df: DataFrame, label: str, by: Sequence[str], name: str = "label_mode") -> DataFrame:
    counts = df.filter(col(label).isNotNull()).groupBy(*by, col(label).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*by).agg(_mode_of(F.col("_v"), F.col("_c")).alias(name))


def gap_fill(summary: DataFrame, ts: str, freq: str, label: str = "Label", bounds: tuple | None = None) -> DataFrame:
    """Add the missing buckets between the first and the last one: label BENIGN, everything else 0.

    The spine of buckets comes from ``spark.range``, so it is produced in parallel. ``bounds`` (first and last
    bucket) saves reading the summary for them.
    """
    spark = summary.sparkSession
    lo, hi = bounds or summary.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return summary
    micros, n = spark.sql(
        f"select w, (unix_micros(cast(timestamp'{hi}' as timestamp)) - unix_micros(cast(timestamp'{lo}' as timestamp)))"
        f" div w + 1 from (select unix_micros(cast('1970-01-01 00:00:00' as timestamp_ntz)::timestamp + interval {freq})"
        f" - unix_micros(cast('1970-01-01 00:00:00' as timestamp_ntz)::timestamp) as w)"
    ).first()
    kind = dict(summary.dtypes)[ts]
    step = F.make_dt_interval(secs=(F.col("id") * micros / 1_000_000).cast("decimal(18,6)"))
    spine = spark.range(n).select((F.lit(str(lo)).cast(kind) + step).cast(kind).alias(ts))
    return fill_flow_nulls(spine.join(summary, ts, "left"), label)


def window_summary(df: DataFrame, ts: str = "Timestamp", freq: str = "1 second", label: str = "Label",
                   fill_gaps: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """Tumbling window summary: identifier columns to ``*_Entropy``, label to its mode, other numbers to sums.

    ``extra`` adds aggregates of the caller's own, by result name.

    Two aggregations over the same window key, both combined before the shuffle, joined on the
    window (one row per window on either side).
    """
    ids = entropy_columns(df)
    has_label = label in df.columns
    nums = [c for c in numeric_columns(df) if c not in ids and c not in (label, ts)]
    rows = df.filter(col(ts).isNotNull())
    sums = rows.groupBy(_window_start(ts, freq).alias("_w")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.coalesce(F.sum(without_nan(df, c)), F.lit(0)).alias(c) for c in nums],
        *[agg.alias(name) for name, agg in (extra or {}).items()],
    )
    counted = ids + ([label] if has_label else [])
    if counted:
        counts = value_counts(rows, ts, freq, counted)
        aggs = [_entropy_of(F.when(F.col("name") == c, F.col("c"))).alias(c) for c in ids]
        if has_label:
            mine = F.col("name") == label
            key = F.when(mine, F.struct((-F.col("c")).alias("c"), F.col("value").alias("v")))
            aggs.append(F.min_by(F.when(mine, F.col("value")), key).alias(label))
        shape = counts.groupBy("_w").agg(*aggs)
        sums = sums.join(shape, "_w", "left")
    out = sums.select(F.col("_w").alias(ts), *[col(c) for c in [*ids, *nums, *(extra or {}), *([label] if has_label else [])]])
    out = out.withColumnsRenamed({c: f"{c}_Entropy" for c in ids})
    out = fill_flow_nulls(out, label)
    if not fill_gaps:
        return out
    # the ends come from a scan of the time column alone
    ends = rows.agg(F.array(F.min(col(ts)), F.max(col(ts))).alias("e")).select(F.explode("e").alias("t")).filter("t is not null")
    starts = sorted(r[0] for r in ends.select(_window_start("t", freq)).collect())
    return gap_fill(out, ts, freq, label, (starts[0], starts[-1])) if starts else out


def _painted(rules: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Disjoint stretches [start, end) and the label of the last rule that covers each."""
    edges = sorted({x for s, e, _ in rules if s < e for x in (s, e)})
    opening: dict[int, list[int]] = {}
    for i, (s, e, _) in enumerate(rules):
        if s < e:
            opening.setdefault(s, []).append(-i)
    out, active = [], []
    for a, b in zip(edges, edges[1:]):
        for i in opening.get(a, ()):
            heapq.heappush(active, i)
        while active and rules[-active[0]][1] <= a:
            heapq.heappop(active)
        if active:
            name = rules[-active[0]][2]
            if out and out[-1][1] == a and out[-1][2] == name:
                out[-1] = (out[-1][0], b, name)
            else:
                out.append((a, b, name))
    return out


def _paint(known: DataFrame) -> DataFrame:
    """``_painted`` for a table (s, e, rule_id, label) of any length, as a table (p, _s, _e, _name): the stretches between
    neighbouring edges by their position p, _name null where no rule covers them.

    A rule over n stretches is the union of at most FAN overlapping blocks of FAN^k stretches, k as large as fits. Blocks
    with equal starts keep their last rule, and each level hands it down to the next smaller blocks. So nothing is
    expanded by the length of a rule, and no key holds more rows than others after the aggregation in the tasks.
    """
    edges = written(with_seq(known.select(F.explode(F.array("s", "e")).alias("at")).distinct(), ["at"], name="p"), "edges")
    ranked = known.groupBy("s", "e").agg(F.max(F.struct("rule_id", "label")).alias("v"))
    ranked = ranked.join(edges.select(F.col("at").alias("s"), F.col("p").alias("a")), "s").join(edges.select(F.col("at").alias("e"), F.col("p").alias("b")), "e")
    top = int(log(max(2, edges.count()), FAN)) + 1
    level = sum((F.when(F.col("b") - F.col("a") >= FAN ** k, 1).otherwise(0) for k in range(1, top + 1)), F.lit(0))
    size = F.pow(F.lit(float(FAN)), "k").cast("long")
    blocks = ranked.withColumn("k", level).withColumn("n", size)
    starts = F.expr("transform(sequence(a, b - 1, n), x -> least(x, b - n))")
    blocks = written(blocks.select("k", F.explode(starts).alias("p"), "v").groupBy("k", "p").agg(F.max("v").alias("v")), "blocks")
    now = blocks.filter(F.col("k") == top).select("p", "v")
    for k in range(top - 1, -1, -1):
        down = now.select(F.explode(F.array(*[F.col("p") + i * FAN ** k for i in range(FAN)])).alias("p"), "v")
        now = down.unionByName(blocks.filter(F.col("k") == k).select("p", "v")).groupBy("p").agg(F.max("v").alias("v"))
    until = edges.select((F.col("p") - 1).alias("p"), F.col("at").alias("_e"))
    return edges.join(until, "p").join(now, "p", "left").select("p", F.col("at").alias("_s"), "_e", F.col("v.label").alias("_name"))


def _constant(values: Sequence, kind: str) -> Column:
    """An array as one constant of the plan: a single text, which the optimizer folds."""
    return F.split(F.lit("\x01".join(map(str, values))), "\x01").cast(f"array<{kind}>")


def _place(at: Column, borders: Sequence[int]) -> Column:
    """How many of the sorted borders are not above a number, by binary search in the JVM."""
    table, n = _constant(borders, "bigint"), len(borders)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= at, low + step).otherwise(low))


def label_by_intervals(df: DataFrame, ts: str, rules, default: str = "BENIGN", label: str = "Label") -> DataFrame:
    """Label rows by time intervals, both ends included; the last matching rule wins.

    ``rules`` is a list of (start, end, label), resolved on the driver, or a table (rule_id, start, end, label) of any
    length, resolved in Spark. A row finds its stretch of a list by binary search in a constant of the plan. For a table, the stretches are
    numbered by time, every few of them are a bucket that is found in the same way, and rows join the stretches of their bucket, in batch and on streams. At
    most SPLITS bucket borders pass through the driver, and however close together the stretches are, a bucket has the same number of them.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[ts]
    micros = lambda c: F.unix_micros(c.cast(kind).cast("timestamp"))
    local = not isinstance(rules, DataFrame)
    if local:
        data = [(i, str(s), str(e), n) for i, (s, e, n) in enumerate(rules)]
        rules = spark.createDataFrame(data, "rule_id int, start string, end string, label string")
    known = rules.select(micros(F.col("start")).alias("s"), (micros(F.col("end")) + 1).alias("e"), F.col("label").cast("string").alias("label"), "rule_id").filter("s < e")
    out = df.drop(label) if label in df.columns else df
    at = micros(col(ts))
    if local:
        stretches = _painted([(r["s"], r["e"], r["label"]) for r in known.orderBy("rule_id").collect()])
        if not stretches:
            return out.withColumn(label, F.lit(default))
        starts, ends, names = zip(*stretches)
        rows = out.withColumn("_i", _place(at, starts) - 1)
        return rows.withColumn(label, F.when(F.get(_constant(ends, "bigint"), F.col("_i")) > at, F.get(_constant(names, "string"), F.col("_i"))).otherwise(F.lit(default))).drop("_i")
    pieces = written(_paint(written(known, "rules")), "stretches")
    n = pieces.count()
    if not n:
        return out.withColumn(label, F.lit(default))
    step = -(-n // SPLITS)
    borders = sorted(r[0] for r in pieces.filter(F.col("p") % step == 0).select("_s").collect())
    table = pieces.filter("_name is not null").withColumn("_b", F.expr(f"p div {step}")).drop("p")
    if n <= MAX_PIECES:
        table = F.broadcast(table)
    rows = out.withColumn("_m", at).withColumn("_at", _place(F.col("_m"), borders).cast("long") - 1)
    hit = (F.col("_at") == F.col("_b")) & (F.col("_m") >= F.col("_s")) & (F.col("_m") < F.col("_e"))
    return rows.join(table, hit, "left").withColumn(label, F.coalesce("_name", F.lit(default))).drop("_m", "_at", "_b", "_s", "_e", "_name")


def dedupe_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the last (or first) by ``order_by``; combined before the shuffle, so hot keys are cheap."""
    row = F.struct(*[col(c) for c in df.columns])
    rank = F.struct(*[col(c) for c in order_by])
    pick = F.max_by(row, rank) if keep == "last" else F.min_by(row, rank)
    return df.groupBy(*[col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(pick.alias("_r")).select("_r.*")


def dedupe_rows(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Equal rows (all columns but ``seq``; null equals null) collapse to the first one."""
    cols = [c for c in df.columns if c != seq]
    return df.groupBy(*[col(c) for c in cols]).agg(F.min(seq).alias(seq)).select(*[col(c) for c in df.columns])


def overlay_by_timestamp(base: DataFrame, overlays: Sequence[DataFrame], ts: str = "Timestamp",
                         order_by: Sequence[str] = (), label: str = "Label") -> DataFrame:
    """Replace base rows by overlay rows of the same time.

    Overlays rank in list order, then by ``order_by``; the last row per time wins. Times only the
    overlays have are ignored; base columns the overlay lacks become 0 (label BENIGN) in replaced rows.
    ``_replaced`` marks them.
    """
    parts = [o.withColumn("_o", F.lit(i)) for i, o in enumerate(overlays)]
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p, allowMissingColumns=True)
    allrows = allrows.filter(col(ts).isNotNull())
    last = dedupe_key(allrows, [ts], ["_o", *order_by], "last")
    over = last.select(col(ts).alias("_ots"), *[col(c).alias(f"_n_{c}") for c in last.columns if c not in (ts, "_o")])
    kinds = dict(base.dtypes)
    joined = base.join(over, col(ts) == F.col("_ots"), "left")
    hit = F.col("_ots").isNotNull()
    out = []
    for c in base.columns:
        if c == ts:
            out.append(col(c))
        else:
            new = col(f"_n_{c}") if c in last.columns else F.lit(None)
            out.append(F.when(hit, new.cast(kinds[c])).otherwise(col(c)).alias(c))
    return fill_flow_nulls(joined.select(*out, hit.alias("_replaced")), label)


def overlay_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("processed"), F.count_if("_replaced").alias("replaced"))


def common_timestamps(left: DataFrame, right: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Number of distinct times both tables hold."""
    both = left.select(ts).distinct().join(right.select(ts).distinct(), ts, "left_semi")
    return both.agg(F.count(F.lit(1)).alias("common"))
