"""Queries on whole jobs and their options: columns found by name, dropped rows counted, metrics, whitelists, own aggregates, grids."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog.common import SQL_TIME, events, flows, text_time
from catalog.prepared import _hash
from flowstream.operators import profile as P
from flowstream.operators import sampling as S
from flowstream.operators.sweeps import experiment_grid
from flowstream.operators.windowing import window_summary
from flowstream.plans.preparation import prepare
from flowstream.plans.scenarios import balanced_dataset, filter_and_label, window_dataset

MEASURES = ["value", "user_id", "h"]
METRICS = ("sqeuclidean", "cityblock", "chebyshev", "cosine")
SIZES = (25, 250, 500)
PERIOD = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
NIGHT = [("2024-01-10 00:00:00", "2024-01-10 06:00:00", "night")]


def balanced_job(spark, d):
    """100 flows of each class in order of time; label and time columns are found by their names."""
    f = events(spark, d).select("event_id", F.concat(F.lit(" "), "event_type").alias(" Flow Label "), text_time("ts").alias("Event Time"))
    got = balanced_dataset(f, 100, ["event_id"], time_format="yyyy-MM-dd HH:mm:ss", ignored=["error"])
    return got.select("event_id", F.trim("Flow Label").alias("label"), text_time("Event Time").alias("at"))


def dropped_times(spark, d):
    """Rows per hour of a windowed table, and of a labelled period, with the rows that had no readable time."""
    bad = F.when(F.col("event_id") % 5 == 0, "no time").otherwise(text_time("Timestamp"))
    f = flows(spark, d).withColumn("Timestamp", bad).select("Timestamp", "Bytes", "Label")
    windowed, labelled = Observation(), Observation()
    hours = window_dataset(f, "1 hour", dropped=windowed).filter("Bytes > 0").count()
    rows = filter_and_label(f.drop("Label"), *PERIOD, NIGHT, ts="Timestamp", dropped=labelled)
    found = rows.groupBy("Label").agg(F.count("*").alias("n")).collect()
    lines = [("windowed", "", hours, windowed.get["dropped"]), *[("labelled", r.Label, r.n, labelled.get["dropped"]) for r in found]]
    return spark.createDataFrame(lines, "job string, label string, n long, dropped long")


def distance_metrics(spark, d):
    e = events(spark, d).withColumn("h", F.hour("ts"))
    parts = [P.class_distance(e, MEASURES, "event_type", m).withColumn("metric", F.lit(m)) for m in METRICS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", "a", "b", F.round("distance", 6).alias("distance"))


def prepare_selected(spark, d):
    """Only listed features that exist are prepared, in the order of the list."""
    f = flows(spark, d).withColumn("Size", F.col("Bytes") * 2)
    got = prepare(f, order_by=["Timestamp", "event_id"], selected=["Size", "Nowhere", "Bytes"], normalize="MinMaxScaler")
    columns = F.lit(",".join(got.features))
    return got.table.select("seq", "class_idx", columns.alias("features"), F.round("Bytes", 6).alias("bytes"))


def window_extra(spark, d):
    """A window summary with aggregates of the caller's own."""
    extra = {"Largest": F.max("Bytes"), "Ports": F.count_distinct("Source Port")}
    got = window_summary(flows(spark, d).drop("event_id", "Protocol"), "Timestamp", "1 hour", fill_gaps=False, extra=extra)
    return got.select(text_time("Timestamp").alias("bucket"), F.col("Largest").alias("largest"), F.col("Ports").alias("ports"))


def experiment_sizes(spark, d):
    """A grid of class x size x algorithm over the classes of the table, and the rows that each experiment gets."""
    counts = S.class_counts(events(spark, d), "event_type", ["view"])
    classes = sorted(r.label for r in counts.collect())
    grid = experiment_grid(spark, category=classes, size=SIZES, algorithm=["HST", "AIF"])
    return grid.join(F.broadcast(counts), F.col("category") == F.col("label")).select(
        F.col("idx").cast("int").alias("idx"), "category", "size", "algorithm", F.least(F.col("size").cast("long"), "n").alias("n"))


QUERIES = {f.__name__: f for f in [balanced_job, dropped_times, distance_metrics, prepare_selected, window_extra, experiment_sizes]}

_BAD = "case when event_id % 5 = 0 then null else ts end"
_GAP = {"sqeuclidean": "sum((x.v - y.v) ** 2)", "cityblock": "sum(abs(x.v - y.v))", "chebyshev": "max(abs(x.v - y.v))",
        "cosine": "1 - sum(x.v * y.v) / nullif(sqrt(sum(x.v ** 2)) * sqrt(sum(y.v ** 2)), 0)"}
ORACLE = {
    "balanced_job": f"""select event_id, event_type as label, strftime(ts, {SQL_TIME}) as at from events where event_type <> 'error'
      qualify row_number() over (partition by event_type order by {_hash()}) <= 100""",
    "dropped_times": f"""with e as (select {_BAD} as ts, value from events),
      k as (select case when ts between timestamp '{NIGHT[0][0]}' and timestamp '{NIGHT[0][1]}' then 'night' else 'BENIGN' end as label from e
        where ts between timestamp '{PERIOD[0]}' and timestamp '{PERIOD[1]}')
      select 'windowed' as job, '' as label, count(distinct time_bucket(interval '1 hour', ts)) as n, count(*) filter (ts is null) as dropped from e
      union all select 'labelled', label, count(*), (select count(*) from e where ts is null) from k group by label""",
    "distance_metrics": f"""with s as (select event_type as class, avg(value) as value, avg(user_id) as user_id, avg(hour(ts)) as h from events group by 1),
      u as (unpivot s on value, user_id, h into name feature value m),
      z as (select class, feature, (m - min(m) over w) / (max(m) over w - min(m) over w) as v from u window w as (partition by feature))
      {" union all ".join(f"select '{m}' as metric, x.class as a, y.class as b, round({g}, 6) as distance from z x join z y on x.feature = y.feature and x.class < y.class group by x.class, y.class" for m, g in _GAP.items())}""",
    "prepare_selected": """select row_number() over (order by ts, event_id) - 1 as seq, (event_type <> 'view')::integer as class_idx, 'Size,Bytes' as features,
      round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6) as bytes from events""",
    "window_extra": f"""select strftime(time_bucket(interval '1 hour', ts), {SQL_TIME}) as bucket, max(value) as largest, count(distinct user_id) as ports from events group by 1""",
    "experiment_sizes": f"""with c as (select event_type as category, count(*) as n from events where event_type <> 'view' group by 1),
      g as (select category, s.i as si, s.size, a.i as ai, a.algorithm, n, dense_rank() over (order by category) - 1 as ci
        from c, (values {", ".join(f"({i}, {s})" for i, s in enumerate(SIZES))}) s(i, size), (values (0, 'HST'), (1, 'AIF')) a(i, algorithm))
      select (ci * {2 * len(SIZES)} + si * 2 + ai)::integer as idx, category, size::varchar as size, algorithm, least(size, n) as n from g""",
}
