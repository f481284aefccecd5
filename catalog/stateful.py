"""Queries on alert thresholds and drift (events; one stream per day or per user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SQL_SEQ, SQL_SEQ_USER, TRUTH_LEVEL, events, stream
from flowstream.operators import drift as D
from flowstream.operators import thresholds as T
from flowstream.operators.ordering import attack_regions, moving_average, with_seq

# Fixed values of these queries.
SETTINGS = {"q": 0.01, "depth": 20, "t_quantile": 0.95}
WARMUP = 100
GRID = [(q, depth, t) for q in (0.02, 0.005) for depth in (10, 40) for t in (0.93, 0.97)]


def _days(spark, d):
    e = events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("stream_id"), "ts", "event_id", "value")
    s = with_seq(e, ["ts", "event_id"], by="stream_id")
    return s.select("stream_id", "seq", F.col("value").alias("score"), (F.col("value") > TRUTH_LEVEL).cast("int").alias("truth"))


def _user_errors(spark, d):
    """An error stream per user whose rate jumps from .1 to .6 half way through the user's rows."""
    s = stream(spark, d, by="user_id")
    halves = s.groupBy(F.col("user_id").alias("_user")).agg(F.expr("count(*) div 2").alias("_half"))
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 7), 16, 10).cast("double") / float(16**7)
    s = s.join(halves, F.col("user_id").eqNullSafe(F.col("_user")))
    return s.select("user_id", "seq", (u < F.when(F.col("seq") < F.col("_half"), 0.1).otherwise(0.6)).cast("double").alias("error"))


def _errors(spark, d):
    """One long error stream whose rate jumps from .1 to .6 half way; the draws come from the id's hash."""
    s = stream(spark, d)
    half = s.count() // 2
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 7), 16, 10).cast("double") / float(16**7)
    return s.select(F.lit("all").alias("stream_id"), "seq", (u < F.when(F.col("seq") < half, 0.1).otherwise(0.6)).cast("double").alias("error"))


def dspot(spark, d):
    return T.dspot(_days(spark, d), warmup=WARMUP, **SETTINGS)


def dspot_segments(spark, d):
    """The same alerts with every stream cut into short segments."""
    return T.dspot(_days(spark, d), warmup=WARMUP, segment_rows=150, **SETTINGS)


def dspot_metrics(spark, d):
    s = _days(spark, d).withColumn("algorithm", F.lit("value"))
    return T.dspot_evaluation(s, WARMUP, target=None, **SETTINGS)


def dspot_sweep(spark, d):
    return T.dspot_sweep(_days(spark, d), GRID, WARMUP, target=1)


def contamination(spark, d):
    """Fixed and DSPOT decisions of all streams side by side, with the smoothed score."""
    both = T.contamination_evolution(_days(spark, d), 120.0, warmup=WARMUP, **SETTINGS)
    return moving_average(both, "score", 5, by="stream_id")


def contamination_regions(spark, d):
    return attack_regions(_days(spark, d), "truth", 0, by="stream_id")


def evt_excess(spark, d):
    out = T.evt_excess_summary(_days(spark, d), WARMUP, SETTINGS["depth"], SETTINGS["t_quantile"])
    return out.select("stream_id", F.round("t", 6).alias("t"), "n_peaks", F.round("mean_excess", 6).alias("mean_excess"),
                      F.round("var_excess", 4).alias("var_excess"), "k")


def ddm(spark, d):
    return D.ddm(_user_errors(spark, d), "user_id")


def ddm_first(spark, d):
    return D.ddm_first(_errors(spark, d), "stream_id", block_rows=512)


def adwin(spark, d):
    return D.adwin(_user_errors(spark, d), "user_id")


def drift_monitor(spark, d):
    e = _user_errors(spark, d).select("user_id", "seq", F.lit(0.0).alias("truth"), F.col("error").alias("pred"))
    return D.drift_monitor(e, "user_id")


QUERIES = {f.__name__: f for f in [dspot, dspot_segments, dspot_metrics, dspot_sweep, contamination, contamination_regions,
                                   evt_excess, ddm, ddm_first, adwin, drift_monitor]}

_DAYS = """select strftime(ts, '%Y-%m-%d') as stream_id, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, event_id) - 1 as seq,
  value as score, (value > 150)::integer as truth from events"""

# One step of the recursion takes the next row of every user; a row after a change starts from nothing.
_DDM = f"""with recursive
  s as (select user_id, {SQL_SEQ_USER} as seq, event_id, count(*) over (partition by user_id) // 2 as half from events),
  e as (select user_id, seq, (('0x' || substr(md5(event_id::varchar), 1, 7))::bigint / 268435456.0::double < case when seq < half then 0.1 else 0.6 end)::integer::double as error from s),
  walk as (
    select distinct user_id, -1::bigint as seq, 0::double as error, 0::bigint as n, 0::double as errors, 1e300::double as best, 0::double as p_min, 0::double as s_min, 'normal' as state from e
    union all
    select user_id, seq, error, n, errors, best, p_min, s_min,
      case when n + 1 > 30 and p + s > p_min + 3 * s_min then 'change' when n + 1 >= 30 and p + s > p_min + 2 * s_min then 'warning' else 'normal' end as state
    from (select user_id, seq, error, n, errors, p, s, case when lower then p + s else best end as best, case when lower then p else p_min end as p_min,
        case when lower then s else s_min end as s_min
      from (select *, n + 1 >= 30 and p + s <= best as lower
        from (select *, sqrt(p * (1 - p) / n) as s
          from (select *, errors / n as p
            from (select e.user_id, e.seq, e.error, case w.state when 'change' then 1 else w.n + 1 end as n, case w.state when 'change' then e.error else w.errors + e.error end as errors,
                case w.state when 'change' then 1e300::double else w.best end as best, w.p_min, w.s_min
              from walk w join e on e.user_id = w.user_id and e.seq = w.seq + 1))))))
  select user_id, seq, error, state from walk where seq >= 0"""

ORACLE = {
    "ddm": _DDM,
    "contamination_regions": f"""with s as ({_DAYS}),
      c as (select *, case when truth is distinct from lag(truth) over (partition by stream_id order by seq) then 1 else 0 end as ch from s),
      b as (select *, sum(ch) over (partition by stream_id order by seq rows unbounded preceding) as b from c)
      select stream_id, min(seq) as start_seq, max(seq) as end_seq, count(*) as n, 1 as class_idx from b where truth = 1 group by stream_id, b""",
    "evt_excess": f"""with s as (select *, count(*) over (partition by stream_id) as n from ({_DAYS}) where seq < {WARMUP}),
      x as (select stream_id, seq, n, score - avg(score) over (partition by stream_id order by seq rows between 20 preceding and 1 preceding) as xp from s),
      y as (select * from x where n = {WARMUP} and seq >= 20),
      t as (select stream_id, quantile_cont(xp, 0.95) as t from y group by 1)
      select stream_id, round(any_value(t), 6) as t, count(*) filter (xp > t) as n_peaks,
        round(avg(xp - t) filter (xp > t), 6) as mean_excess, round(var_pop(xp - t) filter (xp > t), 4) as var_excess, count(*) as k
      from y join t using (stream_id) group by 1""",
    "ddm_first": f"""with s as (select {SQL_SEQ} as seq, event_id, count(*) over () // 2 as half from events),
      e as (select seq, (('0x' || substr(md5(event_id::varchar), 1, 7))::bigint / 268435456.0 < case when seq < half then 0.1 else 0.6 end)::integer as err from s),
      p as (select seq, sum(err) over (order by seq rows unbounded preceding) / (seq + 1)::double as p from e),
      q as (select seq, p, sqrt(p * (1 - p) / (seq + 1)) as s from p),
      m as (select seq, p, s, min(case when seq + 2 >= 30 then row(p + s, -seq, p, s) end) over (order by seq rows unbounded preceding) as m from q)
      select 'all' as stream_id, min(seq) as first_change from m where seq + 2 > 30 and p + s > m[3] + 3.0 * m[4]""",
}
