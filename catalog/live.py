"""Queries on live data: the whole events table replayed as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SQL_TIME, TRUTH_LEVEL, events, flows, text_time
from catalog.ordered import _SUMMARY, RULES
from catalog.scored import _SCORES, FEATURES, HST, _stream
from catalog.stateful import SETTINGS, WARMUP
from flowstream.functions.columns import clamp_infinity
from flowstream.operators import profile as P
from flowstream.operators.ordering import with_seq
from flowstream.operators.scoring import HalfSpaceTrees
from flowstream.operators.windowing import label_by_intervals
from flowstream.streaming import live as V


def window_summary_stream(spark, d):
    path = V.replay_files(flows(spark, d).drop("event_id"), "Timestamp", 3, close_after="2 hours")
    out = V.window_summary_stream(V.as_stream(spark, path), "Timestamp", "10 minutes", "Label", delay="1 hour")
    out = V.run_to_table(out, "summary")
    return out.select(text_time("Timestamp").alias("bucket"), F.round("Source Port_Entropy", 6).alias("port_entropy"),
                      F.round("Protocol_Entropy", 6).alias("protocol_entropy"), F.round("Bytes", 4).alias("bytes"), "Label")


def gap_fill_stream(spark, d):
    """The window summary of the rarest flows on live data, with its empty windows; protocol numbers summed as whole numbers."""
    f = flows(spark, d).filter(F.col("Bytes") > TRUTH_LEVEL).withColumn("Weight", F.col("Protocol").cast("long")).drop("event_id", "Protocol")
    path = V.replay_files(f, "Timestamp", 3, close_after="2 hours")
    out = V.run_to_table(V.window_summary_stream(V.as_stream(spark, path), "Timestamp", "10 minutes", "Label", delay="1 hour", fill_gaps=True), "summary")
    return out.select(text_time("Timestamp").alias("bucket"), F.round("Source Port_Entropy", 6).alias("port_entropy"), F.round("Bytes", 4).alias("bytes"),
                      F.col("Weight").alias("weight"), "Label")


def label_stream(spark, d):
    """Interval labels and stored min-max scaling on a stream: projections only."""
    e = events(spark, d).select("event_id", "ts", "value")
    fitted = P.fit_scale(clamp_infinity(e, ["value"]), ["value"], "MinMaxScaler")
    path = V.replay_files(e, "ts", 2)
    rows = clamp_infinity(V.as_stream(spark, path), ["value"])
    out = V.run_to_table(P.apply_scale(label_by_intervals(rows, "ts", RULES), fitted), "labelled")
    return out.select("event_id", F.round("value", 6).alias("value"), "Label")


def dspot_stream(spark, d):
    """DSPOT per day on live scores; equals the batch form."""
    e = events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("stream_id"), "ts", "event_id", F.col("value").alias("score"))
    s = with_seq(e, ["ts", "event_id"], by="stream_id").drop("event_id")
    path = V.replay_files(s, "ts", 3, close_after="2 hours")
    return V.run_to_table(V.dspot_stream(V.as_stream(spark, path), delay="1 hour", warmup=WARMUP, **SETTINGS), "alerts").drop("ts")


def score_stream(spark, d):
    """Half-space trees on live rows; equals the batch form."""
    path = V.replay_files(_stream(spark, d).select("ts", "seq", *FEATURES), "ts", 3)
    out = V.score_stream(V.as_stream(spark, path), FEATURES, HalfSpaceTrees(**HST))
    return out.select("seq", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in [window_summary_stream, gap_fill_stream, label_stream, dspot_stream, score_stream]}

_CASE = " ".join(f"when ts between timestamp '{s}' and timestamp '{e}' then '{n}'" for s, e, n in reversed(RULES))
ORACLE = {
    "window_summary_stream": f"""{_SUMMARY} select strftime(w, {SQL_TIME}) as bucket, round(pe, 6) as port_entropy,
      round(ke, 6) as protocol_entropy, round(b, 4) as bytes, label as "Label" from s""",
    "gap_fill_stream": f"""with f as (select time_bucket(interval '10 minutes', ts) as w, user_id, value, cast(json_extract_string(props, '$.k') as bigint) as k,
        case when event_type = 'view' then 'BENIGN' else event_type end as label from events where value > {TRUTH_LEVEL}),
      pc as (select w, user_id, count(*) as c from f group by all),
      pe as (select w, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) + 0.0 as e from pc group by w),
      lc as (select w, label, row_number() over (partition by w order by count(*) desc, label) as r from f group by w, label),
      sm as (select w, sum(value) as b, sum(k)::bigint as k from f group by w),
      g as (select unnest(generate_series(min(w), max(w), interval '10 minutes')) as w from f)
      select strftime(g.w, {SQL_TIME}) as bucket, coalesce(round(pe.e, 6), 0) as port_entropy, coalesce(round(sm.b, 4), 0) as bytes, coalesce(sm.k, 0) as weight,
        coalesce(lc.label, 'BENIGN') as "Label" from g left join sm using (w) left join pe using (w) left join lc on lc.w = g.w and lc.r = 1""",
    "label_stream": f"""select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6) as value,
      case {_CASE} else 'BENIGN' end as "Label" from events""",
    "score_stream": _SCORES,
}
