"""Queries on sources, time windows and row order (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SQL_SEQ, SQL_SEQ_USER, SQL_TIME, events, flows, stream, text_time
from flowstream.functions import columns as C
from flowstream.operators import ordering as O
from flowstream.operators import windowing as W
from flowstream.plans.scenarios import benign_baseline, filter_and_label, overlay_attacks, window_dataset
from flowstream.session import fresh_path
from flowstream.sources.flows import class_report, read_flows, union_tables, write_table

# Interval rules of the labelling query (both ends included, last match wins).
RULES = [
    ("2024-01-03 00:00:00", "2024-01-05 12:00:00", "syn"),
    ("2024-01-05 00:00:00", "2024-01-05 06:00:00", "udp"),
    ("2024-01-10 10:00:00", "2024-01-10 10:30:00", "http-flood"),
    ("2024-01-20 00:00:00", "2024-01-25 00:00:00", "syn"),
    ("2024-01-22 00:00:00", "2024-01-22 23:59:59", "udp"),
]
RANGE = ("2024-01-02 00:00:00", "2024-01-28 00:00:00")
_RULE_ROWS = ", ".join(f"({i}, timestamp '{s}', timestamp '{e}', '{n}')" for i, (s, e, n) in enumerate(RULES))
BUCKET = "10 minutes"
ROWS_PER_BLOCK = 1024  # small enough that the test tables span several blocks
SPARSE = ("error", "purchase")


def seq_index(spark, d):
    return stream(spark, d).select("event_id", "seq")


def seq_by_key(spark, d):
    return stream(spark, d, "user_id", by="user_id").select("event_id", "user_id", "seq")


def sort_by_time(spark, d):
    s = O.sort_by_time(events(spark, d).select("event_id", "ts", "event_type"), "ts", ["event_id"])
    return s.select("event_id", "event_type", text_time("ts").alias("at"))


def class_counts(spark, d):
    e = C.without_classes(events(spark, d), "event_type", ["error"])
    return e.groupBy(C.clean_label(F.col("event_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def report(spark, d):
    return class_report(flows(spark, d))


def benign_filter(spark, d):
    f = flows(spark, d)
    return f.filter(C.is_benign(F.col("Label"))).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Bytes"), 2).alias("bytes"))


def class_filter(spark, d):
    f = flows(spark, d)
    return f.filter(C.is_class(F.col("Label"), ["error", "purchase"])).select("event_id", "Label")


def _summary(spark, d, fill):
    f = flows(spark, d).drop("event_id")
    w = W.window_summary(f, "Timestamp", BUCKET, "Label", fill_gaps=fill)
    return w.select(
        text_time("Timestamp").alias("bucket"),
        F.round("Source Port_Entropy", 6).alias("port_entropy"),
        F.round("Protocol_Entropy", 6).alias("protocol_entropy"),
        F.round("Bytes", 4).alias("bytes"),
        "Label",
    )


def window_summary(spark, d):
    return _summary(spark, d, False)


def gap_fill(spark, d):
    return _summary(spark, d, True)


def window_entropy(spark, d):
    e = events(spark, d).withColumn("w", F.window("ts", "1 hour")["start"])
    return W.shannon_entropy(e, "user_id", ["w"]).select(text_time("w").alias("bucket"), F.round("entropy", 6).alias("entropy"))


def window_mode(spark, d):
    e = events(spark, d).withColumn("w", F.window("ts", "1 hour")["start"])
    return W.mode_label(e, "event_type", ["w"]).select(text_time("w").alias("bucket"), "label_mode")


def interval_label(spark, d):
    return W.label_by_intervals(events(spark, d).select("event_id", "ts"), "ts", RULES).select("event_id", "Label")


def interval_label_join(spark, d):
    """Rules as a table, over the whole period."""
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_id int, start string, end string, label string")
    return W.label_by_intervals(events(spark, d).select("event_id", "ts"), "ts", rules).select("event_id", "Label")


def interval_label_many(spark, d):
    """One rule per user, overlapping: the two days after the user's first event."""
    rules = (events(spark, d).groupBy("user_id").agg(F.min("ts").alias("start"))
             .select(F.col("user_id").alias("rule_id"), "start", F.expr("start + interval 2 days").alias("end"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("label")))
    return W.label_by_intervals(events(spark, d).select("event_id", "ts"), "ts", rules).select("event_id", "Label")


def time_range(spark, d):
    return W.time_range(events(spark, d), "ts", *RANGE).select("event_id", text_time("ts").alias("at"))


def label_blocks(spark, d):
    return O.blocks(stream(spark, d, "event_type"), "event_type", block_rows=ROWS_PER_BLOCK).select("seq", "event_type", "block_id")


def _class_idx(c):
    # Class index of the event types, view = normal.
    return F.when(c == "view", 0).when(c == "click", 1).when(c == "error", 2).when(c == "purchase", 3).otherwise(4)


def attack_regions(spark, d):
    s = stream(spark, d, "event_type").withColumn("y", _class_idx(F.col("event_type")))
    return O.attack_regions(s, "y", 0, block_rows=ROWS_PER_BLOCK)


def attack_regions_by_key(spark, d):
    s = stream(spark, d, "event_type", "user_id", by="user_id").withColumn("y", _class_idx(F.col("event_type")))
    return O.attack_regions(s, "y", 0, by="user_id")


def moving_average(spark, d):
    m = O.moving_average(stream(spark, d, "value"), "value", 5, block_rows=ROWS_PER_BLOCK)
    return m.select("seq", F.round("moving_average", 6).alias("moving_average"))


def rolling_mean(spark, d):
    m = O.rolling_mean(stream(spark, d, "value"), "value", 50, block_rows=ROWS_PER_BLOCK)
    return m.select("seq", F.round("rolling_mean", 6).alias("rolling_mean"))


def dedupe_first(spark, d):
    s = stream(spark, d, "user_id", "event_type").select("seq", "user_id", "event_type")
    return W.dedupe_rows(s)


def dedupe_last(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", "ts")
    return W.dedupe_key(e, ["user_id"], ["ts", "event_id"], "last").select("user_id", "event_id", "value")


def slices(spark, d):
    s = stream(spark, d)
    return O.slice_evenly(s, 6, s.count()).select("seq", "slice")


def interleave(spark, d):
    """Benign flows cut in slices with the two rarest-looking classes put between them as blocks."""
    f = flows(spark, d).select("event_id", "Timestamp", "Label")
    base = O.with_seq(f.filter(C.is_benign(F.col("Label"))), ["Timestamp", "event_id"])
    attack = f.filter(C.is_class(F.col("Label"), list(SPARSE)))
    attack = attack.withColumn("block", F.when(F.col("Label") == SPARSE[0], 0).otherwise(1))
    attack = O.with_seq(attack, ["Timestamp", "event_id"], by="block")
    return O.interleave(base, attack, 2, base.count()).select("event_id", "position")


def _daily(spark, d, cls):
    e = events(spark, d).filter(F.col("event_type") == cls)
    return e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("Timestamp"), "event_id",
                    F.col("value").alias("Bytes"), F.col("event_type").alias("Label"))


def overlay(spark, d):
    """Hourly benign rows replaced by the last purchase or, after it in list order, error row of that hour."""
    base = W.dedupe_key(_daily(spark, d, "view").withColumn("Packets", F.lit(1.0)), ["Timestamp"], ["event_id"], "first")
    overlays = [_daily(spark, d, "purchase"), _daily(spark, d, "error")]
    out = W.overlay_by_timestamp(base, overlays, "Timestamp", ["event_id"])
    return out.select(text_time("Timestamp").alias("at"), "event_id", "Bytes", "Packets", "Label",
                      F.col("_replaced").cast("int").alias("replaced"))


def common_times(spark, d):
    return W.common_timestamps(_daily(spark, d, "view"), _daily(spark, d, "error"))


def union_by_name(spark, d):
    e = events(spark, d)
    a = e.filter("event_type = 'view'").select("event_id", "value")
    b = e.filter("event_type <> 'view'").select("event_id", F.col("event_type").alias("attack"))
    return union_tables([a, b, a])


def lenient_parse(spark, d):
    """Numbers and times read from text; a third of the texts is spoiled on purpose."""
    e = events(spark, d)
    bad = F.col("event_id") % 3 == 0
    e = e.select("event_id",
                 C.parse_number(F.when(bad, "n/a").otherwise(F.col("value").cast("string"))).alias("num"),
                 C.parse_time(F.when(bad, "x").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")), "dd/MM/yyyy HH:mm:ss").alias("t"))
    kept = W.drop_bad_times(e, "t")
    return kept.select("event_id", "num", text_time("t").alias("at"))


def read_csv(spark, d):
    """Flows written as CSV with untidy header names, then read back with inferred types."""
    path = fresh_path(spark, "csv")
    f = flows(spark, d).withColumnsRenamed({"Bytes": " Bytes", "Label": " Label "})
    write_table(f.withColumn("Timestamp", text_time("Timestamp")), path, "csv")
    got = read_flows(spark, f"{path}/*.csv").withColumn("Timestamp", C.parse_time(F.col("Timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return got.select("event_id", text_time("Timestamp").alias("at"), F.col("Source Port").alias("port"), F.col("Bytes").alias("bytes"), "Label")


def read_csv_dirty(spark, d):
    """Flows in files with semicolons, cells over several lines, doubled quotes and words for missing numbers, read back
    with nothing said about them."""
    path = fresh_path(spark, "csv")
    note = F.concat(F.lit("line \n\""), F.col("Label"), F.lit("\"; "), F.col("Protocol"), F.lit("\n"))
    number = F.when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 11 == 0, " N/A").otherwise(F.col("Bytes").cast("string"))
    f = flows(spark, d).select(F.col("event_id").alias(" event_id"), number.alias("Bytes "), F.when(F.col("event_id") % 3 > 0, note).alias("Note"), F.col("Label"))
    f.write.csv(path, sep=";", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_flows(spark, f"{path}/*.csv", sep=None).select("event_id", F.col("Bytes").alias("bytes"), F.col("Note").alias("note"), "Label")


def baseline(spark, d):
    """The benign rows of two flow files, collected once and then loaded."""
    path = fresh_path(spark, "files")
    f = flows(spark, d).withColumn("Timestamp", text_time("Timestamp"))
    write_table(f.filter("Protocol < 50"), f"{path}/a", "csv")
    write_table(f.filter("Protocol >= 50"), f"{path}/b", "csv")
    for _ in range(2):
        got = benign_baseline(spark, [f"{path}/a/*.csv", f"{path}/b/*.csv", f"{path}/none.csv"], f"{path}/benign")
    return got.select("event_id", F.col("Bytes").alias("bytes"), text_time("Timestamp").alias("at"))


def dataset_chain(spark, d):
    """Window the benign and the attack flows, overlay them, keep a period and label it by intervals."""
    f = flows(spark, d).drop("event_id", "Protocol", "Source Port")
    base = window_dataset(f.filter(C.is_benign(F.col("Label"))), "1 hour")
    attacks = [window_dataset(f.filter(C.is_class(F.col("Label"), [c])), "1 hour") for c in SPARSE]
    merged, _, _ = overlay_attacks(base, [a.filter("Label <> 'BENIGN'") for a in attacks])
    out = filter_and_label(merged.drop("Label"), *RANGE, RULES, ts="Timestamp")
    return out.select(text_time("Timestamp").alias("at"), F.round("Bytes", 4).alias("bytes"), "Label")


QUERIES = {f.__name__: f for f in [
    read_csv, read_csv_dirty, baseline, dataset_chain, seq_index, seq_by_key, sort_by_time, class_counts, benign_filter, class_filter, window_summary, gap_fill,
    window_entropy, window_mode, interval_label, interval_label_join, interval_label_many, time_range, attack_regions,
    attack_regions_by_key, moving_average, rolling_mean, dedupe_first, dedupe_last, interleave, overlay,
    common_times, union_by_name, lenient_parse]}
QUERIES |= {"class_report": report, "blocks": label_blocks, "slice_evenly": slices}

_FLOW = """select event_id, ts, user_id, cast(json_extract_string(props, '$.k') as bigint) as k, value,
  case when event_type = 'view' then 'BENIGN' else event_type end as label from events"""
_SUMMARY = f"""with f as (select *, time_bucket(interval '10 minutes', ts) as w from ({_FLOW})),
  pc as (select w, user_id, count(*) as c from f group by all),
  kc as (select w, k, count(*) as c from f group by all),
  lc as (select w, label, row_number() over (partition by w order by count(*) desc, label) as r from f group by w, label),
  pe as (select w, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) + 0.0 as e from pc group by w),
  ke as (select w, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) + 0.0 as e from kc group by w),
  sm as (select w, sum(value) as b from f group by w),
  s as (select sm.w, pe.e as pe, ke.e as ke, sm.b, lc.label from sm join pe using (w) join ke using (w)
        join lc on lc.w = sm.w and lc.r = 1)"""
_IDX = "case event_type when 'view' then 0 when 'click' then 1 when 'error' then 2 when 'purchase' then 3 else 4 end"


def _regions(part):
    seq = SQL_SEQ_USER if part else SQL_SEQ
    key, over, pick = ("user_id,", "partition by user_id", "user_id,") if part else ("", "", "")
    return f"""with s as (select {key} {seq} as seq, {_IDX} as y from events),
      c as (select *, case when y is distinct from lag(y) over ({over} order by seq) then 1 else 0 end as ch from s),
      b as (select *, sum(ch) over ({over} order by seq rows unbounded preceding) as block_id from c)
      select {pick} min(seq) as start_seq, max(seq) as end_seq, count(*) as n, y as class_idx
      from b where y <> 0 group by {key} block_id, y"""


def _interval_sql():
    case = " ".join(f"when ts between timestamp '{s}' and timestamp '{e}' then '{n}'" for s, e, n in reversed(RULES))
    return f"""select event_id, case {case} else 'BENIGN' end as "Label" from events"""


def _chain_sql():
    case = " ".join(f"when g.w between timestamp '{s}' and timestamp '{e}' then '{n}'" for s, e, n in reversed(RULES))
    hourly = lambda c: f"select date_trunc('hour', ts) as w, sum(value) as b from events where event_type = '{c}' group by 1"
    return f"""with v as ({hourly('view')}), e as ({hourly(SPARSE[0])}), p as ({hourly(SPARSE[1])}),
      g as (select unnest(generate_series(min(w), max(w), interval 1 hour)) as w from v)
      select strftime(g.w, {SQL_TIME}) as at, round(coalesce(p.b, e.b, v.b, 0.0), 4) as bytes, case {case} else 'BENIGN' end as "Label"
      from g left join v on v.w = g.w left join e on e.w = g.w left join p on p.w = g.w
      where g.w between timestamp '{RANGE[0]}' and timestamp '{RANGE[1]}'"""


ORACLE = {
    "read_csv_dirty": f"""select event_id, case when event_id % 7 > 0 and event_id % 11 > 0 then value end as bytes,
      case when event_id % 3 > 0 then 'line ' || chr(10) || '"' || label || '"; ' || k || chr(10) end as note, label as "Label" from ({_FLOW})""",
    "read_csv": f"""select event_id, strftime(ts, {SQL_TIME}) as at, user_id as port, value as bytes, label as "Label" from ({_FLOW})""",
    "baseline": f"select event_id, value as bytes, strftime(ts, {SQL_TIME}) as at from events where event_type = 'view'",
    "dataset_chain": _chain_sql(),
    "seq_index": f"select event_id, {SQL_SEQ} as seq from events",
    "seq_by_key": f"select event_id, user_id, {SQL_SEQ_USER} as seq from events",
    "sort_by_time": f"select event_id, event_type, strftime(ts, {SQL_TIME}) as at from events order by ts, event_id",
    "class_counts": "select event_type as label, count(*) as n from events where event_type <> 'error' group by 1",
    "class_report": f"select label, count(*) as n from ({_FLOW}) group by 1 order by n desc, label",
    "benign_filter": f"select count(*) as n, round(sum(value), 2) as bytes from ({_FLOW}) where label = 'BENIGN'",
    "class_filter": """select event_id, event_type as "Label" from events where event_type in ('error', 'purchase')""",
    "window_summary": f"""{_SUMMARY} select strftime(w, {SQL_TIME}) as bucket, round(pe, 6) as port_entropy,
      round(ke, 6) as protocol_entropy, round(b, 4) as bytes, label as "Label" from s""",
    "gap_fill": f"""{_SUMMARY}, g as (select unnest(generate_series(min(w), max(w), interval '10 minutes')) as w from s)
      select strftime(g.w, {SQL_TIME}) as bucket, round(coalesce(pe, 0.0), 6) as port_entropy,
      round(coalesce(ke, 0.0), 6) as protocol_entropy, round(coalesce(b, 0.0), 4) as bytes,
      coalesce(label, 'BENIGN') as "Label" from g left join s using (w)""",
    "window_entropy": f"""select strftime(date_trunc('hour', ts), {SQL_TIME}) as bucket, round(entropy(user_id), 6) as entropy
      from events group by 1""",
    "window_mode": f"""with c as (select date_trunc('hour', ts) as w, event_type, count(*) as n from events group by all)
      select strftime(w, {SQL_TIME}) as bucket, event_type as label_mode from c
      qualify row_number() over (partition by w order by n desc, event_type) = 1""",
    "interval_label": _interval_sql(),
    "interval_label_join": f"""select e.event_id, coalesce(max_by(r.label, r.id), 'BENIGN') as Label
      from events e left join (values {_RULE_ROWS}) r(id, s, e, label) on e.ts between r.s and r.e group by e.event_id""",
    "interval_label_many": """with r as (select user_id as id, min(ts) as s, min(ts) + interval 2 days as e from events group by user_id)
      select e.event_id, coalesce('u' || max(r.id)::varchar, 'BENIGN') as Label from events e left join r on e.ts between r.s and r.e group by e.event_id""",
    "time_range": f"""select event_id, strftime(ts, {SQL_TIME}) as at from events
      where ts >= timestamp '{RANGE[0]}' and ts <= timestamp '{RANGE[1]}'""",
    "blocks": f"""with s as (select {SQL_SEQ} as seq, event_type from events),
      c as (select *, case when event_type is distinct from lag(event_type) over (order by seq) then 1 else 0 end as ch from s)
      select seq, event_type, cast(sum(ch) over (order by seq rows unbounded preceding) as bigint) as block_id from c""",
    "attack_regions": _regions(False),
    "attack_regions_by_key": _regions(True),
    "moving_average": f"""select seq, round(avg(value) over (order by seq rows 5 preceding), 6) as moving_average
      from (select {SQL_SEQ} as seq, value from events)""",
    "rolling_mean": f"""select seq, round(avg(value) over (order by seq rows 49 preceding), 6) as rolling_mean
      from (select {SQL_SEQ} as seq, value from events)""",
    "dedupe_first": f"""select min(seq) as seq, user_id, event_type
      from (select {SQL_SEQ} as seq, user_id, event_type from events) group by user_id, event_type""",
    "dedupe_last": """select user_id, event_id, value from events
      qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "slice_evenly": f"""with s as (select {SQL_SEQ} as seq, count(*) over () as n from events)
      select seq, cast(least(seq // (n // 7), 6) as integer) as slice from s""",
    "interleave": """with b as (select event_id, row_number() over (order by ts, event_id) - 1 as seq, count(*) over () as n
        from events where event_type = 'view'),
      a as (select event_id, case event_type when 'error' then 1 else 3 end as place,
        row_number() over (partition by event_type order by ts, event_id) - 1 as seq
        from events where event_type in ('error', 'purchase')),
      u as (select event_id, 2 * least(seq // (n // 3), 2) as place, seq from b union all select event_id, place, seq from a)
      select event_id, row_number() over (order by place, seq) - 1 as position from u""",
    "overlay": f"""with h as (select event_id, date_trunc('hour', ts) as w, value, event_type from events),
      b as (select * from h where event_type = 'view' qualify row_number() over (partition by w order by event_id) = 1),
      o as (select * from h where event_type in ('purchase', 'error')
        qualify row_number() over (partition by w order by case event_type when 'purchase' then 0 else 1 end desc, event_id desc) = 1)
      select strftime(b.w, {SQL_TIME}) as at, coalesce(o.event_id, b.event_id) as event_id, coalesce(o.value, b.value) as "Bytes",
      case when o.w is null then 1.0::double else 0.0::double end as "Packets", coalesce(o.event_type, b.event_type) as "Label",
      case when o.w is null then 0 else 1 end as replaced from b left join o on b.w = o.w""",
    "common_times": """select count(*) as common from (select distinct date_trunc('hour', ts) from events where event_type = 'view'
      intersect select distinct date_trunc('hour', ts) from events where event_type = 'error')""",
    "union_by_name": """select event_id, value, null::varchar as attack from events where event_type = 'view'
      union all select event_id, null::double, event_type from events where event_type <> 'view'
      union all select event_id, value, null::varchar from events where event_type = 'view'""",
    "lenient_parse": f"select event_id, value as num, strftime(ts, {SQL_TIME}) as at from events where event_id % 3 <> 0",
}
