"""Queries on samples, scenarios and feature preparation (events, lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import events, flows, stream, table
from flowstream.functions import columns as C
from flowstream.operators import ordering as O
from flowstream.operators import profile as P
from flowstream.operators import sampling as S
from flowstream.operators.windowing import dedupe_rows
from flowstream.plans.preparation import prepare
from flowstream.plans.scenarios import build_scenario

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
BLOCKS = [("s", 40, ["error"]), ("s", 60, ["click", "error"]), ("s", 30), ("s", 25, "purchase"), ("s", 50, ["error"])]


def random_sample(spark, d):
    return S.random_sample(events(spark, d).select("event_id", "event_type"), 500, ["event_id"])


def balanced_sample(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return S.balanced_sample(e, 100, ["event_id"], "event_type", ignored=["error"])


def stratified_sample(spark, d):
    return S.stratified_sample(events(spark, d).select("event_id", "user_id"), 400, ["event_id"], "user_id")


def class_quota(spark, d):
    return S.check_class_quota(S.class_counts(events(spark, d), "event_type"), 210, allow_insufficient=True)


def take_blocks(spark, d):
    s = stream(spark, d, "event_type").withColumn("source_file", F.lit("s"))
    return S.take_blocks(s, BLOCKS, "source_file", "event_type")[0].select("event_id", "block")


def scenario(spark, d):
    """Benign flows cut to 1,000 stratified rows, two attack blocks put between their slices."""
    f = flows(spark, d).withColumnRenamed("Source Port", "Destination Port").withColumn("source_file", F.lit("s"))
    out = build_scenario(f, [("s", 30, ["error"]), ("s", 40, ["purchase", "error"])], id_cols=["event_id"],
                         n_benign=300, sort_by_timestamp=False, remove_duplicates=True)
    return out.select("event_id", "Label", "position")


def _lines(spark, d):
    """Lineitem features with nulls and a dependent and a constant column."""
    li = table(spark, d, "lineitem")
    gap = F.col("l_orderkey") % 7 == 0
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(~gap, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax",
        (F.col("l_discount") * 2 + F.col("l_tax") * 0.05).alias("dep"), F.lit(5.0).alias("const"))


LINES_SQL = """select l_orderkey, l_linenumber, l_returnflag, case when l_orderkey % 7 <> 0 then l_quantity end as l_quantity,
  case when l_orderkey % 11 <> 0 then l_extendedprice end as l_extendedprice, l_discount, l_tax,
  l_discount * 2 + l_tax * 0.05 as dep, 5.0::double as const from lineitem"""
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "dep", "const"]


def _impute(method):
    def run(spark, d):
        out = P.impute(_lines(spark, d), NUMS[:2], method)
        return out.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_extendedprice"), 0).alias("p"),
                                               F.count("l_quantity").alias("n"), F.round(F.min("l_quantity"), 4).alias("lo"))
    return run


def _scale(method):
    def run(spark, d):
        out = P.scale(P.impute(_lines(spark, d), NUMS, "mediana"), NUMS, method)
        return out.select("l_orderkey", "l_linenumber", *[F.round(C.col(c), 6).alias(c) for c in NUMS])
    return run


def quantile_passes(spark, d):
    """Quartiles with the passes for large tables forced on."""
    qs = P.exact_quantiles(_lines(spark, d), NUMS[:3], [0.25, 0.5, 0.98], exact_values=0, gather_values=20_000)
    rows = [(c, p, round(v, 6)) for c, vs in qs.items() for p, v in zip([0.25, 0.5, 0.98], vs)]
    return spark.createDataFrame(rows, "feature string, p double, value double")


def clamp_infinity(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", 
                                            F.when(F.col("l_tax") == 0, float("inf")).when(F.col("l_discount") == 0, float("-inf")).otherwise(F.col("l_tax")).alias("x"))
    return C.clamp_infinity(li, ["x"]).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def low_variance(spark, d):
    kept = P.drop_low_variance(P.scale(P.impute(_lines(spark, d), NUMS), NUMS, "MinMaxScaler"), NUMS, 0.09)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def corr_matrix(spark, d):
    m = P.correlation_matrix(_lines(spark, d), NUMS)
    return m.select("a", "b", F.round("r", 6).alias("r"))


def corr_matrix_wide(spark, d):
    """All 2,016 pairs of the 64 embedding dimensions in one pass."""
    cols = [f"f{i}" for i in range(64)]
    e = table(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return P.correlation_matrix(e, cols).select("a", "b", F.round("r", 6).alias("r"))


def drop_correlated(spark, d):
    kept = P.drop_correlated(_lines(spark, d), NUMS, 0.5)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def label_dictionary(spark, d):
    s = stream(spark, d, "event_type").withColumn("lab", F.when(F.col("event_type") == "view", "Benign").otherwise(F.concat(F.lit(" "), "event_type")))
    return P.label_dictionary(s, "lab", "seq")


def encode_labels(spark, d):
    s = stream(spark, d, "event_type")
    names = P.label_dictionary(s.filter("event_type <> 'error'").replace("view", "NORMAL", ["event_type"]), "event_type", "seq")
    out = P.encode_labels(s.replace("view", "NORMAL", ["event_type"]), "event_type", names)
    out = P.class_names(out, names, "class_idx")
    return out.select("event_id", "class_idx", "class_name", C.encode_binary(F.col("event_type")).alias("attack"),
                      C.encode_index(F.col("class_idx"), 0).alias("not_normal"))


def class_signature(spark, d):
    s = P.class_signature(table(spark, d, "lineitem"), FEATURES, "l_returnflag")
    return s.select("class", *[F.round(c, 4).alias(c) for c in FEATURES])


def class_distance(spark, d):
    x = P.class_distance(events(spark, d).withColumn("h", F.hour("ts")), ["value", "user_id", "h"], "event_type")
    return x.select("a", "b", F.round("distance", 6).alias("distance"))


def feature_distance(spark, d):
    x = P.feature_distance(events(spark, d).withColumn("h", F.hour("ts")), ["value", "user_id", "h"], "event_type")
    return x.select("a", "b", F.round("distance", 6).alias("distance"))


def top_k(spark, d):
    return S.top_k(events(spark, d).select("event_type", "event_id", "value"), "value", 10, ["event_type"], ["event_id"])


def prepared(spark, d):
    """The whole preparation chain on lineitem: features, class index, kept columns."""
    li = _lines(spark, d).withColumnRenamed("l_returnflag", "Label").withColumnRenamed("dep", " dep ")
    out = prepare(li, label=" Label", order_by=["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], normalize="MinMaxScaler", imputation="mediana",
                  threshold_var=0.005, threshold_corr=0.5, binary=True, extra_ignore=["l_orderkey", "l_linenumber"])
    f = out.features
    return out.table.groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(f)).alias("kept"),
                                              *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in f])


QUERIES = {f.__name__: f for f in [
    random_sample, balanced_sample, stratified_sample, class_quota, take_blocks, scenario, quantile_passes, clamp_infinity,
    low_variance, corr_matrix, corr_matrix_wide, drop_correlated, label_dictionary, encode_labels, class_signature, class_distance,
    feature_distance, top_k]}
QUERIES |= {"impute_mean": _impute("media"), "impute_median": _impute("mediana"), "impute_mode": _impute("moda"),
            "impute_zero": _impute("0"), "scale_minmax": _scale("MinMaxScaler"), "scale_standard": _scale("StandardScaler"),
            "scale_robust": _scale("RobustScaler"), "prepare": prepared}


def _hash(c="event_id", seed="42"):
    return f"md5('{seed}|' || {c}::varchar)"


def _impute_sql(fill):
    return f"""with l as ({LINES_SQL}), m as (select {fill('l_quantity')} as q, {fill('l_extendedprice')} as p from l)
      select l_returnflag, round(sum(coalesce(l_quantity, m.q)), 2) as q, round(sum(coalesce(l_extendedprice, m.p)), 0) as p,
      count(*) as n, round(min(coalesce(l_quantity, m.q)), 4) as lo from l, m group by 1"""


def _scale_sql(a, w):
    med = ", ".join(f"median({c}) as {c}" for c in NUMS)
    fill = ", ".join(f"coalesce(l.{c}, m.{c}) as {c}" for c in NUMS)
    stats = ", ".join(f"{a(c)} as a_{c}, {w(c)} as w_{c}" for c in NUMS)
    out = ", ".join(f"round(({c} - a_{c}) / case when w_{c} = 0 then 1 else w_{c} end, 6) as {c}" for c in NUMS)
    return f"""with l as ({LINES_SQL}), m as (select {med} from l),
      x as (select l_orderkey, l_linenumber, {fill} from l, m), s as (select {stats} from x)
      select l_orderkey, l_linenumber, {out} from x, s"""


def _corr_sql():
    parts = [f"select '{a}' as a, '{b}' as b, abs(corr({a}, {b})) as r from l" for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]
    return f"with l as ({LINES_SQL}), c as ({' union all '.join(parts)})"


def _distance_sql(left, axis):
    return f"""with e as (select event_type, value, user_id::double as user_id, hour(ts)::double as h from events),
      s as (select event_type as class, avg(value) as value, avg(user_id) as user_id, avg(h) as h from e group by 1),
      u as (unpivot s on value, user_id, h into name feature value m),
      z as (select class, feature, (m - min(m) over w) / (max(m) over w - min(m) over w) as v from u window w as (partition by feature))
      select x.{left} as a, y.{left} as b, round(sqrt(sum((x.v - y.v) ** 2)), 6) as distance
      from z x join z y on x.{axis} = y.{axis} and x.{left} < y.{left} group by 1, 2"""


def _take_sql():
    seq = "(row_number() over (order by ts, event_id) - 1)"
    # each item: first n rows, by seq, of the rows no earlier item took
    parts, prev = [f"s as (select event_id, event_type, {seq} as seq from events)"], []
    for i, item in enumerate(BLOCKS):
        labels = item[2] if len(item) > 2 else None
        labels = [labels] if isinstance(labels, str) else labels
        where = f"event_type in ({', '.join(repr(x) for x in labels)})" if labels else "true"
        rest = " and ".join(f"event_id not in (select event_id from b{j})" for j in prev) or "true"
        parts.append(f"b{i} as (select event_id, {i} as block from s where {where} and {rest} order by seq limit {item[1]})")
        prev.append(i)
    return f"with {', '.join(parts)} " + " union all ".join(f"select * from b{i}" for i in prev)


def _scenario_sql():
    h = _hash()
    return f"""with f as (select event_id, ts, user_id, event_type from events),
      b as (select *, count(*) over () as n, count(*) over (partition by user_id) as g,
        row_number() over (partition by user_id order by {h}) as r from f where event_type = 'view'),
      q as (select *, round_even(g / n::double * 300, 0) as quota from b),
      c as (select event_id, ts from q where r <= quota),
      k as (select (select count(*) from c) as k),
      top as (select event_id, ts from (select *, row_number() over (order by {h}) as rr from q where r > quota), k where rr <= 300 - k),
      cut as (select event_id, ts from (select *, row_number() over (order by {_hash(seed='42-cut')}) as rr from c) where rr <= 300),
      base as (select * from cut union all select * from top),
      bs as (select event_id, row_number() over (order by ts, event_id) - 1 as seq, count(*) over () as n from base),
      s as (select event_id, event_type, ts, row_number() over (order by ts, event_id) as seq from events),
      a0 as (select event_id, seq from s where event_type = 'error' order by seq limit 30),
      a1 as (select event_id, seq from s where event_type in ('purchase', 'error') and event_id not in (select event_id from a0) order by seq limit 40),
      u as (select event_id, 2 * least(seq // (n // 3), 2) as place, seq from bs
        union all select event_id, 1, seq from a0 union all select event_id, 3, seq from a1)
      select u.event_id, case when e.event_type = 'view' then 'BENIGN' else e.event_type end as "Label",
        row_number() over (order by place, seq) - 1 as position from u join events e using (event_id)"""


def _prepare_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    med = ", ".join(f"median({c}) as {c}" for c in cols)
    fill = ", ".join(f"coalesce(l.{c}, m.{c}) as {c}" for c in cols)
    avg = ", ".join(f"round(avg(({c} - (select min({c}) from x)) / (select max({c}) - min({c}) from x)), 6) as avg_{c}" for c in cols)
    return f"""with l as ({LINES_SQL}), m as (select {med} from l), x as (select {fill} from l, m)
      select 1 as class_idx, count(*) as n, '{",".join(cols)}' as kept, {avg} from x"""


ORACLE = {
    "random_sample": f"select event_id, event_type from events order by {_hash()} limit 500",
    "balanced_sample": f"""select event_id, event_type from events where event_type <> 'error'
      qualify row_number() over (partition by event_type order by {_hash()}) <= 100""",
    "stratified_sample": f"""with b as (select event_id, user_id, count(*) over () as n, count(*) over (partition by user_id) as g,
        row_number() over (partition by user_id order by {_hash()}) as r from events),
      q as (select *, round_even(g / n::double * 400, 0) as quota from b),
      c as (select event_id, user_id from q where r <= quota), k as (select count(*) as k from c),
      top as (select event_id, user_id from (select *, row_number() over (order by {_hash()}) as rr from q where r > quota), k where rr <= 400 - k),
      cut as (select event_id, user_id from (select *, row_number() over (order by {_hash(seed='42-cut')}) as rr from c) where rr <= 400)
      select * from cut union all select * from top""",
    "class_quota": "select event_type as label, least(count(*), 210) as _quota from events group by 1",
    "take_blocks": _take_sql(),
    "scenario": _scenario_sql(),
    "quantile_passes": f"""with l as ({LINES_SQL}), p as (select unnest([0.25, 0.5, 0.98])::double as p)
      select 'l_quantity' as feature, p, round(quantile_cont(l_quantity, [0.25, 0.5, 0.98])[case p when 0.25 then 1 when 0.5 then 2 else 3 end], 6) as value from l, p group by p
      union all select 'l_extendedprice', p, round(quantile_cont(l_extendedprice, [0.25, 0.5, 0.98])[case p when 0.25 then 1 when 0.5 then 2 else 3 end], 6) from l, p group by p
      union all select 'l_discount', p, round(quantile_cont(l_discount, [0.25, 0.5, 0.98])[case p when 0.25 then 1 when 0.5 then 2 else 3 end], 6) from l, p group by p""",
    "clamp_infinity": """select case when l_tax = 0 then 3.4028234663852886e38 when l_discount = 0 then -3.4028234663852886e38 else l_tax end::double as x,
      count(*) as n from lineitem group by 1""",
    "low_variance": f"""with l as ({LINES_SQL}), z as (select coalesce(l_quantity, 0) as l_quantity, coalesce(l_extendedprice, 0) as l_extendedprice, l_discount, l_tax, dep from l),
      v as (select {", ".join(f"var_pop({c}) / (max({c}) - min({c})) ** 2 as {c}" for c in NUMS[:5])} from z)
      select feature from (unpivot v on {", ".join(NUMS[:5])} into name feature value x) where x > 0.09""",
    "corr_matrix": f"{_corr_sql()} select a, b, case when b = 'const' or a = 'const' then null else round(r, 6) end as r from c",
    "corr_matrix_wide": """with e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)
      select 'f' || x.i as a, 'f' || y.i as b, round(abs(corr(x.v, y.v)), 6) as r
      from e x join e y on x.vec_id = y.vec_id and x.i < y.i group by x.i, y.i""",
    "drop_correlated": f"""{_corr_sql()} select feature from (select unnest([{", ".join(repr(c) for c in NUMS)}]) as feature)
      where feature not in (select b from c where a <> 'const' and b <> 'const' and r > 0.5)""",
    "label_dictionary": """with f as (select case when event_type = 'view' then 'Benign' else event_type end as name,
      min(ts) as t from events group by 1)
      select cast(row_number() over (order by name <> 'Benign', t) - 1 as integer) as idx, name from f""",
    "encode_labels": """with e as (select event_id, ts, case when event_type = 'view' then 'NORMAL' else event_type end as l from events),
      f as (select l, min(ts) as t from e where l <> 'error' group by 1),
      d as (select l, cast(row_number() over (order by l <> 'NORMAL', t) - 1 as integer) as idx from f)
      select event_id, coalesce(idx, -1) as class_idx, coalesce(d.l, 'Ataque -1') as class_name, 1 as attack,
      case when idx = 0 then 0 else 1 end as not_normal from e left join d using (l)""",
    "class_signature": f"select l_returnflag as class, {', '.join(f'round(avg({c}), 4) as {c}' for c in FEATURES)} from lineitem group by 1",
    "class_distance": _distance_sql("class", "feature"),
    "feature_distance": _distance_sql("feature", "class"),
    "top_k": """select event_type, event_id, value from events
      qualify row_number() over (partition by event_type order by value desc, event_id) <= 10""",
    "impute_mean": _impute_sql(lambda c: f"avg({c})"),
    "impute_median": _impute_sql(lambda c: f"median({c})"),
    "impute_mode": _impute_sql(lambda c: f"any_value((select {c} from l where {c} is not null group by 1 order by count(*) desc, {c} limit 1))"),
    "impute_zero": _impute_sql(lambda c: "any_value(0.0::double)"),
    "scale_minmax": _scale_sql(lambda c: f"min({c})", lambda c: f"max({c}) - min({c})"),
    "scale_standard": _scale_sql(lambda c: f"avg({c})", lambda c: f"stddev_pop({c})"),
    "scale_robust": _scale_sql(lambda c: f"median({c})", lambda c: f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "prepare": _prepare_sql(),
}
