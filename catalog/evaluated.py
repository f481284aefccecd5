"""Queries on metrics: the events value is the score, truth is planted (value above a level)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SQL_SEQ, SQL_SEQ_USER, scores, stream, table
from flowstream.functions import columns as C
from flowstream.operators import evaluation as E

# Fixed values of the metric queries.
THRESHOLDS = [round(0.05 * i, 2) * 1000 for i in range(1, 20)]
CUT = 120.0
WARMUP = 100
WINDOW = 250


def _predicted(spark, d, by=None):
    return scores(spark, d, by).withColumn("pred", C.discretize(F.col("score"), CUT))


def _multi(spark, d):
    """Five-class truth and a prediction derived from it and the row position."""
    s = stream(spark, d, "event_type")
    y = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    wrong = F.col("event_id") % 4 == 0
    return s.select("seq", y.alias("truth"), F.when(F.col("event_id") % 10 == 9, None).when(wrong, (y + 1) % 5).otherwise(y).alias("pred"))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def fixed_threshold(spark, d):
    return _predicted(spark, d).select("seq", "truth", "pred")


def confusion(spark, d):
    return E.confusion(_predicted(spark, d))


def confusion_by_key(spark, d):
    return E.confusion(_predicted(spark, d, "user_id"), by="user_id")


def f1_class(spark, d):
    return _round(E.binary_metrics(_predicted(spark, d), target=1), "f1", "precision", "recall")


def f1_macro(spark, d):
    return _round(E.binary_metrics(_multi(spark, d), target=None), "f1", "precision", "recall")


def collapsed_metrics(spark, d):
    m = _multi(spark, d)
    m = m.select("seq", C.encode_index(F.col("truth")).alias("truth"), C.collapse_prediction(F.col("pred")).alias("pred"))
    return _round(E.binary_metrics(m, target=1), "f1", "precision", "recall")


def cumulative_report(spark, d):
    """Per user: metrics after a warm-up; users with fewer rows keep them all."""
    out = E.cumulative_report(_predicted(spark, d, "user_id"), warmup=60, target=None, by=["user_id"])
    return _round(out, "f1", "precision", "recall")


def prequential_history(spark, d):
    out = E.prequential_history(_predicted(spark, d), WINDOW, WARMUP, target=1, block_rows=8)
    return _round(out, "f1", "precision", "recall")


def prequential_history_macro(spark, d):
    m = _multi(spark, d).withColumn("pred", F.coalesce("pred", F.lit(0)))
    out = E.prequential_history(m, WINDOW, WARMUP, target=None)
    return _round(out, "f1", "precision", "recall")


def windowed_metrics(spark, d):
    out = E.windowed_metrics(_predicted(spark, d), WINDOW)
    return _round(out, "accuracy", "f1", "precision", "recall")


def auc(spark, d):
    s = stream(spark, d, "value", "user_id")
    s = s.select(F.round("value", 0).alias("score"), (F.col("user_id") % 3 == 0).cast("int").alias("truth"))
    return _round(E.auc(s, block_rows=64), "auc")


def auc_by_key(spark, d):
    s = scores(spark, d, "user_id").withColumn("score", F.floor("score"))
    return _round(E.auc(s, by="user_id"), "auc")


def windowed_auc(spark, d):
    s = stream(spark, d, "value", "user_id")
    s = s.select("seq", F.round("value", 0).alias("score"), (F.col("user_id") % 3 == 0).cast("int").alias("truth"))
    return _round(E.windowed_auc(s, WINDOW), "auc")


def cumulative_accuracy(spark, d):
    m = _multi(spark, d).withColumn("learner", F.concat(F.lit("L"), (F.col("seq") % 4).cast("string")))
    return _round(E.cumulative_accuracy(m.withColumn("pred", F.coalesce("pred", F.lit(-1)))), "accuracy")


def threshold_sweep(spark, d):
    out = E.threshold_sweep(scores(spark, d), [t / 2 for t in THRESHOLDS], target=None)
    return _round(out, "f1", "precision", "recall")


def _picks(spark, d):
    """Per order priority the five best line numbers by revenue stand for features picked per data set."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("v"))
    from flowstream.operators.sampling import top_k
    best = top_k(li, "v", 3, ["l_suppkey"], ["l_linenumber"])
    return best.select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"),
                       (F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("pos"))


def feature_votes(spark, d):
    return E.feature_votes(_picks(spark, d), 5)


def distinct_features(spark, d):
    return _picks(spark, d).select("feature").distinct()


def best_trial(spark, d):
    """One trial per (user, threshold): the best threshold of each user."""
    sweep = E.threshold_sweep(scores(spark, d, "user_id"), [50.0, 100.0, 140.0, 150.0, 180.0], target=1, by=["user_id"])
    trials = sweep.withColumn("trial", F.floor("threshold").cast("int"))
    return _round(E.best_trial(trials, by=["user_id"]), "f1", "precision", "recall")


QUERIES = {f.__name__: f for f in [
    fixed_threshold, confusion, confusion_by_key, f1_class, f1_macro, collapsed_metrics, cumulative_report, prequential_history,
    prequential_history_macro, windowed_metrics, auc, auc_by_key, windowed_auc, cumulative_accuracy, threshold_sweep,
    feature_votes, distinct_features, best_trial]}


def _f(tp, fp, fn):
    r = lambda a, b: f"round(case when {b} > 0 then ({a}) / ({b}) else 0 end * 100.0, 6)"
    return (f"{r(f'2.0 * {tp}', f'2.0 * {tp} + {fp} + {fn}')} as f1, {r(f'1.0 * {tp}', f'{tp} + {fp}')} as precision, "
            f"{r(f'1.0 * {tp}', f'{tp} + {fn}')} as recall")


def _raw(tp, fp, fn):
    r = lambda a, b: f"case when {b} > 0 then ({a}) / ({b}) else 0 end * 100.0"
    return (f"{r(f'2.0 * {tp}', f'2.0 * {tp} + {fp} + {fn}')} as f1, {r(f'1.0 * {tp}', f'{tp} + {fp}')} as precision, "
            f"{r(f'1.0 * {tp}', f'{tp} + {fn}')} as recall")


_P = f"select user_id, {SQL_SEQ} as seq, value as score, (value > 150)::integer as truth, (value > {CUT})::integer as pred from events"
_PU = f"select user_id, {SQL_SEQ_USER} as seq, value as score, (value > 150)::integer as truth, (value > {CUT})::integer as pred from events"
_Y = "case event_type when 'view' then 0 when 'click' then 1 when 'error' then 2 else 3 end"
_M = f"""select {SQL_SEQ} as seq, {_Y} as truth, case when event_id % 10 = 9 then null when event_id % 4 = 0
  then ({_Y} + 1) % 5 else {_Y} end as pred from events"""


def _binary(src, key=""):
    k, g = (f"{key}, ", f"group by {key}") if key else ("", "")
    return f"""with p as ({src}), c as (select {k} count(*) filter (truth = 1 and pred = 1) as tp,
      count(*) filter (truth <> 1 and pred = 1) as fp, count(*) filter (truth = 1 and pred <> 1) as fn from p {g})
      select {k} {_f('tp', 'fp', 'fn')} from c"""


def _macro(src, key=""):
    k, g, j = (f"{key}, ", f"group by {key}", f"and p.{key} = k.{key}") if key else ("", "", "")
    kk = f"k.{key}, " if key else ""
    return f"""with p as ({src}), k as (select {k} truth as cls from p union select {k} pred from p),
      c as (select {kk} cls, count(*) filter (truth = cls and pred = cls) as tp, count(*) filter (truth <> cls and pred = cls) as fp,
        count(*) filter (truth = cls and pred is distinct from cls) as fn from k join p on cls is not null {j} group by {kk} cls),
      m as (select {k} {_raw('tp', 'fp', 'fn')} from c)
      select {k} round(avg(f1), 6) as f1, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall from m {g}"""


def _history(src, classes):
    sums = ", ".join(f"""sum((truth = {c} and pred = {c})::integer) over w as tp{c}, sum((truth <> {c} and pred = {c})::integer) over w as fp{c},
      sum((truth = {c} and pred <> {c})::integer) over w as fn{c}""" for c in classes)
    r = lambda a, b: f"case when {b} > 0 then 1.0 * ({a}) / ({b}) else 0 end"
    mean = lambda parts: f"round(({' + '.join(parts)}) * 100.0 / {len(classes)}, 6)"
    f1 = mean([r(f"2 * tp{c}", f"2 * tp{c} + fp{c} + fn{c}") for c in classes])
    pr = mean([r(f"tp{c}", f"tp{c} + fp{c}") for c in classes])
    rc = mean([r(f"tp{c}", f"tp{c} + fn{c}") for c in classes])
    return f"""with p as ({src}), r as (select seq, {sums} from p where seq >= {WARMUP} window w as (order by seq rows unbounded preceding))
      select seq as at_seq, {f1} as f1, {pr} as precision, {rc} as recall from r where seq > 0 and seq % {WINDOW} = 0"""


def _auc(src, key=""):
    k = f"{key}, " if key else ""
    part = f"partition by {key}" if key else ""
    g = f"group by {key}" if key else ""
    return f"""with p as ({src}), r as (select *, rank() over ({part} order by score) as lo, count(*) over ({part and part + ','} {'' if part else 'partition by'} score) as same from p),
      s as (select {k} sum(truth)::bigint as positives, (count(*) - sum(truth))::bigint as negatives, sum(case when truth = 1 then lo + (same - 1) / 2.0 end)::double as rs from r {g})
      select {k} positives, negatives, round(case when positives > 0 and negatives > 0 then (rs - positives * (positives + 1) / 2.0) / (positives * negatives)::double end, 6) as auc from s"""


_GRID = ", ".join(f"({t / 2})" for t in THRESHOLDS)
_THIRD = f"select {SQL_SEQ} as seq, round(value, 0) as score, (user_id % 3 = 0)::integer as truth from events"
_PICKS = """select 'f' || l_linenumber::varchar as feature, l_suppkey * 100 + l_linenumber as pos from
  (select l_suppkey, l_linenumber, sum(l_extendedprice) as v from lineitem group by all)
  qualify row_number() over (partition by l_suppkey order by v desc, l_linenumber) <= 3"""

ORACLE = {
    "fixed_threshold": f"select seq, truth, pred from ({_P})",
    "confusion": f"select truth, pred, count(*) as n from ({_P}) group by all",
    "confusion_by_key": f"select user_id, truth, pred, count(*) as n from ({_PU}) group by all",
    "f1_class": _binary(_P),
    "f1_macro": _macro(f"select * from ({_M})"),
    "collapsed_metrics": _binary(f"select seq, (truth <> 0)::integer as truth, (coalesce(pred, 0) > 0)::integer as pred from ({_M})"),
    "cumulative_report": _macro(f"select * from (select *, count(*) over (partition by user_id) as n from ({_PU})) where seq >= 60 or n <= 60", "user_id"),
    "prequential_history": _history(_P, [1]),
    "prequential_history_macro": _history(f"select seq, truth, coalesce(pred, 0) as pred from ({_M})", [0, 1]),
    "windowed_metrics": f"""with p as ({_P}), c as (select seq // {WINDOW} as window_id, count(*) as n, count(*) filter (truth = pred) as ok,
      count(*) filter (truth = 1 and pred = 1) as tp, count(*) filter (truth <> 1 and pred = 1) as fp,
      count(*) filter (truth = 1 and pred <> 1) as fn from p group by 1)
      select window_id, n, round(ok * 100.0 / n, 6) as accuracy, {_f('tp', 'fp', 'fn')} from c""",
    "auc": _auc(_THIRD),
    "auc_by_key": _auc(f"select user_id, seq, floor(score) as score, truth from ({_PU})", "user_id"),
    "windowed_auc": f"select window_id, auc from ({_auc(f'select *, seq // {WINDOW} as window_id from ({_THIRD})', 'window_id')})",
    "cumulative_accuracy": f"select 'L' || (seq % 4)::varchar as learner, round(count(*) filter (truth = coalesce(pred, -1)) * 100.0 / count(*), 6) as accuracy from ({_M}) group by 1",
    "threshold_sweep": _macro(f"select g.threshold, truth, (score > g.threshold)::integer as pred from ({_P}) p, (select threshold::double as threshold from (values {_GRID}) g(threshold)) g", "threshold"),
    "feature_votes": f"select feature, count(*) as votes, min(pos) as first_seen from ({_PICKS}) group by 1 order by votes desc, first_seen limit 5",
    "distinct_features": f"select distinct feature from ({_PICKS})",
    "best_trial": f"""with p as (select user_id, threshold::double as threshold, truth, (score > threshold)::integer as pred from ({_PU}) p,
        (values (50.0), (100.0), (140.0), (150.0), (180.0)) g(threshold)),
      c as (select user_id, threshold, count(*) filter (truth = 1 and pred = 1) as tp, count(*) filter (truth <> 1 and pred = 1) as fp,
        count(*) filter (truth = 1 and pred <> 1) as fn from p group by all)
      select user_id, threshold, {_f('tp', 'fp', 'fn')}, threshold::integer as trial from c
      qualify row_number() over (partition by user_id order by f1 desc, threshold) = 1""",
}
