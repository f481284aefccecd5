"""Facts that must hold for operators whose rows SQL can't compute: seeded forests, serial detectors, growing trees.

Each query runs the operators over the whole table and returns counts and findings on planted signals, which SQL states.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.learned import FEATURES as LINE_FEATURES
from catalog.learned import WINDOW_ROWS, _supplier_lines
from catalog.scored import FEATURES, _stream
from catalog.stateful import GRID, SETTINGS, WARMUP, _days, _user_errors
from catalog.stepped import CLASSIFIER, _replayed
from flowstream.operators import drift as D
from flowstream.operators import evaluation as E
from flowstream.operators import learners as L
from flowstream.operators import scoring as S
from flowstream.operators import thresholds as T
from flowstream.operators.ordering import with_seq
from flowstream.session import written
from flowstream.streaming import live as V

# Fixed values of these queries.
WINDOW = 250
SCORERS = {"HST": {"window": WINDOW, "trees": 25}, "OIF": {"window": WINDOW, "trees": 25}, "RRCF": {"tree_size": WINDOW, "trees": 10},
           "AIF": {"window": WINDOW, "trees": 30, "m_trees": 10}, "AE": {"hidden": 1, "learning_rate": 0.05}}
FOREST = ["HalfSpaceTrees", "OnlineIsolationForest", "RobustRandomCutForest", "AdaptiveIsolationForest"]
LEARNERS = {"LB": {"members": 5}, "ARF": {"members": 5, "max_features": 0.8}}


def scorer_facts(spark, d):
    """Per scorer: rows, rows without a score, scores outside [0, 1], and whether the planted rows (large values) stand out."""
    s = _stream(spark, d)
    # written, because the counts and the areas read it, and scoring is nearly all of the work
    got = written(S.prequential_score(s, FEATURES, S.scorers(None, SCORERS), WINDOW, keep=["truth"]), "scores")
    score = F.col("score")
    counts = got.groupBy("algorithm").agg(F.count("*").alias("n"), F.count_if(score.isNull()).alias("unscored"), F.count_if(~score.between(0, 1)).alias("outside"))
    area = E.auc(got.filter(F.col("algorithm").isin(FOREST) & score.isNotNull()), by="algorithm").select(F.col("algorithm").alias("_a"), (F.col("auc") > 0.9).alias("found"))
    return counts.join(area, F.col("algorithm") == F.col("_a"), "left").drop("_a")


def learner_facts(spark, d):
    """Per learner over each supplier's stream: rows, rows of the first window not predicted as class 0 (nothing is learned before it),
    and whether over 90 % of the rows from the fourth window on are right."""
    configured = L.learners(None, LEARNERS)
    got = L.prequential_classify(_supplier_lines(spark, d), LINE_FEATURES, configured, WINDOW_ROWS, 2, keys="l_suppkey")
    later = F.col("seq") >= 3 * WINDOW_ROWS
    right = F.avg(F.when(later, (F.col("truth") == F.col("pred")).cast("double")))
    return got.groupBy("learner").agg(F.count("*").alias("n"), F.count_if((F.col("seq") < WINDOW_ROWS) & (F.col("pred") != 0)).alias("early"), (right > 0.9).alias("learned"))


def drift_recovery(spark, d):
    """Per adaptive ensemble, the target turned round half way through each supplier's stream: whether it is right again in over 60 % of
    the last quarter's rows, where a tree that keeps what it learned is mostly wrong."""
    s = _supplier_lines(spark, d)
    size = s.groupBy(F.col("l_suppkey").alias("_supplier")).agg(F.count("*").alias("_n"))
    s = s.join(size, F.col("l_suppkey").eqNullSafe(F.col("_supplier"))).withColumn("late", (F.col("seq") * 4 >= F.col("_n") * 3).cast("int"))
    turned = s.withColumn("class_idx", F.when(F.col("seq") * 2 < F.col("_n"), F.col("class_idx")).otherwise(1 - F.col("class_idx")))
    got = L.prequential_classify(turned, LINE_FEATURES, L.learners(["LB", "ARF"], LEARNERS), 25, 2, keys="l_suppkey", keep=["late"])
    right = F.avg(F.when(F.col("late") == 1, (F.col("truth") == F.col("pred")).cast("double")))
    return got.groupBy("learner").agg(F.count("*").alias("n"), (right > 0.6).alias("recovered"))


def dspot_facts(spark, d):
    """Per day: rows, quiet rows (warm-up, all columns 0), and rows whose alert does not follow from score and threshold."""
    got = T.dspot(_days(spark, d), warmup=WARMUP, **SETTINGS)
    quiet = (F.col("pred") == 0) & (F.col("threshold") == 0) & (F.col("trend") == 0)
    wrong = (F.col("pred") == 1) != (F.col("score") > F.col("threshold"))
    return got.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(quiet).alias("quiet"), F.count_if(~quiet & (F.col("pred") == 1) & wrong).alias("wrong"))


def dspot_parity(spark, d):
    """Per day: rows for which DSPOT over short segments, live, or as one of several sweep trials differs from one uninterrupted run."""
    e = _days(spark, d)
    values = ["pred", "threshold", "trend"]
    times = e.withColumn("ts", F.to_timestamp("stream_id") + F.make_dt_interval(secs=F.col("seq").cast("decimal(18,6)")))
    live = V.run_to_table(V.dspot_stream(_replayed(spark, times.select("stream_id", "seq", "ts", "score")), delay="1 hour", warmup=WARMUP, **SETTINGS), "alerts")
    trial = T.dspot_trials(e, [*GRID, (SETTINGS["q"], SETTINGS["depth"], SETTINGS["t_quantile"])], WARMUP).filter(F.col("_trial") == str(len(GRID)))
    forms = {"whole": T.dspot(e, warmup=WARMUP, **SETTINGS), "segments": T.dspot(e, warmup=WARMUP, segment_rows=150, **SETTINGS), "live": live, "trial": trial}
    parts = [df.select("stream_id", "seq", *values, F.lit(name).alias("form")) for name, df in forms.items()]
    rows = reduce(DataFrame.unionByName, parts)
    same = rows.groupBy("stream_id", "seq").agg(F.count("*").alias("forms"), F.count_distinct(F.struct(*values)).alias("kinds"))
    return same.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if((F.col("forms") != len(forms)) | (F.col("kinds") != 1)).alias("differences"))


def adwin_facts(spark, d):
    """ADWIN on one long error stream per class of users, whose rate jumps from .1 to .6 half way: whether its first change
    comes within 200 rows of the jump."""
    e = _user_errors(spark, d).select((F.col("user_id") % 3).alias("stream_id"), "user_id", F.col("seq").alias("at"), "error")
    half = e.groupBy(F.col("user_id").alias("_user")).agg(F.expr("count(*) div 2").alias("_half"))
    e = e.join(half, F.col("user_id") == F.col("_user")).withColumn("late", F.col("at") >= F.col("_half"))
    s = with_seq(e.select("stream_id", "late", "at", "user_id", "error"), ["late", "at", "user_id"], by="stream_id")
    states = D.adwin(s.select("stream_id", "seq", "error"), "stream_id").filter("state = 'change'").groupBy("stream_id").agg(F.min("seq").alias("first"))
    jump = s.groupBy(F.col("stream_id").alias("_s")).agg(F.count("*").alias("n"), F.count_if(~F.col("late")).alias("jump"))
    out = jump.join(states, F.col("stream_id") == F.col("_s"), "left")
    return out.select(F.col("_s").alias("stream_id"), "n", F.coalesce((F.col("first") >= F.col("jump")) & (F.col("first") < F.col("jump") + 200), F.lit(False)).alias("found"))


def plugin_experiment(spark, d):
    """A user-made classifier beside a built-in learner in one call, per supplier: both see every row once."""
    plugin = {"NearestMean": replace(CLASSIFIER["NearestMean"], features=("l_quantity",))}
    got = L.prequential_classify(_supplier_lines(spark, d), LINE_FEATURES, plugin | L.learners(["HT"]), WINDOW_ROWS, 2, keys="l_suppkey")
    return got.groupBy("l_suppkey", "learner").agg(F.count("*").alias("n"), F.sum("truth").alias("truths"), F.max("seq").alias("last"))


QUERIES = {f.__name__: f for f in [scorer_facts, learner_facts, drift_recovery, dspot_facts, dspot_parity, adwin_facts, plugin_experiment]}

_LINES = "(l_quantity > 25 and l_discount > 0.05)::integer"
ORACLE = {
    "scorer_facts": f"""select algorithm, count(*) as n, case when algorithm = 'Autoencoder' then 0 else least(count(*), {WINDOW}) end as unscored, 0::bigint as outside,
      case when algorithm <> 'Autoencoder' then true end as found
      from events, (values {", ".join(f"('{a}')" for a in [*FOREST, "Autoencoder"])}) a(algorithm) group by algorithm""",
    "learner_facts": """select learner, count(*) as n, 0::bigint as early, true as learned
      from lineitem, (values ('LeveragingBagging'), ('HoeffdingAdaptiveTree'), ('AdaptiveRandomForest'), ('HoeffdingTree')) l(learner) group by learner""",
    "drift_recovery": """select learner, count(*) as n, true as recovered
      from lineitem, (values ('LeveragingBagging'), ('AdaptiveRandomForest')) l(learner) group by learner""",
    "dspot_facts": f"""select strftime(ts, '%Y-%m-%d') as stream_id, count(*) as n, least(count(*), {WARMUP}) as quiet, 0::bigint as wrong from events group by 1""",
    "dspot_parity": "select strftime(ts, '%Y-%m-%d') as stream_id, count(*) as n, 0::bigint as differences from events group by 1",
    "adwin_facts": "select user_id % 3 as stream_id, count(*) as n, true as found from events group by 1",
    "plugin_experiment": f"""select l_suppkey, learner, count(*) as n, sum({_LINES})::bigint as truths, count(*) - 1 as last
      from lineitem, (values ('NearestMean'), ('HoeffdingTree')) l(learner) group by all""",
}
