"""Queries on step plug-ins, in batch and on the replayed events table (one stream per user)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.common import SQL_SEQ_USER, TRUTH_LEVEL, stream
from catalog.stateful import ORACLE as _STATEFUL
from catalog.stateful import _user_errors
from flowstream.operators import drift as D
from flowstream.operators.learners import prequential_classify
from flowstream.operators.scoring import prequential_score
from flowstream.operators.steps import RowClassifier, RowScorer
from flowstream.streaming import live as V
from flowstream.streaming import steps as S

FEATURES = ("cents",)  # whole numbers, so that sums are exact in any order


class RunningMean:
    """Distance of a row to the mean of the rows before it."""

    def __init__(self):
        self.n, self.total = 0, 0.0

    def score_instance(self, x):
        return float(abs(x[0] - self.total / self.n)) if self.n else None

    def train(self, x):
        self.n, self.total = self.n + 1, self.total + float(x[0])


class NearestMean:
    """The class whose mean of the rows before is nearer, once both classes have been seen."""

    def __init__(self):
        self.n, self.total = np.zeros(2), np.zeros(2)

    def predict(self, x):
        if not self.n.all():
            return None
        far = np.abs(x[0] - self.total / self.n)
        return int(far[1] < far[0])

    def train(self, x, y):
        self.n[y] += 1
        self.total[y] += x[0]


SCORER = {"RunningMean": RowScorer(lambda key: RunningMean(), FEATURES)}
CLASSIFIER = {"NearestMean": RowClassifier(lambda key: NearestMean(), FEATURES)}


def _rows(spark, d):
    s = stream(spark, d, "value", "user_id", by="user_id")
    return s.select("user_id", "seq", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), (F.col("value") > TRUTH_LEVEL).cast("int").alias("class_idx"))


def _replayed(spark, df, files=1):
    return V.as_stream(spark, V.replay_files(df, "ts", 3, close_after="2 hours", files_per_chunk=files), max_files=files)


def step_scorer(spark, d):
    """A user-made scorer through the same call as the built-in ones."""
    out = prequential_score(_rows(spark, d), FEATURES, SCORER, keys="user_id")
    return out.select("user_id", "algorithm", "seq", "score")


def step_classifier(spark, d):
    """A user-made classifier through the same call as the built-in ones."""
    return prequential_classify(_rows(spark, d), FEATURES, CLASSIFIER, 100, 2, keys="user_id").select("user_id", "learner", "seq", "truth", "pred")


def step_scorer_stream(spark, d):
    out = S.steps_stream(_replayed(spark, _rows(spark, d)), SCORER, "user_id", delay="1 hour", reads=FEATURES)
    return V.run_to_table(out, "scores").select("user_id", "algorithm", "seq", "score")


def step_classifier_stream(spark, d):
    out = S.steps_stream(_replayed(spark, _rows(spark, d)), CLASSIFIER, "user_id", delay="1 hour", keep=["class_idx"], reads=FEATURES, label="learner")
    return V.run_to_table(out, "predictions").withColumnRenamed("class_idx", "truth").select("user_id", "learner", "seq", "truth", "pred")


def _timed_errors(spark, d):
    times = stream(spark, d, "user_id", by="user_id").select(F.col("user_id").alias("_user"), F.col("seq").alias("_seq"), "ts")
    e = _user_errors(spark, d)
    return e.join(times, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("seq") == F.col("_seq"))).drop("_user", "_seq")


def ddm_stream(spark, d):
    """DDM states on live errors; equals the batch form."""
    return V.run_to_table(S.ddm_stream(_replayed(spark, _timed_errors(spark, d)), "user_id", delay="1 hour"), "ddm")


def adwin_stream(spark, d):
    """ADWIN states on live errors."""
    return V.run_to_table(S.adwin_stream(_replayed(spark, _timed_errors(spark, d)), "user_id", delay="1 hour"), "adwin")


def drift_stream_parity(spark, d):
    """Live and batch detections of both detectors held against each other: how many only one of them has, per user."""
    e = _timed_errors(spark, d).select("user_id", "seq", "ts", F.lit(0.0).alias("truth"), F.col("error").alias("pred"))
    live = V.run_to_table(S.drift_monitor_stream(_replayed(spark, e, 2), "user_id", delay="1 hour"), "monitor")
    sides = D.drift_monitor(e, "user_id").withColumn("side", F.lit(1)).unionByName(live.withColumn("side", F.lit(2)))
    each = sides.groupBy("user_id", "detector", "seq").agg(F.sum("side").alias("sides"))
    odd = each.groupBy("user_id").agg(F.count_if(F.col("sides") != 3).alias("differences"), F.count("*").alias("found"))
    users = e.select("user_id").distinct()
    known = odd.select(F.col("user_id").alias("_user"), "differences", "found")
    return users.join(known, F.col("user_id").eqNullSafe(F.col("_user")), "left").select(
        "user_id", F.coalesce("differences", F.lit(0)).alias("differences"))


QUERIES = {f.__name__: f for f in [step_scorer, step_classifier, step_scorer_stream, step_classifier_stream, ddm_stream, adwin_stream, drift_stream_parity]}

_BEFORE = "over (partition by user_id order by seq rows between unbounded preceding and 1 preceding)"
_ROWS = f"select user_id, {SQL_SEQ_USER} as seq, round(value * 100)::bigint as x, (value > 150)::integer as truth from events"
_MEAN = lambda where: f"(sum(x) filter ({where}) {_BEFORE})::double / nullif(count(*) filter ({where}) {_BEFORE}, 0)"
_SCORES = f"""with s as ({_ROWS})
  select user_id, 'RunningMean' as algorithm, seq, abs(x - {_MEAN("true")}) as score from s"""
_CLASSES = f"""with s as ({_ROWS}),
  m as (select *, {_MEAN("truth = 0")} as m0, {_MEAN("truth = 1")} as m1 from s)
  select user_id, 'NearestMean' as learner, seq, truth, coalesce(abs(x - m1) < abs(x - m0), false)::integer as pred from m"""

ORACLE = {
    "step_scorer": _SCORES,
    "step_scorer_stream": _SCORES,
    "step_classifier": _CLASSES,
    "step_classifier_stream": _CLASSES,
    "ddm_stream": _STATEFUL["ddm"],
    "drift_stream_parity": "select distinct user_id, 0::bigint as differences from events",
}
