"""Whole experiments: score, decide, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.functions.columns import collapse_prediction, discretize, encode_index
from flowstream.operators import evaluation as E
from flowstream.operators import profile as P
from flowstream.operators import thresholds as T
from flowstream.operators.drift import drift_monitor
from flowstream.operators.learners import prequential_classify
from flowstream.operators.ordering import _keys, attack_regions, moving_average
from flowstream.operators.ranking import consolidated_features, ovr_feature_importance
from flowstream.operators.scoring import Scorer, prequential_score, window_scores
from flowstream.plans.preparation import prepare
from flowstream.session import written


@dataclass
class AnomalyRun:
    scores: DataFrame   # keys, algorithm, seq, score, threshold, trend, truth, pred
    report: DataFrame   # keys, algorithm, f1, precision, recall after the warm-up
    history: DataFrame  # keys, algorithm, at_seq, f1, precision, recall
    regions: DataFrame  # keys, start_seq, end_seq, n, class_idx

    def smoothed(self, w: int = 5, keys=None) -> DataFrame:
        """Scores with their moving average, per algorithm."""
        return moving_average(self.scores, "score", w, by=[*_keys(keys), "algorithm"])


def anomaly_experiment(df: DataFrame, features: Sequence[str], algorithms: dict[str, Scorer], window: int, warmup: int = 0, mode: str = "fixed",
                       threshold: float = 0.5, target: int | None = None, keys=None, normal_idx: int = 0, dspot: dict | None = None) -> AnomalyRun:
    """Test-then-train run over prepared streams (seq, class_idx, features).

    ``mode``: 'fixed' threshold, 'dspot' (each algorithm its own state), or 'frozen' (learn in the warm-up only,
    fixed threshold). Scores are written once; report, history and regions read them.
    """
    keys = _keys(keys)
    rows = df.withColumn("truth", encode_index(F.col("class_idx"), normal_idx))
    scored = prequential_score(rows, features, algorithms, warmup, keys, keep=["truth"], frozen=mode == "frozen")
    by = [*keys, "algorithm"]
    if mode == "dspot":
        out = T.dspot(written(scored, "scores"), by, warmup=max(warmup, 1), keep=["truth"], **(dspot or {}))
    else:
        out = scored.withColumn("pred", discretize(F.col("score"), threshold))
        out = out.withColumn("threshold", F.lit(float(threshold))).withColumn("trend", F.lit(0.0))
    out = written(out, "alerts")
    return AnomalyRun(
        scores=out,
        report=E.cumulative_report(out, warmup, target, by),
        history=E.prequential_history(out, window, warmup, target, by),
        regions=attack_regions(df, "class_idx", normal_idx, keys),
    )


@dataclass
class ContaminationStudy:
    series: DataFrame   # one row per level and position: score, both decisions, threshold, trend
    regions: DataFrame


def contamination_study(df: DataFrame, features: Sequence[str], scorer: Scorer, threshold: float = 0.6, warmup: int = 1000, dspot: dict | None = None,
                        keys: Sequence[str] = ("stream_id",), normal_idx: int = 0) -> ContaminationStudy:
    """All contamination levels (stream keys) in one job, fixed threshold and DSPOT side by side."""
    keys = _keys(keys)
    rows = df.withColumn("truth", encode_index(F.col("class_idx"), normal_idx))
    s = written(window_scores(rows, features, scorer, keys, keep=["truth"]), "scores")
    both = T.contamination_evolution(s, threshold, keys, warmup=warmup, **(dspot or {}))
    return ContaminationStudy(moving_average(both, "score", 5, by=keys), attack_regions(df, "class_idx", normal_idx, keys))


@dataclass
class ClassificationRun:
    predictions: DataFrame  # learner, seq, truth, pred (multiclass)
    report: DataFrame       # learner, f1, precision, recall on attack / no attack
    history: DataFrame
    accuracy: DataFrame
    regions: DataFrame


def classification_experiment(df: DataFrame, features: Sequence[str], configured, window: int, window_rows: int, classes: int, warmup: int = 0,
                              target: int | None = 1, keys=None) -> ClassificationRun:
    """All learners over prepared streams (keys, seq, class_idx, features), without keys over one; predictions are written once."""
    keys = _keys(keys)
    by = [*keys, "learner"]
    preds = written(prequential_classify(df, features, configured, window_rows, classes, keys=keys), "predictions")
    flat = preds.select(*by, "seq", encode_index(F.col("truth")).alias("truth"), collapse_prediction(F.col("pred")).alias("pred"))
    return ClassificationRun(
        predictions=preds,
        report=E.cumulative_report(flat, warmup, target, by),
        history=E.prequential_history(preds, window, warmup, target, by),
        accuracy=E.cumulative_accuracy(preds, by),
        regions=attack_regions(df, "class_idx", 0, keys),
    )


@dataclass
class DriftStudy:
    detections: DataFrame   # stream_id, detector, seq
    windows: DataFrame      # accuracy and friends per window


def drift_study(df: DataFrame, features: Sequence[str], learner, window: int, window_rows: int, classes: int, keys=None) -> DriftStudy:
    """An adaptive tree test-then-train, both drift detectors on its errors, metrics per window; each stream for itself if keys are given."""
    keys = _keys(keys)
    preds = written(prequential_classify(df, features, {"learner": learner}, window_rows, classes, keys=keys), "predictions")
    if not keys:
        preds = preds.withColumn("stream_id", F.lit("stream"))
    return DriftStudy(drift_monitor(preds, keys or ["stream_id"]), E.windowed_metrics(preds, window, keys))


def feature_consensus(tables: Sequence[DataFrame], k: int = 25, **prepare_settings) -> DataFrame:
    """Prepare every data set, keep its k best features, count the votes."""
    picks = []
    for i, t in enumerate(tables):
        picks += [(f, i * 10_000 + j) for j, f in enumerate(prepare(t, top_n=k, **prepare_settings).features)]
    spark = tables[0].sparkSession
    return E.feature_votes(spark.createDataFrame(picks, "feature string, pos long"), k)


@dataclass
class ClassProfile:
    signatures: DataFrame
    importances: DataFrame
    features: DataFrame
    class_distances: DataFrame
    feature_distances: DataFrame


def class_profile(df: DataFrame, features: Sequence[str], label: str, names: Sequence[str], top_per_class: int = 10, **forest) -> ClassProfile:
    """Class means, one-vs-rest importances with their union, and distances over the features kept."""
    ranked = ovr_feature_importance(df, features, label, names, top_per_class, **forest)
    kept = [r["feature"] for r in consolidated_features(ranked).collect()]
    return ClassProfile(P.class_signature(df, features, label), ranked, consolidated_features(ranked), P.class_distance(df, kept, label),
                        P.feature_distance(df, kept, label))
