"""Metrics over prediction tables (truth, pred, seq, stream keys): every one starts from small counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstream.operators.ordering import _keys, running_sums, with_seq
from flowstream.session import join_checked


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1_columns(tp: Column, fp: Column, fn: Column, percent: float = 100.0) -> list[Column]:
    """f1, precision, recall in percent; 0 where undefined."""
    return [
        (_ratio(2 * tp, 2 * tp + fp + fn) * percent).alias("f1"),
        (_ratio(tp, tp + fp) * percent).alias("precision"),
        (_ratio(tp, tp + fn) * percent).alias("recall"),
    ]


def _is(value: Column, target) -> Column:
    """Whether a truth or prediction is the class; a missing one is not, so it counts as a miss."""
    return F.coalesce(value == target, F.lit(False))


def exclude_warmup(df: DataFrame, n: int, by=None, seq: str = "seq") -> DataFrame:
    """Drop the first n rows of each stream; a stream not longer than n keeps all its rows."""
    by = _keys(by)
    if n <= 0:
        return df
    if not by:
        longest = df.agg(F.max(seq)).first()[0]
        return df.filter(F.col(seq) >= n) if longest is not None and longest >= n else df
    short = df.groupBy(*by).agg(F.max(seq).alias("_last")).filter(F.col("_last") < n)
    short = short.select(*[F.col(b).alias(f"_s_{b}") for b in by])
    cond = [F.col(b).eqNullSafe(F.col(f"_s_{b}")) for b in by]
    marked = join_checked(df, short.withColumn("_short", F.lit(True)), cond, "left")
    return marked.filter((F.col(seq) >= n) | F.col("_short")).drop("_short", *[f"_s_{b}" for b in by])


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", by=None) -> DataFrame:
    return df.groupBy(*_keys(by), F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_totals(counts: DataFrame, by=None) -> DataFrame:
    """tp, fp, fn per class that occurs in truth or prediction; ``counts`` is a confusion table."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.col("truth") == F.col("pred")
    as_truth = F.struct(F.col("truth").alias("cls"), F.when(hit, n).otherwise(zero).alias("tp"), zero.alias("fp"),
                        F.when(hit, zero).otherwise(n).alias("fn"))
    as_pred = F.struct(F.col("pred").alias("cls"), zero.alias("tp"), F.when(hit, zero).otherwise(n).alias("fp"), zero.alias("fn"))
    long = counts.select(*_keys(by), F.explode(F.array(as_truth, as_pred)).alias("x")).select(*_keys(by), "x.*")
    return long.filter("cls is not null").groupBy(*_keys(by), "cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def metrics_from_confusion(counts: DataFrame, target: int | None = 1, by=None) -> DataFrame:
    """f1, precision, recall (percent): of the target class, or averaged over the classes present if None."""
    by = _keys(by)
    if target is None:
        per = class_totals(counts, by).select(*by, *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))
        aggs = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("f1", "precision", "recall")]
        return per.groupBy(*by).agg(*aggs)
    is_truth, is_pred = _is(F.col("truth"), target), _is(F.col("pred"), target)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    totals = counts.groupBy(*by).agg(part(is_truth & is_pred).alias("tp"), part(~is_truth & is_pred).alias("fp"),
                                     part(is_truth & ~is_pred).alias("fn"))
    return totals.select(*by, *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def binary_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred", target: int | None = 1, by=None) -> DataFrame:
    return metrics_from_confusion(confusion(df, truth, pred, by), target, by)


def cumulative_report(df: DataFrame, warmup: int = 0, target: int | None = 1, by=("algorithm",), seq: str = "seq") -> DataFrame:
    """One line per algorithm (and stream): f1, precision, recall after the warm-up."""
    return binary_metrics(exclude_warmup(df, warmup, by, seq), target=target, by=by)


def prequential_history(df: DataFrame, window: int, warmup: int = 0, target: int | None = 1, by=None, seq: str = "seq",
                        truth: str = "truth", pred: str = "pred", block_rows: int = 4096) -> DataFrame:
    """Cumulative metrics sampled every ``window`` rows, after the row at the sample point.

    Rows are counted per sample interval first; only those few counts are summed along the stream.
    Without a target the values of classes 0 and 1 are averaged.
    """
    by = _keys(by)
    classes = [0, 1] if target is None else [target]
    rows = df.filter(F.col(seq) >= warmup)
    point = F.expr(f"(`{seq}` + {window - 1}) div {window}").alias("_point")
    aggs = []
    for c in classes:
        t, p = _is(F.col(truth), c), _is(F.col(pred), c)
        aggs += [F.count_if(t & p).alias(f"tp{c}"), F.count_if(~t & p).alias(f"fp{c}"), F.count_if(t & ~p).alias(f"fn{c}")]
    bins = rows.groupBy(*by, point).agg(*aggs, F.max((F.col(seq) % window == 0).cast("int")).alias("_full"))
    names = [f"{k}{c}" for c in classes for k in ("tp", "fp", "fn")]
    run = running_sums(bins, {f"r_{x}": F.col(x) for x in names}, by, "_point", block_rows)
    run = run.filter((F.col("_full") == 1) & (F.col("_point") > 0))
    parts = [f1_columns(F.col(f"r_tp{c}"), F.col(f"r_fp{c}"), F.col(f"r_fn{c}")) for c in classes]
    values = [sum(p[i] for p in parts) / len(parts) for i in range(3)]
    return run.select(*by, (F.col("_point") * window).alias("at_seq"),
                      *[v.alias(n) for v, n in zip(values, ("f1", "precision", "recall"))])


def windowed_metrics(df: DataFrame, window: int, by=None, seq: str = "seq", truth: str = "truth", pred: str = "pred",
                     target: int = 1) -> DataFrame:
    """Accuracy, precision, recall, f1 (percent) per tumbling window of ``window`` rows."""
    by = _keys(by)
    t, p = _is(F.col(truth), target), _is(F.col(pred), target)
    w = F.expr(f"`{seq}` div {window}").alias("window_id")
    got = df.groupBy(*by, w).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("ok"),
                                 F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return got.select(*by, "window_id", "n", (F.col("ok") / F.col("n") * 100.0).alias("accuracy"),
                      *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def cumulative_accuracy(df: DataFrame, by=("learner",), truth: str = "truth", pred: str = "pred") -> DataFrame:
    ok = F.count_if(F.col(truth) == F.col(pred))
    return df.groupBy(*_keys(by)).agg((ok / F.count(F.lit(1)) * 100.0).alias("accuracy"))


def auc(df: DataFrame, by=None, score: str = "score", truth: str = "truth", block_rows: int = 65_536) -> DataFrame:
    """ROC area per group, ties count half; null where a group holds one class only.

    Rows shrink to one per distinct score, these are put in order by one range sort, and the
    negatives below each score are a blocked running sum.
    """
    by = _keys(by)
    pos, neg = F.count_if(F.col(truth) == 1), F.count_if(F.col(truth) != 1)
    dist = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(pos.alias("_p"), neg.alias("_q"))
    ranked = with_seq(dist, [score], by=by, name="_rank")
    run = running_sums(ranked, {"_below": F.col("_q")}, by, "_rank", block_rows)
    pairs = F.sum(F.col("_p") * (F.col("_below") - F.col("_q")) + F.col("_p") * F.col("_q") * 0.5)
    area = F.try_divide(pairs, (F.sum("_p") * F.sum("_q")).cast("double"))
    return run.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"), area.alias("auc"))


def windowed_auc(df: DataFrame, window: int, by=None, seq: str = "seq", score: str = "score", truth: str = "truth") -> DataFrame:
    """ROC area per count window; a window is bounded, so a plain window function does. Rows without a score count in
    neither class, so a window of such rows has no area."""
    by = _keys(by)
    rows = df.withColumn("window_id", F.expr(f"`{seq}` div {window}"))
    scored = F.col(score).isNotNull()
    pos, neg = F.count_if((F.col(truth) == 1) & scored), F.count_if((F.col(truth) != 1) & scored)
    dist = rows.groupBy(*by, "window_id", score).agg(pos.alias("_p"), neg.alias("_q"))
    w = Window.partitionBy(*by, "window_id").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    dist = dist.withColumn("_below", F.coalesce(F.sum("_q").over(w), F.lit(0)))
    pairs = F.sum(F.col("_p") * F.col("_below") + F.col("_p") * F.col("_q") * 0.5)
    return dist.groupBy(*by, "window_id").agg(F.try_divide(pairs, (F.sum("_p") * F.sum("_q")).cast("double")).alias("auc"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], target: int | None = 1, by=None, score: str = "score",
                    truth: str = "truth") -> DataFrame:
    """f1, precision, recall at every threshold, best f1 first (lowest threshold on ties).

    A score is placed once among the sorted thresholds and counted; rows are not copied per threshold.
    """
    by = _keys(by)
    ts = sorted(thresholds)
    passed = sum((F.coalesce(F.col(score) > float(t), F.lit(False)).cast("int") for t in ts), F.lit(0))
    hist = df.groupBy(*by, passed.alias("_passed"), F.col(truth).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.posexplode(F.array(*[F.lit(float(t)) for t in ts]))
    cells = hist.select("*", grid.alias("_i", "threshold"))
    cells = cells.withColumn("pred", (F.col("_passed") > F.col("_i")).cast("int"))
    counts = cells.groupBy(*by, "threshold", "truth", "pred").agg(F.sum("n").alias("n"))
    out = metrics_from_confusion(counts, target, [*by, "threshold"])
    return out.orderBy(*by, F.desc("f1"), "threshold")


def feature_votes(selection: DataFrame, k: int = 25, feature: str = "feature", pos: str = "pos") -> DataFrame:
    """How often each feature was picked; ties go to the one seen first."""
    votes = selection.groupBy(feature).agg(F.count(F.lit(1)).alias("votes"), F.min(pos).alias("first_seen"))
    return votes.orderBy(F.desc("votes"), "first_seen").limit(k)


def best_trial(trials: DataFrame, by=("algorithm", "stream_id")) -> DataFrame:
    """The trial of highest f1 per group; the first one on ties."""
    by = _keys(by)
    row = F.struct(*[F.col(c) for c in trials.columns if c not in by])
    pick = F.max_by(row, F.struct(F.col("f1"), (-F.col("trial")).alias("t")))
    return trials.groupBy(*by).agg(pick.alias("_r")).select(*by, "_r.*")
