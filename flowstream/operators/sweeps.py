"""Parameter sweeps: every trial is a key or a branch of one job; results are a trial table."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowstream.operators.evaluation import best_trial, metrics_from_confusion
from flowstream.operators.keyed import _ddl
from flowstream.operators.scoring import _plain, _rng, freeze_after_warmup, scorers
from flowstream.session import spread_by, written

# Search spaces as (low, high, step) or choices, and the threshold range.
SPACES = {
    "HST": {"window": (100, 2050, 50), "depth": (5, 20, 1), "anomaly_threshold": (0.1, 0.9, 0.05), "size_limit": (0.05, 0.5, 0.05)},
    "OIF": {"trees": (10, 100, 10), "max_leaf": (16, 128, 16), "growth": ["fixed", "adaptive"], "subsample": (0.1, 1.0, 0.1),
            "window": (512, 4096, 256), "branching": (2, 5, 1)},
    "AE": {"hidden": (1, 24, 1), "learning_rate": [1e-4, 2.5e-4, 6.3e-4, 1.6e-3, 4e-3, 1e-2], "threshold": (0.1, 0.9, 0.05)},
    "RRCF": {"tree_size": (100, 2000, 100), "trees": (10, 200, 10)},
    "AIF": {"window": (128, 1024, 128), "height": (5, 20, 1)},
    "LB": {"members": (10, 150, 10)},
    "HT": {"grace": (10, 500, 10), "criterion": ["infogain", "gini", "hellinger"], "confidence": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1],
           "tie": (0.01, 0.2, 0.01), "leaf": ["majority", "nb", "nba"], "nb_threshold": (0, 50, 1)},
    "HAT": {"grace": (10, 500, 10), "criterion": ["infogain", "gini"], "confidence": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1],
            "tie": (0.01, 0.2, 0.01), "leaf": ["majority", "nb", "nba"], "nb_threshold": (0, 50, 1)},
    "ARF": {"members": (10, 150, 10), "max_features": (0.1, 1.0, 0.1), "lam": (1.0, 10.0, 1.0), "weighted_vote": [True, False],
            "drift_detection": [True, False], "background": [True, False]},
    "DSPOT-HST": {"q": [1e-6, 3e-6, 1e-5, 3e-5, 1e-4], "depth": (150, 400, 50), "t_quantile": (0.94, 0.99, 0.01)},
    "DSPOT": {"q": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1], "depth": (50, 400, 50), "t_quantile": (0.93, 0.98, 0.01)},
}
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def axis_values(spec) -> list:
    if isinstance(spec, list):
        return spec
    low, high, step = spec
    n = int(round((high - low) / step)) + 1
    return [low + i * step if isinstance(low, int) else round(low + i * step, 10) for i in range(n)]


def parameter_grid(space: dict, trials: int | None = None, seed: int = 42) -> list[dict]:
    """The full grid, or ``trials`` seeded random points of it (a control list, a few hundred entries at most)."""
    axes = {k: axis_values(v) for k, v in space.items()}
    if trials is None:
        return [dict(zip(axes, point)) for point in itertools.product(*axes.values())]
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in axes.items()} for _ in range(trials)]


def experiment_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Data set x size x algorithm ...: all combinations in a fixed order, numbered from 0."""
    points = list(itertools.product(*axes.values()))
    return spark.createDataFrame([(i, *[str(v) for v in p]) for i, p in enumerate(points)], ["idx", *axes])


def _levels(scorer, algorithm: str, mode, thresholds: Sequence[float]) -> list[float]:
    own = {"HST": "anomaly_threshold", "AE": "threshold"}.get(algorithm)
    if mode == "shared" and own:
        return [float(getattr(scorer, own))]
    return sorted(float(t) for t in ([mode] if isinstance(mode, (int, float)) else thresholds))


def _count_trials(df: DataFrame, features: Sequence[str], trials: Sequence[tuple], keys: Sequence[str], seq: str, truth: str) -> DataFrame:
    """(keys, trial, early, passed, truth, n, seconds): how many rows of each truth pass how many of a trial's levels.

    ``trials`` holds (scorer, warm-up, levels). Rows go once to their stretch of the stream, with the rows around it that windows
    reach for, and all trials run there; a window belongs to the stretch it begins in. Only counts leave the task.
    """
    keys = list(keys)
    behind, ahead = max(s.back * s.window for s, _, _ in trials), max(s.window for s, _, _ in trials)
    size = 2 * (behind + ahead)
    at, home = F.expr(f"`{seq}` % {size}"), F.expr(f"`{seq}` div {size}")
    homes = F.array(home, F.when(at >= size - behind, home + 1), F.when((at < ahead) & (home > 0), home - 1))
    rows = df.select(*keys, F.col(seq).cast("long").alias("_seq"), F.col(truth).alias("_truth"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)],
                     F.explode(F.array_compact(homes)).alias("_home"))
    kind = dict(rows.dtypes)["_truth"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        seqs, x = pdf["_seq"].to_numpy(), pdf[[f"_x{i}" for i in range(len(features))]].to_numpy(dtype=float)
        parts = []
        for i, (scorer, skip, levels) in enumerate(trials):
            begun = time.process_time()
            windows = seqs // scorer.window
            span = lambda w: slice(*np.searchsorted(windows, [w, w + 1]))
            rng = lambda w: _rng(scorer.seed, *_plain((*key[:-1], w)))
            models, found = {}, []
            for w in np.unique(windows[(windows * scorer.window) // size == key[-1]]).tolist():
                known = [(age, span(w - age)) for age in range(1, scorer.back + 1) if w >= age]
                known = [(age, s) for age, s in known if s.stop > s.start]
                query = span(w)
                if not known:
                    score = np.full(query.stop - query.start, np.nan)
                elif hasattr(scorer, "build"):
                    for age, s in known:
                        if w - age not in models:
                            models[w - age] = scorer.build(x[s], w == age, rng(w - age))
                    score = scorer.rate([(age, models[w - age]) for age, _ in known], x[query])
                else:
                    ages = np.concatenate([np.full(s.stop - s.start, age) for age, s in known])
                    score = scorer.score(np.concatenate([x[s] for _, s in known]), ages, x[query], rng(w))
                passed = np.where(np.isnan(score), 0, np.searchsorted(levels, score, side="left"))
                found.append(pd.DataFrame({"early": seqs[query] < skip, "passed": passed, "truth": pdf["_truth"].iloc[query]}))
            if found:
                n = pd.concat(found).groupby(["early", "passed", "truth"], dropna=False).size().reset_index(name="n")
                seconds = np.zeros(len(n))
                seconds[0] = time.process_time() - begun
                parts.append(n.assign(trial=i, seconds=seconds, **dict(zip(keys, key))))
        names = [*keys, "trial", "early", "passed", "truth", "n", "seconds"]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    schema = ", ".join(filter(None, [_ddl(df, keys), f"trial int, early boolean, passed int, truth {kind}, n long, seconds double"]))
    return spread_by(rows, [*keys, "_home"]).groupBy(*keys, "_home").applyInPandas(run, schema)


def _best_levels(counts: DataFrame, trials: Sequence[tuple], target: int | None, keys: Sequence[str]) -> DataFrame:
    """Each trial's best level with its metrics (the lowest level on ties), and the seconds it took."""
    keys = list(keys)
    counts = written(counts.groupBy(*keys, "trial", "early", "passed", "truth").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")), "counts")
    # a stream that ends before its warm-up does keeps all its rows
    per_trial = Window.partitionBy(*keys, "trial")
    rows = counts.withColumn("_late", F.max(~F.col("early")).over(per_trial)).withColumn("seconds", F.sum("seconds").over(per_trial))
    rows = rows.filter(~F.col("early") | ~F.col("_late"))
    levels = [(i, j, t) for i, (_, _, ts) in enumerate(trials) for j, t in enumerate(ts)]
    levels = counts.sparkSession.createDataFrame(levels, "_trial int, _level int, threshold double")
    cells = rows.join(F.broadcast(levels), F.col("trial") == F.col("_trial")).withColumn("pred", (F.col("passed") > F.col("_level")).cast("int"))
    cells = cells.groupBy(*keys, "trial", "threshold", "truth", "pred").agg(F.sum("n").alias("n"), F.max("seconds").alias("seconds"))
    took = cells.groupBy(*keys, "trial").agg(F.max("seconds").alias("seconds"))
    metrics = metrics_from_confusion(cells.drop("seconds"), target, [*keys, "trial", "threshold"])
    rank = F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))
    best = metrics.groupBy(*keys, "trial").agg(F.max_by(F.struct("f1", "precision", "recall", "threshold"), rank).alias("_b"))
    took = took.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("trial").alias("_t"), "seconds")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return best.join(took, [*same, F.col("trial") == F.col("_t")]).select(*keys, "trial", "_b.*", "seconds")


def scorer_sweep(df: DataFrame, features: Sequence[str], algorithm: str, grid: Sequence[dict], thresholds: Sequence[float] = tuple(THRESHOLDS),
                 warmup: int = 0, target: int | None = 1, keys: Sequence[str] = (), seq: str = "seq", truth: str = "truth",
                 threshold_mode: str | float = "independent") -> DataFrame:
    """Trial table of one scorer: parameters, best threshold with its metrics, seconds of computing.

    All trials of window scorers run over one shuffle of the rows, which are neither copied per trial nor scored into a table. ``threshold_mode``:
    'independent' tries all thresholds, 'shared' uses the scorer's own one, a number fixes it. For half-space trees the warm-up is the trial's window.
    """
    configured = [next(iter(scorers([algorithm], {algorithm: params}).values())) for params in grid]
    trials = [(s, s.window if algorithm == "HST" else warmup, _levels(s, algorithm, threshold_mode, thresholds)) for s in configured]
    if configured[0].window:
        counts = _count_trials(df, features, trials, keys, seq, truth)
    else:
        parts = []
        for i, (scorer, skip, levels) in enumerate(trials):
            started = time.time()
            got = written(freeze_after_warmup(df, features, scorer, warmup, keys, seq, [truth]), "trial")
            seconds = time.time() - started
            passed = sum((F.coalesce(F.col("score") > t, F.lit(False)).cast("int") for t in levels), F.lit(0))
            parts.append(got.groupBy(*keys, F.lit(i).alias("trial"), (F.col(seq) < skip).alias("early"), passed.alias("passed"), F.col(truth).alias("truth"))
                         .agg(F.count(F.lit(1)).alias("n")).withColumn("seconds", F.lit(seconds)))
        counts = reduce(DataFrame.unionByName, parts)
    best = _best_levels(counts, trials, target, keys)
    names = F.create_map(*[x for i, p in enumerate(grid) for x in (F.lit(i), F.lit(", ".join(f"{k}={v}" for k, v in p.items())))])
    return best.select(*keys, F.lit(algorithm).alias("algorithm"), "trial", names[F.col("trial")].alias("params"), "f1", "precision", "recall", "threshold", "seconds")


def best_params(trials: DataFrame, by: Sequence[str] = ("algorithm",)) -> DataFrame:
    return best_trial(trials, by)
