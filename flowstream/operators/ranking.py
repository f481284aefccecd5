"""Feature importance by MLlib random forests.

A forest sees a feature through at most ``BINS`` bins. Where few different rows are left after binning, however many the
table has, they are counted once, every tree draws its bootstrap of each count, and MLlib grows the trees on the counts as weights.
A count n drawn from a Poisson distribution of mean n is the sum of n rows drawn with mean 1, so this is MLlib's bootstrap of the single rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.functions.columns import col

TREES, SEED = 50, 42  # fixed values
BINS = 32  # MLlib's default
SAVING = 50  # times fewer groups than rows from which they are counted first; below, MLlib's one pass for all trees is shorter
GROUPS = 200_000  # groups of a partition, at most about
FITS = 8  # trees grown at the same time


def _flat(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select(col(label).cast("double").alias("label"), *[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])


def _assembled(flat: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    names = [c for c in flat.columns if c != "label" and c not in more]
    return VectorAssembler(inputCols=names, outputCol="features").transform(flat).select("label", "features", *more)


def _binned(flat: DataFrame) -> tuple[DataFrame, int] | None:
    """Columns with many values as bins of about equal size, from the whole table, and how many different rows there may be;
    None where counting may not save enough."""
    names = [c for c in flat.columns if c != "label"]
    found = flat.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(c) for c in flat.columns]).first()
    groups = reduce(lambda n, c: n * max(1, min(found[c], BINS)), names, max(1, found["label"]))
    if groups * SAVING > found["n"]:
        return None
    many = [c for c in names if found[c] > BINS]
    cuts = flat.approxQuantile(many, [i / BINS for i in range(1, BINS)], 1 / (16 * BINS)) if many else []

    def bin_of(c: str, at: list[float]):
        # a value that fills more than a bin gets one of its own
        edges = sorted({*at, *[float(np.nextafter(v, -np.inf)) for v, w in zip(at, at[1:]) if v == w]})
        place = reduce(add, [(F.col(c) > e).cast("int") for e in edges], F.lit(0))
        return F.when(F.isnan(c), F.col(c)).otherwise(place.cast("double")).alias(c)

    bins = {c: bin_of(c, at) for c, at in zip(many, cuts)}
    return flat.select("label", *[bins.get(c, F.col(c)) for c in names]), groups


def _drawn(binned: DataFrame, trees: int, seed: int) -> DataFrame:
    """Equal rows as one: label, features and, per tree, how often its bootstrap draws them (columns w0, w1, ...)."""
    columns = binned.columns
    counted = binned.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    weights = [f"w{t}" for t in range(trees)]

    def draw(batches):
        for pdf in batches:
            # seeded by the row itself, wherever it is
            drawn = [np.random.default_rng([seed & 0xFFFFFFFF, h & 0xFFFFFFFFFFFFFFFF]).poisson(n, trees) for h, n in zip(pdf["_h"].tolist(), pdf["_n"].tolist())]
            counts = pd.DataFrame(np.array(drawn, dtype=float).reshape(-1, trees), columns=weights)
            yield pd.concat([pdf[columns].reset_index(drop=True), counts], axis=1)

    rows = counted.withColumn("_h", F.xxhash64(*columns))
    return rows.mapInPandas(draw, ", ".join(f"{c} double" for c in [*columns, *weights]))


def _vectors(df: DataFrame, features: Sequence[str], label: str, trees: int, seed: int) -> DataFrame:
    """What the forests are grown on: one row per group with the trees' weights, or the rows as they are."""
    flat = _flat(df, features, label)
    binned = _binned(flat) if trees > 1 else None
    if binned is not None:
        rows, groups = binned
        # few partitions: several trees grow at the same time
        return _assembled(_drawn(rows, trees, seed).repartition(groups // GROUPS + 1), [f"w{t}" for t in range(trees)])
    # a table read as a few large splits would train on as few cores
    cores = df.sparkSession.sparkContext.defaultParallelism
    if flat.rdd.getNumPartitions() < cores:
        flat = flat.repartition(cores)
    return _assembled(flat)


def _importances(vectors: DataFrame, features: Sequence[str], trees: int, seed: int, depth: int, fits: int = FITS) -> list[tuple[str, float]]:
    def grown(rows: DataFrame, **settings) -> np.ndarray:
        return RandomForestClassifier(maxDepth=depth, maxMemoryInMB=512, **settings).fit(rows).featureImportances.toArray()

    def tree(t: int) -> np.ndarray:
        w = f"w{t}"
        return grown(vectors.filter(F.col(w) > 0).select("label", "features", w), numTrees=1, seed=seed + t, bootstrap=False, featureSubsetStrategy="sqrt", weightCol=w)

    if "w0" in vectors.columns:
        with ThreadPoolExecutor(fits) as pool:
            values = sum(pool.map(tree, range(trees)))  # each tree's add up to 1, as within MLlib's forest
        values = values / (values.sum() or 1.0)
    else:
        values = grown(vectors, numTrees=trees, seed=seed)
    return sorted(zip(features, map(float, values)), key=lambda t: -t[1])


def rf_importances(df: DataFrame, features: Sequence[str], label: str, trees: int = TREES, seed: int = SEED, depth: int = 8) -> list[tuple[str, float]]:
    """(feature, importance), most important first, schema order on ties."""
    vectors = _vectors(df, features, label, trees, seed).persist()
    try:
        vectors.count()  # kept before several trees read it at the same time
        return _importances(vectors, features, trees, seed, depth)
    finally:
        vectors.unpersist()


def rf_top_features(df: DataFrame, features: Sequence[str], label: str, n: int, **settings) -> list[str]:
    """The n most important features; all of them if there are no more than n."""
    if len(features) <= n:
        return list(features)
    return [f for f, _ in rf_importances(df, features, label, **settings)[:n]]


def ovr_feature_importance(df: DataFrame, features: Sequence[str], label: str, names: Sequence[str], top_per_class: int = 10, trees: int = TREES,
                           seed: int = SEED, depth: int = 8, parallelism: int = 4) -> DataFrame:
    """(class, rank, feature, importance): one forest per class against the rest.

    The vectors are assembled and persisted once; a few forests train at the same time, as MLlib's own
    one-vs-rest does.
    """
    vectors = _vectors(df, features, label, trees, seed).persist()
    classes = [int(r[0]) for r in vectors.select("label").distinct().orderBy("label").collect()]

    def fit(c: int) -> list[tuple]:
        binary = vectors.withColumn("label", (F.col("label") == c).cast("double"))
        name = names[c] if 0 <= c < len(names) else f"Ataque {c}"
        return [(name, rank, f, v) for rank, (f, v) in enumerate(_importances(binary, features, trees, seed, depth, max(1, FITS // parallelism))[:top_per_class])]

    with ThreadPoolExecutor(parallelism) as pool:
        rows = [r for part in pool.map(fit, classes) for r in part]
    vectors.unpersist()
    return df.sparkSession.createDataFrame(rows, "class string, rank int, feature string, importance double")


def consolidated_features(ranked: DataFrame) -> DataFrame:
    """The set of features any class ranks among its best."""
    return ranked.select("feature").distinct().orderBy("feature")


def selected_features(ranked: DataFrame) -> DataFrame:
    """(feature, pos) in the shape ``feature_votes`` counts."""
    return ranked.select("feature", F.monotonically_increasing_id().alias("pos"))
