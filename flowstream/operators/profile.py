"""Column statistics: imputation, scaling, feature selection, class signatures and distances.

Every ``fit`` step is one aggregation over all columns whose single result row (a few numbers
per column) goes to the driver; every ``apply`` step is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstream.functions.columns import NORMAL_NAMES, NORMAL_NAMES_OR_ZERO, clean_label, col, without_nan
from flowstream.session import join_checked, written

EXACT_VALUES = 4_000_000   # rows x columns up to which Spark's exact percentile is used, beyond it bracketing
GATHER_VALUES = 65_536     # bins counted at once
MAX_BINS = 4096            # bins of one bracket


def _extent(df: DataFrame, value: dict[str, Column]) -> dict[str, tuple[int, int, int, float | None, float | None]]:
    """Per column its non-null values, those of -infinity, the finite ones, and the least and largest finite value, in one pass."""
    stats = []
    for i, v in enumerate(value.values()):
        finite = F.when(F.abs(v) < math.inf, v)
        stats += [F.count(v).alias(f"n{i}"), F.count_if(v == -math.inf).alias(f"b{i}"), F.count(finite).alias(f"m{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
    row = df.agg(*stats).first()
    return {c: tuple(row[f"{name}{i}"] for name in ("n", "b", "m", "lo", "hi")) for i, c in enumerate(value)}


def _order_statistics(df: DataFrame, value: dict[str, Column], extent: dict[str, tuple], wanted: set[tuple[str, int]], gather_values: int) -> dict[tuple[str, int], float]:
    """The values of the wanted (column, rank) pairs, ranks counted from 0 over the non-null values."""
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}  # least value, largest value, rows below
    for c, k in wanted:
        _, below, finite, lo, hi = extent[c]
        if not below <= k < below + finite:
            found[(c, k)] = -math.inf if k < below else math.inf
        else:
            open_[(c, k)] = (lo, hi, below)
    while True:
        found |= {key: lo for key, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {key: s for key, s in open_.items() if s[0] < s[1]}
        if not open_:
            return found
        # brackets of one column are the same or lie apart, so a value counts in one of them at most
        brackets = sorted({(key[0], lo, hi) for key, (lo, hi, _) in open_.items()})
        bins = min(max(gather_values // len(brackets), 2), MAX_BINS)
        cells: dict[str, Column] = {}
        for b, (c, lo, hi) in enumerate(brackets):
            half = 0.5 if math.isinf(hi - lo) else 1.0
            share = (value[c] * half - F.lit(lo * half)) / F.lit(hi * half - lo * half)
            at = F.least(F.floor(share * bins), F.lit(bins - 1)) + F.lit(b * bins)
            cells[c] = (cells[c] if c in cells else F).when(value[c].between(F.lit(lo), F.lit(hi)), at)
        pairs = F.array(*[F.struct(cell.alias("cell"), value[c].alias("v")) for c, cell in cells.items()])
        counts = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("cell").isNotNull()).groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by_bracket: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: r["cell"]):
            by_bracket.setdefault(r["cell"] // bins, []).append(r)
        for (c, k), (lo, hi, below) in open_.items():
            for r in by_bracket[brackets.index((c, lo, hi))]:
                if k < below + r["n"]:
                    open_[(c, k)] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
            else:
                raise AssertionError("quantile bracket lost its rank")


def exact_quantiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], exact_values: int = EXACT_VALUES,
                    gather_values: int = GATHER_VALUES) -> dict[str, list[float | None]]:
    """Interpolated quantiles of many columns, exact at any size.

    Spark's exact ``percentile`` keeps all distinct values in one buffer, so it serves small tables
    only. Beyond ``exact_values`` each wanted order statistic is bracketed by a least and a largest value. One pass counts the rows
    in equal bins of all brackets (``gather_values`` bins at once) and each bracket becomes its bin, from the least to the largest value
    found there, until the two are one value.
    """
    if not cols:
        return {}
    value = {c: F.nanvl(col(c).cast("double"), F.lit(None)) for c in cols}
    extent = _extent(df, value)
    sizes = {c: extent[c][0] for c in cols}
    if max(sizes.values()) * len(cols) <= exact_values:
        row = df.agg(*[F.percentile(value[c], [float(p) for p in ps]).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(ps) for i, c in enumerate(cols)}
    wanted = {(c, k) for c in cols for p in ps if sizes[c] for k in (math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1)))}
    found = _order_statistics(df, value, extent, wanted, gather_values)
    out = {}
    for c in cols:
        qs = []
        for p in ps:
            if not sizes[c]:
                qs.append(None)
                continue
            at = p * (sizes[c] - 1)
            a, b = found[(c, math.floor(at))], found[(c, math.ceil(at))]
            qs.append(a + (b - a) * (at - math.floor(at)))
        out[c] = qs
    return out


def column_mode(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Most frequent non-null value of each column, the lowest on ties; counted before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.explode(pairs).alias("p")).filter(F.col("p.v").isNotNull()).groupBy("p.i", "p.v").agg(
        F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("i").agg(F.min_by("v", F.struct((-F.col("c")).alias("c"), "v")).alias("v")).collect()
    modes = {r["i"]: r["v"] for r in best}
    return {c: modes.get(i) for i, c in enumerate(cols)}


def fit_impute(df: DataFrame, cols: Sequence[str], method: str = "0") -> dict[str, float | None]:
    """Fill value per column for media, mediana, moda or 0 (any other name means 0)."""
    method = str(method).lower()
    if not cols:
        return {}
    if method == "media":
        row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return dict(zip(cols, row))
    if method == "mediana":
        return {c: q[0] for c, q in exact_quantiles(df, cols, [0.5]).items()}
    if method == "moda":
        return column_mode(df, cols)
    return {c: 0.0 for c in cols}


def apply_impute(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    fix = {c: F.coalesce(col(c).cast("double"), F.lit(float(v))) for c, v in fills.items() if v is not None}
    return df.withColumns(fix) if fix else df


def impute(df: DataFrame, cols: Sequence[str], method: str = "0") -> DataFrame:
    return apply_impute(df, fit_impute(df, cols, method))


def fit_scale(df: DataFrame, cols: Sequence[str], method: str | None) -> dict[str, tuple[float, float]]:
    """(offset, width) per column for MinMaxScaler, StandardScaler (population) or RobustScaler.

    A zero width counts as 1, so constants scale to 0. Any other method scales nothing.
    """
    if method == "MinMaxScaler":
        stats = [x for i, c in enumerate(cols) for x in (F.min(col(c)).alias(f"a{i}"), F.max(col(c)).alias(f"b{i}"))]
        row = df.agg(*stats).first()
        pairs = [(row[f"a{i}"], None if row[f"a{i}"] is None else row[f"b{i}"] - row[f"a{i}"]) for i in range(len(cols))]
    elif method == "StandardScaler":
        stats = [x for i, c in enumerate(cols) for x in (F.avg(col(c)).alias(f"a{i}"), F.stddev_pop(col(c)).alias(f"b{i}"))]
        row = df.agg(*stats).first()
        pairs = [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(cols))]
    elif method == "RobustScaler":
        qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        pairs = [(qs[c][1], None if qs[c][1] is None else qs[c][2] - qs[c][0]) for c in cols]
    else:
        return {}
    return {c: (float(a or 0.0), float(w) if w else 1.0) for c, (a, w) in zip(cols, pairs)}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (col(c) - F.lit(a)) / F.lit(w) for c, (a, w) in fitted.items()}) if fitted else df


def scale(df: DataFrame, cols: Sequence[str], method: str | None) -> DataFrame:
    return apply_scale(df, fit_scale(df, cols, method))


def column_variance(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return dict(zip(cols, row))


def drop_low_variance(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """Columns whose population variance exceeds the threshold; none is an error."""
    var = column_variance(df, cols)
    kept = [c for c in cols if var[c] is not None and var[c] > threshold]
    if not kept:
        raise ValueError(f"no column has a variance above {threshold}")
    return kept


def _gram(df: DataFrame, cols: Sequence[str], means: Sequence[float]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy): pairwise-complete sums of all column pairs.

    Each task adds up matrix products of its batches and emits one row per pair, whatever its
    number of rows.
    """
    k = len(cols)
    centre = np.array(means)
    first, second = np.triu_indices(k, 1)

    def sums(batches):
        n, x, xx, xy = (np.zeros((k, k)) for _ in range(4))
        for pdf in batches:
            m = pdf.to_numpy(dtype=float) - centre
            there = ~np.isnan(m)
            m, there = np.where(there, m, 0.0), there.astype(float)
            n += there.T @ there
            x += m.T @ there
            xx += (m * m).T @ there
            xy += m.T @ m
        yield pd.DataFrame({"i": first, "j": second, "n": n[first, second], "x": x[first, second], "y": x[second, first],
                            "xx": xx[first, second], "yy": xx[second, first], "xy": xy[first, second]})

    parts = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(
        sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def correlation_pairs(df: DataFrame, cols: Sequence[str], jvm_columns: int = 8) -> list[tuple[str, str, float | None]]:
    """(a, b, |Pearson r|) for every a before b, over the rows where both are present; undefined r is None.

    One pass over the data whatever the number of pairs: sums in generated code for a few columns,
    matrix products per task for many. Columns are centred first so that the sums stay accurate.
    """
    means = df.agg(*[F.coalesce(F.avg(col(c)), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if len(cols) > jvm_columns:
        got = {(r["i"], r["j"]): r for r in _gram(df, cols, list(means)).collect()}
    else:
        v = [(col(c) - F.lit(m)).cast("double") for c, m in zip(cols, means)]
        centred = df.select(*[x.alias(f"v{i}") for i, x in enumerate(v)])
        aggs = []
        for i in range(len(cols)):
            for j in range(i + 1, len(cols)):
                x, y = F.col(f"v{i}"), F.col(f"v{j}")
                xy = x * y
                only = lambda e: F.when(xy.isNotNull(), e)  # noqa: E731, B023
                aggs += [F.count(xy).cast("double"), F.sum(only(x)), F.sum(only(y)), F.sum(only(x * x)), F.sum(only(y * y)), F.sum(xy)]
        row = list(centred.agg(*aggs).first())
        pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
        got = {p: dict(zip(("n", "x", "y", "xx", "yy", "xy"), row[6 * t:6 * t + 6])) for t, p in enumerate(pairs)}
    out = []
    for (i, j), s in sorted(got.items()):
        r, n = None, s["n"]
        if n:
            vx, vy = s["xx"] / n - (s["x"] / n) ** 2, s["yy"] / n - (s["y"] / n) ** 2
            # a constant column keeps a variance of rounding size
            if vx > 1e-24 * max(means[i] ** 2, 1e-300) and vy > 1e-24 * max(means[j] ** 2, 1e-300):
                r = min(abs(s["xy"] / n - (s["x"] / n) * (s["y"] / n)) / math.sqrt(vx * vy), 1.0)
        out.append((cols[i], cols[j], r))
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(correlation_pairs(df, cols), "a string, b string, r double")


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """Drop a column if any earlier one (even a dropped one) correlates with it above the threshold."""
    gone = {b for _, b, r in correlation_pairs(df, cols) if r is not None and r > threshold}
    return [c for c in cols if c not in gone]


def label_dictionary(df: DataFrame, label: str, seq: str) -> DataFrame:
    """(idx, name): classes by first appearance, the first BENIGN/NORMAL one moved to 0. One row per class."""
    first = df.groupBy(clean_label(col(label)).alias("name")).agg(F.min(seq).alias("_first"))
    normal = F.upper("name").isin(NORMAL_NAMES)
    lead = Window.partitionBy(normal).orderBy("_first")
    first = first.withColumn("_lead", normal & (F.row_number().over(lead) == 1))
    order = Window.orderBy(F.col("_lead").desc(), "_first")
    return first.select((F.row_number().over(order) - 1).alias("idx"), "name")


def encode_labels(df: DataFrame, label: str, dictionary: DataFrame, name: str = "class_idx") -> DataFrame:
    """Class index of the label, -1 for a label the dictionary lacks."""
    d = dictionary.select(F.col("idx").alias("_idx"), F.col("name").alias("_name"))
    out = join_checked(df, d, clean_label(col(label)) == F.col("_name"), "left")
    return out.withColumn(name, F.coalesce("_idx", F.lit(-1))).drop("_idx", "_name")


def normal_class_index(dictionary: DataFrame) -> int:
    """The least index whose name in the label dictionary is a normal class; 0 where none is."""
    normal = F.upper(F.trim("name")).isin(*NORMAL_NAMES_OR_ZERO)
    return dictionary.agg(F.coalesce(F.min(F.when(normal, F.col("idx"))), F.lit(0))).first()[0]


def class_names(df: DataFrame, dictionary: DataFrame, idx: str, name: str = "class_name") -> DataFrame:
    """Class name of an index; unknown indexes read ``Ataque <idx>``."""
    d = dictionary.select(F.col("idx").alias("_idx"), F.col("name").alias("_name"))
    out = join_checked(df, d, F.col(idx) == F.col("_idx"), "left")
    return out.withColumn(name, F.coalesce("_name", F.concat(F.lit("Ataque "), F.col(idx).cast("string")))).drop("_idx", "_name")


def class_signature(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean of every feature per class; nulls and NaN are skipped."""
    return df.groupBy(col(label).alias("class")).agg(*[F.avg(without_nan(df, c)).alias(c) for c in features])


def scaled_signature(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Long form (class, feature, value): class means, min-max scaled per feature over the classes.

    Written, because distances read it twice.
    """
    sig = class_signature(df, features, label)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).alias("m")) for c in features])
    long = sig.select("class", F.explode(pairs).alias("p")).select("class", "p.*")
    w = Window.partitionBy("feature")
    lo, hi = F.min("m").over(w), F.max("m").over(w)
    value = (F.col("m") - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return written(long.select("class", "feature", value.alias("value")), "signature")


def _dissimilarity(x: Column, y: Column, metric: str) -> Column:
    """Aggregate over the pairs of values of two items; cosine is null where an item is all zeros."""
    gap = F.abs(x - y)
    if metric == "cosine":
        return F.lit(1.0) - F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)))
    known = {"euclidean": F.sqrt(F.sum(gap * gap)), "sqeuclidean": F.sum(gap * gap), "cityblock": F.sum(gap), "chebyshev": F.max(gap)}
    if metric not in known:
        raise ValueError(f"metric is one of {sorted([*known, 'cosine'])}, not {metric}")
    return known[metric]


def pair_distance(signature: DataFrame, item: str, axis: str, metric: str = "euclidean") -> DataFrame:
    """Distance of every two items over the shared axis: euclidean, sqeuclidean, cityblock, chebyshev or cosine.

    The signature holds one row per class and feature, so this joins class means, never rows of the data;
    the result has a row for every two items, as a distance report does.
    """
    left = signature.select(F.col(item).alias("a"), axis, F.col("value").alias("x"))
    right = signature.select(F.col(item).alias("b"), axis, F.col("value").alias("y"))
    both = left.join(right, axis).filter(F.col("a") < F.col("b"))
    return both.groupBy("a", "b").agg(_dissimilarity(F.col("x"), F.col("y"), metric).alias("distance"))


def class_distance(df: DataFrame, features: Sequence[str], label: str, metric: str = "euclidean") -> DataFrame:
    return pair_distance(scaled_signature(df, features, label), "class", "feature", metric)


def feature_distance(df: DataFrame, features: Sequence[str], label: str, metric: str = "euclidean") -> DataFrame:
    return pair_distance(scaled_signature(df, features, label), "feature", "class", metric)
