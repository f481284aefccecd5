"""From a raw flow table to scaled features, a class index and the label dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.functions.columns import (clamp_infinity, col, drop_identifiers, encode_binary, keep_features,
                                          normalize_columns, numeric_columns)
from flowstream.operators import profile as P
from flowstream.operators.ordering import with_seq
from flowstream.session import written


@dataclass
class Prepared:
    """``table`` holds seq, class_idx and the features; ``names`` maps the class index to its name."""
    table: DataFrame
    features: list[str]
    names: list[str]
    fills: dict = field(default_factory=dict)
    scaling: dict = field(default_factory=dict)


def prepare(df: DataFrame, label: str = "Label", order_by: Sequence[str] = ("Timestamp",), binary: bool = True,
            normalize: str | None = None, threshold_var: float | None = None, threshold_corr: float | None = None,
            top_n: int | None = None, selected: Sequence[str] | None = None, extra_ignore=None, imputation: str = "0",
            fit_rows: int | None = None) -> Prepared:
    """Strip names, whitelist, drop identifiers, keep numbers, clamp infinities, impute, scale, encode, select.

    Statistics come from the whole table, or with ``fit_rows`` from the first rows only (no look-ahead).
    """
    df, label = normalize_columns(df), label.strip()
    order_by = [o.strip() if isinstance(o, str) else o for o in order_by]
    df = with_seq(df, order_by)
    if selected is not None:
        df = keep_features(df, [*selected, "seq"], label)
    x = drop_identifiers(df, extra_ignore)
    features = [c for c in numeric_columns(x) if c not in (label, "seq")]
    x = clamp_infinity(x.select("seq", col(label).alias("_label"), *[col(c) for c in features]), features)
    fit = (lambda t: t) if fit_rows is None else (lambda t: t.filter(F.col("seq") < fit_rows))
    fills = P.fit_impute(fit(x), features, imputation)
    x = P.apply_impute(x, fills)
    scaling = P.fit_scale(fit(x), features, normalize)
    x = P.apply_scale(x, scaling)
    if binary:
        names = ["BENIGN", "ATTACK"]
        x = x.withColumn("class_idx", encode_binary(F.col("_label")))
    else:
        d = written(P.label_dictionary(x, "_label", "seq"), "dictionary")
        names = [r["name"] for r in d.orderBy("idx").collect()]
        x = P.encode_labels(x, "_label", d)
    if threshold_var is not None:
        features = P.drop_low_variance(fit(x), features, threshold_var)
    if threshold_corr is not None:
        features = P.drop_correlated(fit(x), features, threshold_corr)
    if top_n is not None and len(features) > top_n:
        from flowstream.operators.ranking import rf_top_features
        features = rf_top_features(fit(x), features, "class_idx", top_n)
    return Prepared(x.select("seq", "class_idx", *[col(c) for c in features]), features, names, fills, scaling)


def apply_prepared(df: DataFrame, fitted: Prepared) -> DataFrame:
    """Stored fills and scaling on other rows, also on a stream (projections only)."""
    df = clamp_infinity(normalize_columns(df), list(fitted.fills))
    df = P.apply_impute(df, {c: v for c, v in fitted.fills.items() if c in fitted.features})
    return P.apply_scale(df, {c: s for c, s in fitted.scaling.items() if c in fitted.features})
