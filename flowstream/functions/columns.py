"""Column helpers: header names, labels, lenient parsing, infinities, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier columns of flow files, normal class names, float32 limit.
ID_COLUMNS = ["Flow ID", "Timestamp", "SimillarHTTP", "Unnamed: 0"]
NORMAL_NAMES = ["BENIGN", "NORMAL"]
NORMAL_NAMES_OR_ZERO = ["BENIGN", "NORMAL", "0"]
FLOAT32_MAX = 3.4028234663852886e38
ENTROPY_FRAGMENTS = ["IP", "Port", "Protocol"]
TIME_FRAGMENTS = ["timestamp", "time", "date"]
STRATIFY_FRAGMENTS = ["destination port", "protocol"]

_BLANKS = " \t\r\n"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col(quoted(name))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip outer blanks from header names."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after stripping: {names}")
    return df.toDF(*names)


def find_column(columns: Sequence[str], fragments: Sequence[str], by_fragment: bool = False) -> str | None:
    """First column whose name holds a fragment (any case).

    By default columns are visited in schema order; ``by_fragment`` exhausts one fragment
    before trying the next.
    """
    if by_fragment:
        hits = (c for f in fragments for c in columns if f in c.lower())
    else:
        hits = (c for c in columns if any(f in c.lower() for f in fragments))
    return next(hits, None)


def label_column(df: DataFrame) -> str | None:
    return find_column(df.columns, ["label"])


def time_column(df: DataFrame) -> str | None:
    return find_column(df.columns, TIME_FRAGMENTS)


def stratify_column(df: DataFrame) -> str | None:
    return find_column(df.columns, STRATIFY_FRAGMENTS, by_fragment=True)


def clean_label(c: Column) -> Column:
    """Label as trimmed text; a missing label becomes the class UNKNOWN."""
    return F.coalesce(F.trim(c.cast("string"), F.lit(_BLANKS)), F.lit("UNKNOWN"))


def is_benign(c: Column) -> Column:
    return F.upper(clean_label(c)) == "BENIGN"


def is_class(c: Column, classes: str | Sequence[str]) -> Column:
    wanted = [classes] if isinstance(classes, str) else list(classes)
    return clean_label(c).isin([w.strip() for w in wanted])


def without_classes(df: DataFrame, label: str, ignored: Sequence[str]) -> DataFrame:
    return df.filter(~is_class(col(label), ignored)) if ignored else df


def drop_identifiers(df: DataFrame, extra: str | Sequence[str] | None = None) -> DataFrame:
    extra = [extra] if isinstance(extra, str) else list(extra or [])
    return df.drop(*[c for c in ID_COLUMNS + extra if c in df.columns])


def keep_features(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Listed columns that exist, in list order, and always the target."""
    place = {name: i for i, name in reversed(list(enumerate([*features, target])))}
    return df.select(*[col(c) for c in sorted(place.keys() & set(df.columns), key=place.__getitem__)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def clamp_infinity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinities become the float32 limits and NaN becomes null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def fixed(name: str) -> Column:
        c = col(name).cast("double")
        return (
            F.when(F.isnan(c), None)
            .when(c == float("inf"), F.lit(FLOAT32_MAX))
            .when(c == float("-inf"), F.lit(-FLOAT32_MAX))
            .otherwise(c)
        )

    return df.withColumns({c: fixed(c) for c in cols if c in floats})


def parse_number(c: Column) -> Column:
    """Lenient number: unreadable text becomes null."""
    return c.try_cast("double")


def parse_time(c: Column, fmt: str | None = None) -> Column:
    """Lenient timestamp: the given format first, then Spark's own reading, else null."""
    text = c.cast("string")
    free = F.try_to_timestamp(text)
    return free if fmt is None else F.coalesce(F.try_to_timestamp(text, F.lit(fmt)), free)


def encode_binary(c: Column) -> Column:
    """BENIGN is 0, every other label 1."""
    return F.when(is_benign(c), 0).otherwise(1)


def encode_index(c: Column, normal_idx: int = 0) -> Column:
    """Class index to 0 (normal) or 1 (attack)."""
    return F.when(c == normal_idx, 0).otherwise(1)


def collapse_prediction(c: Column) -> Column:
    """Multiclass prediction to 0/1; no prediction counts as normal."""
    return F.when(F.coalesce(c, F.lit(0)) > 0, 1).otherwise(0)


def discretize(score: Column, threshold: float | Column) -> Column:
    """1 when the score is strictly above the threshold."""
    return F.coalesce((score > threshold).cast("int"), F.lit(0))


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, for aggregates that must skip it."""
    c = col(name)
    return F.when(~F.isnan(c), c) if dict(df.dtypes)[name] in ("double", "float") else c


def suffix_entropy(df: DataFrame, cols: Sequence[str], label: str = "Label") -> DataFrame:
    """``X`` to ``X_Entropy`` for the listed columns; the label moves to the end."""
    df = df.withColumnsRenamed({c: f"{c}_Entropy" for c in cols})
    order = [c for c in df.columns if c != label] + ([label] if label in df.columns else [])
    return df.select(*[col(c) for c in order])


def fill_flow_nulls(df: DataFrame, label: str = "Label") -> DataFrame:
    """Missing or N/A label to BENIGN; every other missing number to 0, missing text to '0'."""
    values = {}
    for f in df.schema.fields:
        if f.name == label:
            values[f.name] = "BENIGN"
        elif isinstance(f.dataType, T.NumericType):
            values[f.name] = 0
        elif isinstance(f.dataType, T.StringType):
            values[f.name] = "0"
    df = df.na.fill({quoted(k) if "." in k else k: v for k, v in values.items()}) if values else df
    if label in df.columns:
        df = df.withColumn(label, F.when(col(label) == "N/A", "BENIGN").otherwise(col(label)))
    return df
