"""Reading and writing flow tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowstream.functions.columns import col, normalize_columns
from flowstream.sources.records import file_facts, lines_of, records_of


#: Cells that mean a missing value, as common readers of such files take them.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _glob(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [str(s.getPath().toString()) for s in found] if found else []


def existing_paths(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The paths (globs allowed) that exist; missing files are skipped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return [hit for p in paths for hit in _glob(spark, p)]


def _read_csv(records: DataFrame, header_line: str, sep: str) -> DataFrame:
    """Records (value, source_file) of files with one header, all columns as text. Records with too many fields are skipped, short
    ones are padded with nulls, undecodable bytes are dropped; header lines are not data."""
    header = next(csv.reader([header_line.lstrip("\ufeff")], delimiter=sep))
    names = [h or f"Unnamed: {i}" for i, h in enumerate(header)]
    line = F.translate("value", "\ufffd", "")
    raw = records.select("value", line.alias("line"), "source_file")
    raw = raw.filter((F.col("value") != header_line) & (F.trim("value") != ""))
    separators = lambda c: F.length(c) - F.length(F.replace(c, F.lit(sep)))
    n = len(names)
    # quoted separators are looked at only where there are too many of any kind
    border = "".join(f"\\x{{{ord(c):x}}}" for c in sep)
    outside = F.regexp_replace(F.replace("line", F.lit('""'), F.lit("")), f'(^|{border})"[^"]*"(?={border}|$)', "$1")
    too_long = (separators(F.col("line")) >= n) & (separators(outside) >= n)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    options = {"sep": sep, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    parsed = raw.filter(~too_long).select(F.from_csv("line", schema.toDDL(), options).alias("r"), "source_file")
    return parsed.select(*[F.col("r").getField(c).alias(c) for c in names], "source_file")


def infer_types(df: DataFrame, skip: Sequence[str] = ()) -> dict[str, str]:
    """bigint, double or string for each text column, found in one aggregation."""
    names = [c for c in df.columns if c not in skip]
    bad = []
    for i, c in enumerate(names):
        there = col(c).isNotNull() & (F.trim(col(c)) != "")
        bad.append(F.count_if(there & col(c).try_cast("bigint").isNull()).alias(f"l{i}"))
        bad.append(F.count_if(there & col(c).try_cast("double").isNull()).alias(f"d{i}"))
        bad.append(F.count_if(there).alias(f"n{i}"))
    row = df.agg(*bad).first()
    kinds = {}
    for i, c in enumerate(names):
        if row[f"n{i}"] == 0 or row[f"d{i}"] > 0:
            kinds[c] = "string"
        else:
            kinds[c] = "bigint" if row[f"l{i}"] == 0 else "double"
    return kinds


def read_flows(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", types: dict[str, str] | None = None,
               sep: str | None = ",", strip_names: bool = True) -> DataFrame:
    """Tolerant scan of one or many flow files; ``source_file`` keeps the file identity.

    CSV files of different headers are united by column name; ``sep=None`` finds each file's separator. Quoted cells may hold
    line breaks, except in the header. For CSV, ``types`` maps column names to SQL types; without it the types are inferred.
    """
    found = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError(f"none of the flow files exists: {paths}")
    if fmt != "csv":
        df = spark.read.format(fmt).load(found)
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
        return normalize_columns(df) if strip_names else df
    alike: dict[tuple[str, str, bool], list[str]] = {}
    for path, header, separator, breaks in file_facts(lines_of(spark, found), sep):
        alike.setdefault((header, separator, breaks), []).append(path)
    tables = []
    for (header, separator, breaks), files in sorted(alike.items(), key=lambda a: min(a[1])):
        records = records_of(spark, files, separator) if breaks else lines_of(spark, files).select("value", "source_file")
        tables.append(_read_csv(records, header, separator))
    df = union_tables([normalize_columns(t) if strip_names else t for t in tables])
    df = df.withColumns({c: F.when(~F.trim(col(c)).isin(*MISSING), col(c)) for c in df.columns if c != "source_file"})
    kinds = types or infer_types(df, skip=["source_file"])
    casts = {c: F.trim(col(c)).try_cast(t) for c, t in kinds.items() if t != "string" and c in df.columns}
    return df.withColumns(casts)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                order_by: Sequence | None = None) -> None:
    """One write for the whole table; with ``order_by`` the files hold consecutive ranges."""
    out = df.orderBy(*order_by) if order_by else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def materialize_once(spark: SparkSession, path: str, build, fmt: str = "parquet") -> DataFrame:
    """Load ``path`` if it is there, otherwise build the table, write it, and load that."""
    if not existing_paths(spark, path):
        write_table(build(), path, fmt, mode="errorifexists")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True).option("escape", '"')
    return reader.load(path)


def class_report(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per label, most frequent first."""
    counts = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label")


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns missing in one table become null, duplicates stay."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
