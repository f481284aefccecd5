"""Building data sets: balanced sets, labelled scenarios, windowed, overlaid and interval-labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowstream.functions.columns import clean_label, col, is_benign, label_column, normalize_columns, parse_time, time_column
from flowstream.operators.ordering import interleave, sort_by_time, with_seq
from flowstream.operators.sampling import SEED, balanced_sample, stratified_sample, take_blocks
from flowstream.operators.windowing import (drop_bad_times, label_by_intervals, overlay_by_timestamp, time_range, window_summary)
from flowstream.sources.flows import materialize_once, read_flows, write_table
from flowstream.session import written


def balanced_dataset(df: DataFrame, n: int, id_cols: Sequence[str], label: str | None = None, ts: str | None = None, ignored: Sequence[str] = (),
                     allow_insufficient: bool = False, time_format: str | None = None, out: str | None = None, fmt: str = "parquet") -> DataFrame:
    """n random rows per class from one table of all files, in order of time; optionally written.

    The label and time columns are found by name unless given. Without a time column the rows keep no order; rows without
    a readable time stand last.
    """
    df = normalize_columns(df)
    label, ts = label or label_column(df), ts or time_column(df)
    if label is None:
        raise ValueError(f"no label column among {df.columns}")
    if ts and dict(df.dtypes)[ts] == "string":
        df = df.withColumn(ts, parse_time(col(ts), time_format))
    picked = balanced_sample(df, n, id_cols, label, ignored, allow_insufficient)
    order = [col(ts).asc_nulls_last(), *[col(c) for c in id_cols]] if ts else None
    if out:
        write_table(picked, out, fmt, order_by=order)
    return picked.orderBy(*order) if order else picked


def benign_baseline(spark: SparkSession, paths, path: str, types: dict[str, str] | None = None, fmt: str = "csv",
                    ts: str = "Timestamp", label: str = "Label") -> DataFrame:
    """All benign rows in order of time, built once and kept at ``path``."""
    def build():
        df = read_flows(spark, paths, fmt, types)
        df = df.filter(is_benign(col(label))).withColumn(ts, parse_time(col(ts)))
        return sort_by_time(df, ts, ["source_file"])
    return materialize_once(spark, path, build)


def build_scenario(flows: DataFrame, config: Sequence[tuple], id_cols: Sequence[str], n_benign: int | None = None,
                   baseline: DataFrame | None = None, key: str | None = None, ts: str = "Timestamp", label: str = "Label",
                   source: str = "source_file", sort_by_timestamp: bool = True, remove_duplicates: bool = True,
                   file_order: Sequence[str] | None = None, out: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Benign rows in slices with attack blocks between them; ``position`` is the final order.

    ``id_cols`` name a row and break ties of time. With ``sort_by_timestamp`` the result is put back in
    order of time, which undoes the interleaving (the default of the workflow this serves).
    """
    flows = normalize_columns(flows).withColumn(label, clean_label(col(label)))
    benign = baseline if baseline is not None else flows.filter(is_benign(col(label)))
    benign = stratified_sample(benign, n_benign, id_cols, key)
    benign = with_seq(benign, [col(ts).asc_nulls_last(), *[col(c) for c in id_cols]])
    placed = with_seq(flows, file_order or [col(ts).asc_nulls_last(), *[col(c) for c in id_cols]], by=[source])
    attacks, sizes = take_blocks(placed, config, source, label)
    if not sizes:
        raise ValueError("no attack rows match the configuration")
    total = benign.count()
    cols = [c for c in flows.columns if c != source]
    benign = benign.select(*[col(c) for c in cols if c in benign.columns], "seq")
    stream = interleave(benign, attacks.select(*[col(c) for c in cols], "seq", "block"), len(sizes), total).drop("seq", "block")
    if remove_duplicates:
        data = [c for c in stream.columns if c != "position"]
        stream = stream.groupBy(*[col(c) for c in data]).agg(F.min("position").alias("position"))
    order = [col(ts).asc_nulls_last(), "position"] if sort_by_timestamp else ["position"]
    stream = with_seq(stream, order, name="_new")
    stream = stream.drop("position").withColumnRenamed("_new", "position")
    if out:
        write_table(stream, out, fmt, order_by=["position"])
    return stream


def window_dataset(df: DataFrame, freq: str = "1 second", ts: str = "Timestamp", label: str = "Label", out: str | None = None,
                   fmt: str = "parquet", dropped: Observation | None = None) -> DataFrame:
    """Strip names, read times, drop unreadable ones, summarise per window, fill gaps. ``dropped`` receives how many rows
    had no readable time."""
    df = normalize_columns(df)
    if dict(df.dtypes)[ts] == "string":
        df = df.withColumn(ts, parse_time(col(ts)))
    res = window_summary(drop_bad_times(df, ts, dropped), ts, freq, label)
    if out:
        write_table(res, out, fmt, order_by=[ts])
    return res


def overlay_attacks(base: DataFrame, attacks: Sequence[DataFrame], ts: str = "Timestamp", order_by: Sequence[str] = (),
                    out: str | None = None, fmt: str = "parquet") -> tuple[DataFrame, int, int]:
    """Windowed attack tables laid over the benign one; also the rows processed and replaced."""
    if not attacks:
        raise ValueError("no attack table given")
    merged = written(overlay_by_timestamp(normalize_columns(base), [normalize_columns(a) for a in attacks], ts, order_by), "overlay")
    n, hit = merged.agg(F.count(F.lit(1)), F.count_if("_replaced")).first()
    merged = merged.drop("_replaced")
    if out:
        write_table(merged, out, fmt, order_by=[ts])
    return merged, n, hit


def filter_and_label(df: DataFrame, start, end, rules, ts: str = "timestamp", time_format: str | None = None,
                     out: str | None = None, fmt: str = "parquet", dropped: Observation | None = None) -> DataFrame:
    """Rows in a period, labelled by intervals. ``dropped`` receives how many rows had no readable time."""
    df = normalize_columns(df)
    if dict(df.dtypes)[ts] == "string":
        df = df.withColumn(ts, parse_time(col(ts), time_format))
    res = label_by_intervals(time_range(drop_bad_times(df, ts, dropped), ts, start, end), ts, rules)
    if out:
        write_table(res, out, fmt)
    return res
