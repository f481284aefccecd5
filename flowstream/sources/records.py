"""Where the records of delimited files begin, and how their fields are separated, found by Spark over file splits.

A quoted cell may hold line breaks, so a line is not a record, and a split may begin inside a cell. One aggregation counts the
odd lines of every split; the sums over a file's earlier splits tell whether a split begins inside a cell. Then each task joins its own lines
to records. A record that crosses splits comes as fragments, two a split at most, which alone are shuffled and joined.

Quotes count where they can begin or end a cell or stand doubled in one; one between other characters (5" pipe) is text. A file whose
quotes don't balance is read by lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowstream.session import written

#: Separators that a file may have, in order of preference.
SEPARATORS = (",", ";", "\t", "|")
BROADCAST_SPLITS = 1_000_000  # splits that begin inside a cell, at most so many are sent to the tasks


def lines_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, file, block, source_file): every line with its file and the start of its split."""
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_block_start", "block"), ("file_name", "source_file"))]
    return spark.read.text(list(paths)).select("value", *meta)


def odd_quotes(line: Column, sep: str = "") -> Column:
    """Whether a line has an odd number of quotes that can begin or end a cell."""
    border = "".join(f"\\x{{{ord(c):x}}}" for c in (*SEPARATORS, *sep, '"'))
    stray = F.regexp_count(line, F.lit(f'(?<=[^{border}])"(?=[^{border}])'))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    return (quotes > 0) & ((quotes - stray) % 2 == 1)


def _counts(line: Column) -> list[Column]:
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    return [(F.length(bare) - F.length(F.replace(bare, F.lit(s)))).alias(f"n{i}") for i, s in enumerate(SEPARATORS)]


def header_lines(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of every file. Only each file's first split is looked at."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            files = batch.column(1).to_pylist()
            new = [i for i, f in enumerate(files) if f != (files[i - 1] if i else before)]
            before = files[-1] if files else before
            rows = batch.take(pa.array(new, pa.int64()))
            yield pa.record_batch([rows.column(1), rows.column(0)], ["file", "header"])

    return lines.where("block = 0").select("value", "file").mapInArrow(first, "file string, header string")


def file_facts(lines: DataFrame, sep: str | None) -> list[tuple[str, str, str, bool]]:
    """Per file: path (Spark's metadata quote it like a URI), header line, separator, whether it has quoted line breaks.

    Without ``sep`` every line of a file votes: the separator that most lines have as often as the header wins, then
    the one that the header has more often. The driver gets one row per file.
    """
    odd = lines.groupBy("file").agg(F.sum(odd_quotes(F.col("value"), sep or "").cast("long")).alias("odd"))
    files = written(header_lines(lines).join(odd, "file").select("file", "header", ((F.col("odd") > 0) & (F.col("odd") % 2 == 0)).alias("breaks")), "headers")
    if sep is not None:
        return [(unquote(r.file), r.header, sep, r.breaks) for r in files.collect()]
    width = range(len(SEPARATORS))
    shapes = lines.where(F.trim("value") != "").select("file", *_counts(F.col("value"))).groupBy("file", *[f"n{i}" for i in width]).count()
    heads = files.select("file", "header", "breaks", *[c.alias(f"h{i}") for i, c in enumerate(_counts(F.col("header")))])
    agree = [F.sum(F.when((F.col(f"n{i}") == F.col(f"h{i}")) & (F.col(f"h{i}") > 0), F.col("count")).otherwise(0)) for i in width]
    votes = F.array(*[F.struct(a.alias("lines"), F.first(f"h{i}").alias("fields"), F.lit(-i).alias("rank")) for i, a in enumerate(agree)])
    best = heads.join(shapes, "file", "left").groupBy("file", "header", "breaks").agg(F.array_max(votes).alias("v"))
    return [(unquote(r.file), r.header, SEPARATORS[-r.v["rank"]], r.breaks) for r in best.collect()]


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans of the same files are cut alike, also if the cluster grows or shrinks in between."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def records_of(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """(value, source_file): the records of files whose quoted cells hold line breaks. A record keeps its inner breaks as newlines."""
    lines = lines_of(spark, paths).withColumn("odd", odd_quotes(F.col("value"), sep))
    with _same_splits(spark):
        by_split = lines.groupBy("file", "block").agg(F.sum(F.col("odd").cast("long")).alias("odd"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        inside = by_split.withColumn("_before", F.sum("odd").over(before)).where("_before % 2 = 1").select("file", "block")
        known = {(r.file, r.block) for r in inside.limit(BROADCAST_SPLITS + 1).collect()}
        if len(known) > BROADCAST_SPLITS:
            raise ValueError(f"over {BROADCAST_SPLITS} splits begin inside a quoted cell; use larger splits")
        got = written(_joined(lines, known), "records")
    # in a split, the end of an earlier record (part 0) comes before the begin of the next (part 1)
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = got.where("part >= 0").withColumn("_record", F.sum("part").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "value"))), lambda p: p["value"]), "\n")
    stitched = pieces.groupBy("file", "_record").agg(text.alias("value"), F.first("source_file").alias("source_file"))
    return got.where("part < 0").select("value", "source_file").unionByName(stitched.select("value", "source_file"))


def _joined(lines: DataFrame, known: set[tuple[str, int]]) -> DataFrame:
    """Lines joined to records where they are: whole records (part -1), and fragments that begin (1) or go on with (0) a
    record that crosses splits. ``known`` are the splits that begin inside a cell."""
    names = ["value", "source_file", "file", "block", "part"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], 0  # the split; lines of an unfinished record; 0 if it began in an earlier split, else 1
        last = None  # values of the split's last line

        def rest() -> list[tuple]:
            return [("\n".join(held), last[1], last[0], last[2], part)] if held else []

        def table(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()))], names)

        for batch in batches:
            values, odd = batch.column(0), batch.column(4).to_numpy(zero_copy_only=False)
            files, blocks, sources = (batch.column(i).to_pylist() for i in (1, 2, 3))
            complete, out = np.zeros(len(odd), bool), []
            stops = [i for i in range(1, len(odd)) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]] + [len(odd)]
            start = 0
            for stop in stops:
                if start == stop:
                    continue
                if at != (files[start], blocks[start]):
                    out += rest()
                    at, held = (files[start], blocks[start]), []
                    part, is_open = 0, at in known
                else:
                    is_open = bool(held) or is_open
                last = (files[start], sources[start], blocks[start])
                marks, i = (start + np.flatnonzero(odd[start:stop])).tolist() + [stop], start
                for m in marks:
                    if not is_open:
                        complete[i:m] = True
                        if m < stop:
                            held, part, is_open = [values[m].as_py()], 1, True
                    else:
                        held += values.slice(i, min(m + 1, stop) - i).to_pylist()
                        if m < stop:
                            out.append(("\n".join(held), sources[m], files[m], blocks[m], -1 if part else 0))
                            held, is_open = [], False
                    i = m + 1
                start = stop
            rows = batch.take(pa.array(np.flatnonzero(complete)))
            yield pa.record_batch([rows.column(0), rows.column(3), rows.column(1), rows.column(2), pa.array(np.full(rows.num_rows, -1), pa.int32())], names)
            yield from table(out)
        yield from table(rest())

    return lines.select("value", "file", "block", "source_file", "odd").mapInArrow(join, "value string, source_file string, file string, block long, part int")
