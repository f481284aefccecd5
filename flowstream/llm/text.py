"""Arrow batches of texts as flat byte arrays, and small helpers that all operators of this package share.

The numeric operators never loop over rows in Python: a batch of texts is one uint8 array with row offsets, and
words, character n-grams and shingles are hashed with numpy over the whole array.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowstream.session import fresh_path

BLOCK = 1 << 19  # bytes of text handled by one round of numpy calls
MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, for multiplicative hashing

#: Byte classes: the six separators of words, and ASCII capitals to small letters.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand texts to Python in batches of some MB: documents are larger than the rows its default is for."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))


def free_name(columns: Iterable[str], base: str) -> str:
    """A column name that clashes with none of ``columns`` (names are compared without case)."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed(columns: Iterable[str], name: str) -> Column:
    """The columns as one struct column, which passes through Python whatever the columns are called."""
    return F.struct(*[quoted(c) for c in columns]).alias(name)


def unpacked(columns: Iterable[str], name: str) -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def id_hash(column: Column) -> Column:
    """crc32 of a key as decimal text; deals rows to folds."""
    return F.crc32(column.cast("string").cast("binary"))


def stored(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as zstd Parquet and read back: lineage ends here, so a lost executor costs
    only the tasks that read, and a later reader prunes columns."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text (one text at least): slice, bytes, offsets."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        raw, offsets = flat(column)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, end - at), raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the first word index of each row (with the total at the end). A word is a run of bytes other
    than space, tab, newline, vertical tab, form feed and return, and ends with its row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i up to n."""
    if "b" not in _POWERS or len(_POWERS["b"]) < n:
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        size = max(n, BLOCK + 1)
        for key, b in (("b", base), ("i", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each span; equal bytes give equal hashes wherever they stand."""
    powers, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MULT)


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive word hashes that stay within a row, and the first n-gram index of each row."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(3) + words[at + k] + np.uint64(k + 1))
    return h, offsets


def char_grams(raw: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of the byte n-grams (ASCII letters small, up to 7 bytes, never across rows) and their rows'
    offsets. One bucket space holds all sizes."""
    small = LOWER[raw]
    for n in sizes:
        counts = np.maximum(np.diff(offsets) - (n - 1), 0)
        grams = np.concatenate([[0], np.cumsum(counts)])
        if len(raw) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        v = small[:len(raw) - n + 1].astype(np.uint64)
        for k in range(1, n):
            v = (v << np.uint64(8)) | small[k:len(raw) - n + 1 + k]
        v ^= np.uint64(n << 59)
        h = ((v * MULT) >> np.uint64(64 - bits)).astype(np.int64)
        # a gram that starts in the last n - 1 bytes of a row leaves the row
        ok = np.ones(len(h), bool)
        for k in range(1, n):
            cut = offsets[1:] - k
            cut = cut[(cut >= 0) & (cut < len(h))]
            ok[cut] = False
        yield h[ok], grams
