"""Exact dedup in two Bloom-filtered passes, with DataFrame functions only.

Pass one counts the filter positions that the rows' 64-bit text hashes set, and packs the positions set at least twice
into a filter of bitmaps. Pass two tests every row: a text whose positions are not all in the filter is certainly
unique and passes straight through; only the others are shuffled and compared by SHA-256.

The filter is blocked (both positions of a hash lie in one bitmap of 32,768 bits) and sized at 16 bits a row up to
``MAX_FILTER_BITS``. That bound of 32 MB makes it safe to broadcast; beyond it more unique rows fail the test and are
shuffled, and the result stays the same.

Rules for odd input: null counts as empty, and empty texts are equal to each other. Of equal texts the row with the
largest id stays (a null id is smaller than any other). Of rows that repeat both id and text, one stays. An empty
table gives an empty result. Other columns are carried untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowstream.llm.skew import join_counted
from flowstream.llm.text import free_name, packed, quoted, stored, text_or_empty, unpacked

BITMAP = 32_768  # bits in a value of bitmap_construct_agg
MAX_FILTER_BITS = 1 << 28


def _bitmaps(rows: int) -> int:
    n = 1
    while n * BITMAP < 16 * rows and n * BITMAP < MAX_FILTER_BITS:
        n *= 2
    return n


def _positions(h: Column, bitmaps: int) -> tuple[Column, Column, Column]:
    return (F.pmod(h, F.lit(bitmaps)), F.shiftrightunsigned(h, 49), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BITMAP - 1)))


def repeated_filter(hashes: DataFrame, bitmaps: int) -> DataFrame:
    """(_bucket, _bits): filter positions that at least two rows of ``hashes`` (column _h) set."""
    bucket, one, two = _positions(F.col("_h"), bitmaps)
    set_bits = hashes.select(bucket.alias("_bucket"), F.explode(F.array(one, two)).alias("_at"))
    return (set_bits.groupBy("_bucket", "_at").count().where("count > 1")
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")))


def with_suspicion(rows: DataFrame, filter_: DataFrame, bitmaps: int, name: str) -> DataFrame:
    """Adds ``name``: whether the row's hash (column _h) is possibly repeated."""
    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftrightunsigned(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("getbit", byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1

    bucket, one, two = _positions(F.col("_h"), bitmaps)
    joined = rows.withColumn("_bucket", bucket).join(F.broadcast(filter_), "_bucket", "left")  # 32 MB at most
    return joined.withColumn(name, F.coalesce(is_set(one) & is_set(two), F.lit(False))).drop("_bucket", "_bits")


def mark_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    hashed = stored(docs.select(quoted(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.sha2(text.cast("binary"), 256).alias("_sha")), "hashes")
    total = hashed.count()
    bitmaps = _bitmaps(total)
    tested = with_suspicion(hashed, stored(repeated_filter(hashed, bitmaps), "filter", 1), bitmaps, "_maybe")
    unique = tested.where(~F.col("_maybe")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    # rows that repeat id and text collapse to a count, so a hot text is combined before every shuffle
    maybe = stored(tested.where("_maybe").groupBy("_sha", "_id").agg(F.count("*").alias("_n")), "maybe")
    groups = stored(maybe.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_rows")), "groups")
    marked = join_counted(maybe, groups, ["_sha"], "_rows", total).withColumn("_k", F.explode(F.expr("sequence(1L, _n)")))
    return unique.unionByName(marked.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_k") == 1)).alias("kept"), F.col("_sha").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without copies, all columns kept. Unique rows stay where they are; of the others the surviving row
    is picked by an aggregation that combines before the shuffle."""
    cols = docs.columns
    row, tie = free_name([*cols, "_h", "_sha", "_bucket", "_bits", "_maybe"], "_row"), F.col("_order")
    text = text_or_empty(text_col)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(packed(cols, row), F.xxhash64(text).alias("_h"), F.sha2(text.cast("binary"), 256).alias("_sha"),
                       F.struct(quoted(id_col), F.xxhash64(*[quoted(c) for c in plain])).alias("_order"))
    hashes = docs.select(F.xxhash64(text).alias("_h"))
    bitmaps = _bitmaps(docs.count())
    tested = with_suspicion(rows, stored(repeated_filter(hashes, bitmaps), "filter", 1), bitmaps, "_maybe")
    best = tested.where("_maybe").groupBy("_sha").agg(F.max_by(row, tie).alias(row))
    both = tested.where(~F.col("_maybe")).select(row).unionByName(best.select(row))
    return both.select(*unpacked(cols, row))
