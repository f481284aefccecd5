"""Row order as data: dense sequence numbers, runs, moving averages, slices, interleaving.

``with_seq`` sorts once by range partitioning. All later operators cut the stream into blocks
of ``block_rows`` consecutive rows, work inside the blocks in parallel and carry a small
per-block total across, so a single stream of any length never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstream.session import join_checked, written

BLOCK_ROWS = 65_536


def _keys(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def sort_by_time(df: DataFrame, ts: str = "Timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """Chronological order, unreadable times last, ties in the order of ``tie``."""
    return df.orderBy(F.col(ts).asc_nulls_last(), *tie)


def with_seq(df: DataFrame, order_by: Sequence[str | Column], by=None, name: str = "seq") -> DataFrame:
    """Dense 0-based position of each row in its stream (or in the whole table).

    One range sort, no window: Spark's sort spreads any stream, and any tied value of the first
    order column, over many partitions. The position is the row's index in its partition plus
    the sizes of the partitions before it. The sorted table is written once, because the sizes and
    the rows have to come from the same set of partitions.
    """
    by = _keys(by)
    mid = F.monotonically_increasing_id()
    table = written(df.orderBy(*by, *order_by).withColumn("_mid", mid), "seq")
    table = table.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    # one row per sorted partition: counted once, small enough for the driver and for a broadcast
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    parts = [r["_part"] for r in sizes]
    offsets = list(zip(parts, accumulate((r["n"] for r in sizes), initial=0)))
    offsets = df.sparkSession.createDataFrame(offsets, "_part long, _off long")
    table = table.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + F.col("_at"))
    if by:
        starts = table.groupBy(*by).agg(F.min(name).alias("_start"))
        starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_start")
        cond = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        table = join_checked(table, starts, cond).withColumn(name, F.col(name) - F.col("_start"))
        table = table.drop("_start", *[f"_by_{c}" for c in by])
    return table.drop("_mid", "_part", "_at", "_off")


def _block(seq: str, block_rows: int) -> Column:
    return F.expr(f"`{seq}` div {block_rows}")


def with_halo(df: DataFrame, rows: int, seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_blk`` and copy the last ``rows`` rows of every block into the next block as ``_halo``."""
    if rows > block_rows:
        raise ValueError("halo wider than a block")
    blk = _block(seq, block_rows)
    near_end = F.col(seq) % block_rows >= block_rows - rows
    homes = F.when(near_end, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return df.withColumn("_blk", F.explode(homes)).withColumn("_halo", F.col("_blk") != blk)


def running_sums(
    df: DataFrame, sums: dict[str, Column], by=None, seq: str = "seq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running sums along ``seq``: block totals, a window over the few totals, then inside the block."""
    by = _keys(by)
    vals = {f"_v{i}": c for i, c in enumerate(sums.values())}
    rows = df.withColumn("_blk", _block(seq, block_rows)).withColumns(vals)
    totals = rows.groupBy(*by, "_blk").agg(*[F.sum(v).alias(v) for v in vals])
    earlier = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_blk").alias("_cblk"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_c{v}") for v in vals],
    )
    inside = Window.partitionBy(*by, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    cond = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_blk") == F.col("_cblk")]
    out = rows.join(carry, cond)
    out = out.withColumns(
        {name: F.col(f"_c{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in zip(sums, vals)}
    )
    return out.drop("_blk", "_cblk", *vals, *[f"_c{v}" for v in vals], *[f"_by_{c}" for c in by])


def blocks(df: DataFrame, label: str, by=None, seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``block_id``: 1 for the first run of equal labels, one more each time the label changes."""
    by = _keys(by)
    w = Window.partitionBy(*by, "_blk").orderBy(seq)
    prev = F.lag(F.struct(F.col(label).alias("l"))).over(w)
    rows = with_halo(df, 1, seq, block_rows).withColumn("_prev", prev)
    changed = F.col("_prev").isNull() | ~F.col("_prev.l").eqNullSafe(F.col(label))
    rows = rows.filter(~F.col("_halo")).withColumn("_new", changed.cast("long")).drop("_blk", "_halo", "_prev")
    return running_sums(rows, {"block_id": F.col("_new")}, by, seq, block_rows).drop("_new")


def attack_regions(df: DataFrame, label_idx: str, normal: int = 0, by=None, seq: str = "seq",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Maximal runs of one non-normal class: start, end (inclusive), rows, class."""
    by = _keys(by)
    runs = blocks(df.select(*by, seq, label_idx), label_idx, by, seq, block_rows)
    return (
        runs.filter(F.col(label_idx) != normal)
        .groupBy(*by, "block_id", label_idx)
        .agg(F.min(seq).alias("start_seq"), F.max(seq).alias("end_seq"), F.count(F.lit(1)).alias("n"))
        .select(*by, "start_seq", "end_seq", "n", F.col(label_idx).alias("class_idx"))
    )


def _sliding_mean(df, col, preceding, name, by, seq, block_rows):
    by = _keys(by)
    block_rows = max(block_rows, preceding)
    w = Window.partitionBy(*by, "_blk").orderBy(seq).rowsBetween(-preceding, 0)
    rows = with_halo(df, preceding, seq, block_rows).withColumn(name, F.avg(col).over(w))
    return rows.filter(~F.col("_halo")).drop("_blk", "_halo")


def moving_average(df: DataFrame, col: str, w: int = 5, name: str = "moving_average", by=None, seq: str = "seq",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the row and the ``w`` rows before it (w + 1 values)."""
    return _sliding_mean(df, col, w, name, by, seq, block_rows)


def rolling_mean(df: DataFrame, col: str, w: int = 50, name: str = "rolling_mean", by=None, seq: str = "seq",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``w`` rows including this one, from one row on; nulls are skipped."""
    return _sliding_mean(df, col, w - 1, name, by, seq, block_rows)


def slice_evenly(df: DataFrame, n: int, total: int, seq: str = "seq", name: str = "slice") -> DataFrame:
    """n + 1 consecutive slices of total // (n + 1) rows; the remainder goes to the last slice."""
    size = total // (n + 1)
    idx = F.lit(n) if size == 0 else F.least(F.floor(F.col(seq) / size), F.lit(n))
    if size == 0:
        # every slice but the last is empty
        return df.withColumn(name, F.lit(n).cast("int"))
    return df.withColumn(name, idx.cast("int"))


def interleave(base: DataFrame, attack_blocks: DataFrame, n_blocks: int, base_total: int, seq: str = "seq",
               block: str = "block") -> DataFrame:
    """Slice 0 of the base, block 0, slice 1, block 1, ...; the new dense order is ``position``.

    ``attack_blocks`` carries ``block`` (0-based) and ``seq`` (order inside the block).
    """
    slices = slice_evenly(base, n_blocks, base_total, seq, "_slice")
    left = slices.withColumn("_place", F.col("_slice") * 2).drop("_slice")
    right = attack_blocks.withColumn("_place", (F.col(block) * 2 + 1).cast("int"))
    both = left.unionByName(right, allowMissingColumns=True)
    return with_seq(both, ["_place", seq], name="position").drop("_place")
