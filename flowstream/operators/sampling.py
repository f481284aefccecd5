"""Exact-size random samples, stratified quotas, sequential slices and top-k.

A row's random rank is the md5 of (seed, row id), so a sample does not depend on partitioning.
To take the n lowest ranks, the 65,536 possible leading hash digits are counted per stratum,
the counts give each stratum a cut-off, and only rows up to the cut-off are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstream.functions.columns import clean_label, col, stratify_column
from flowstream.session import join_checked, written

SEED = 42  # fixed value: the seed of every sample


def random_rank(id_cols: Sequence[str], seed=SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in id_cols]))


def lowest_ranks(df: DataFrame, strata: Sequence[str], quota: DataFrame | int, id_cols: Sequence[str], seed=SEED) -> DataFrame:
    """Per stratum the ``_quota`` rows of lowest random rank. ``quota``: strata columns + ``_quota``, or a number
    when there are no strata."""
    keys = [col(s) for s in strata]
    rows = df.withColumn("_h", random_rank(id_cols, seed)).withColumn("_b", F.substring("_h", 1, 4))
    hist = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("_n").over(upto))
    hist = hist.join(quota, list(strata)) if strata else hist.withColumn("_quota", F.lit(quota))
    need = F.col("_quota") - F.col("_upto") + F.col("_n")
    # the first digits that reach the quota; if none does, the stratum is taken whole
    reached = F.when(F.col("_upto") >= F.col("_quota"), F.struct("_b", need.alias("need")))
    cuts = hist.groupBy(*keys).agg(F.min(reached).alias("_at"), F.max("_quota").alias("_quota")).filter("_quota > 0")
    cuts = cuts.select(*keys, F.col("_at._b").alias("_cut"), F.col("_at.need").alias("_need"))
    if strata:
        picked = join_checked(rows, cuts, list(strata))
    else:
        cut = cuts.first()
        if cut is None:
            return df.filter(F.lit(False))
        picked = rows.withColumns({"_cut": F.lit(cut["_cut"]).cast("string"), "_need": F.lit(cut["_need"]).cast("long")})
    picked = picked.filter(F.col("_cut").isNull() | (F.col("_b") <= F.col("_cut")))
    within = Window.partitionBy(*keys, "_b").orderBy("_h", *[col(c) for c in id_cols])
    picked = picked.withColumn("_r", F.row_number().over(within))
    keep = F.col("_cut").isNull() | (F.col("_b") < F.col("_cut")) | (F.col("_r") <= F.col("_need"))
    return picked.filter(keep).select(*[col(c) for c in df.columns])


def random_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed=SEED) -> DataFrame:
    """Exactly n rows (or all, if there are fewer)."""
    return lowest_ranks(df, [], n, id_cols, seed)


def class_counts(df: DataFrame, label: str = "Label", ignored: Sequence[str] = ()) -> DataFrame:
    rows = df.select(clean_label(col(label)).alias("label"))
    if ignored:
        rows = rows.filter(~F.col("label").isin([i.strip() for i in ignored]))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


class QuotaError(ValueError):
    """A class holds fewer rows than asked for."""


def check_class_quota(counts: DataFrame, n: int, allow_insufficient: bool = False) -> DataFrame:
    """Rows to take per class: min(n, available). A smaller class is an error unless allowed."""
    if not allow_insufficient:
        short = counts.filter(F.col("n") < n).orderBy("label").collect()
        if short:
            raise QuotaError(f"fewer than {n} rows in: " + ", ".join(f"{r['label']} ({r['n']})" for r in short))
    return counts.select("label", F.least(F.col("n"), F.lit(n)).cast("long").alias("_quota"))


def balanced_sample(df: DataFrame, n: int, id_cols: Sequence[str], label: str = "Label", ignored: Sequence[str] = (),
                    allow_insufficient: bool = False, seed=SEED) -> DataFrame:
    """min(n, available) random rows of every class, uniform over the whole table."""
    quota = check_class_quota(class_counts(df, label, ignored), n, allow_insufficient).withColumnRenamed("label", "_cls")
    return lowest_ranks(df.withColumn("_cls", clean_label(col(label))), ["_cls"], quota, id_cols, seed).drop("_cls")


def stratified_sample(df: DataFrame, n: int | None, id_cols: Sequence[str], key: str | None = None,
                      order_by: Sequence | None = None, seed=SEED) -> DataFrame:
    """n rows in the proportions of ``key`` (destination port, else protocol, else none).

    Each key gets its share of n rounded half to even; a shortage is topped up at random from
    the rows not yet chosen, an excess is cut at random. Null keys take part only in the top-up.
    """
    total = df.count() if n is not None else 0
    if n is None or n >= total:
        return df.orderBy(*order_by) if order_by else df
    key = key or stratify_column(df)
    if key is None:
        out = random_sample(df, n, id_cols, seed)
    else:
        sizes = df.filter(col(key).isNotNull()).groupBy(col(key)).agg(F.count(F.lit(1)).alias("_size"))
        share = F.bround(F.col("_size") / F.lit(float(total)) * F.lit(float(n)), 0).cast("long")
        quota = sizes.select(col(key), share.alias("_quota"))
        chosen = written(lowest_ranks(df, [key], quota, id_cols, seed), "sample")
        got = quota.agg(F.coalesce(F.sum("_quota"), F.lit(0))).first()[0]
        if got < n:
            rest = df.join(chosen.select(*[col(c) for c in id_cols]), list(id_cols), "left_anti")
            out = chosen.unionByName(random_sample(rest, n - got, id_cols, seed))
        elif got > n:
            out = random_sample(chosen, n, id_cols, f"{seed}-cut")
        else:
            out = chosen
    return out.orderBy(*order_by) if order_by else out


def _nth_position(rows: DataFrame, n: int, seq: str, block_rows: int) -> tuple[int | None, int]:
    """Position of the n-th row by ``seq`` and the number of rows up to it (all rows, if fewer than n).

    Blocks are counted first, then only the block that holds the n-th row is sorted.
    """
    per = rows.groupBy(F.expr(f"`{seq}` div {block_rows}").alias("_blk")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(seq).alias("_last"))
    w = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("_upto", F.sum("_n").over(w))
    hit = run.filter(F.col("_upto") >= n).orderBy("_blk").limit(1).collect()
    if not hit:
        end = run.agg(F.max("_last"), F.max("_upto")).first()
        return end[0], end[1] or 0
    b = hit[0]
    need = n - (b["_upto"] - b["_n"])
    inside = rows.filter(col(seq).between(b["_blk"] * block_rows, (b["_blk"] + 1) * block_rows - 1))
    return inside.select(seq).orderBy(seq).limit(need).agg(F.max(seq)).first()[0], n


def take_blocks(df: DataFrame, config: Sequence[tuple], source: str = "source_file", label: str = "Label",
                seq: str = "seq", block_rows: int = 65_536) -> tuple[DataFrame, list[int]]:
    """Consecutive slices per source: each item (source, n[, labels]) takes the first n remaining rows.

    Whatever the label sets, the rows taken of one label are always its first ones, so the whole
    state is the last position taken per label. The result is then a filter on positions, without
    any join. Returns the rows with ``block`` (dense over the non-empty items) and the block sizes.
    """
    state: dict[str, dict] = {}
    cond, sizes = None, []
    rows = df.withColumn("_lab", clean_label(col(label)))
    for item in config:
        src, n = item[0], item[1]
        labels = item[2] if len(item) > 2 else None
        labels = [labels] if isinstance(labels, str) else labels
        taken = state.setdefault(src, {"*": -1})  # "*": labels no filtered item has named
        known = [k for k in taken if k != "*"]
        last = F.lit(taken["*"])
        for k in known:
            last = F.when(F.col("_lab") == k, F.lit(taken[k])).otherwise(last)
        fits = (col(source) == src) & (col(seq) > last)
        if labels is not None:
            fits = fits & F.col("_lab").isin([x.strip() for x in labels])
        if n <= 0:
            continue
        end, got = _nth_position(rows.filter(fits).select(seq), n, seq, block_rows)
        if not got:
            continue
        mine = fits & (col(seq) <= end)
        cond = (cond.when(mine, len(sizes)) if cond is not None else F.when(mine, len(sizes)))
        sizes.append(int(got))
        for k in ([x.strip() for x in labels] if labels is not None else list(taken)):
            taken[k] = max(end, taken.get(k, taken["*"]))
    if cond is None:
        return rows.filter(F.lit(False)).withColumn("block", F.lit(0)).drop("_lab"), []
    return rows.withColumn("block", cond).filter(F.col("block").isNotNull()).drop("_lab"), sizes


def top_k(df: DataFrame, value: str, k: int, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """The k largest values, per group if ``by`` is given."""
    order = [F.col(value).desc(), *tie]
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
