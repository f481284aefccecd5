"""Mixing sources to target weights with a splitting tree over output shards.

Every source is a random permutation of its documents, by hash, cut into blocks. Its target in words sets how many whole
epochs and how many more blocks of the permutation are drawn (the last block in part): its quota of blocks. Behind a
document that is larger than what is missing the drawing goes on along the permutation with those that fit, until what is
missing is smaller than each document left. A binary tree over the output shards then splits the quotas exactly: each node draws from a
multivariate hypergeometric law how many of its blocks, by source, go to its left half. Disjoint stretches of the
permuted blocks are dealt to the shards by these counts, and each shard is shuffled by a hash of its rows.

A document's epochs, blocks and shards follow from its hash and one small row per source, so no document moves before
the final shuffle. Reruns agree: all hashes depend on contents and the seed, not on partitions or order.

Rules for odd input: a null text has 0 words; null is a source of its own and the last; repeated rows share a hash and
are drawn alike; a source without words has the target 0 and is not drawn; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowstream.llm.text import free_name, packed, quoted, stored, text_or_empty, unpacked

WORD = r"[^\x20\x09-\x0D]+"
MAX_BLOCKS = 1 << 20  # of all sources together, besides one for each source
HASH_BITS = 31
SMALL = 50_000  # sources up to which their rows (a few hundred bytes each) are broadcast


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def _source_key(source_col: str) -> Column:
    """Sources in code point order, null last."""
    return F.when(quoted(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), quoted(source_col).cast("string")))


def _permuted(id_col: str, text_col: str, seed: int) -> Column:
    """63 random bits of the document; their order is the permutation."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), quoted(id_col).cast("string"), text_or_empty(text_col)), 1)


def _block(u: str, blocks: str) -> Column:
    return F.shiftright(F.shiftrightunsigned(F.col(u), 63 - HASH_BITS) * F.col(blocks), HASH_BITS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """``sizes`` (_s, _words, ...) with _target: weights repeat over the sorted sources and share all words; no target goes
    above ``max_epochs`` times its source, the excess goes to the others by weight."""
    everything = Window.orderBy("_s")  # rows are sources
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("_words") * F.lit(float(max_epochs)))
    # sources reach their cap in the order of cap / weight: the level is set by the first that does not
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (F.sum("_words").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_s", "_level"))).over(whole)
    rows = rows.withColumn("_first", first)
    return rows.withColumn("_target", F.least(F.coalesce(F.col("_first._level") * F.col("_w"), F.col("_cap")), F.col("_cap"))).drop("_level", "_cap", "_first")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): every node of the tree hands its left half an exact share of its blocks, drawn
    without replacement. Shard totals differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(counts: np.ndarray, lo: int, hi: int, first: int, last: int) -> None:
        """Blocks ``counts`` in all for shards lo to hi, whose blocks are numbered first to last over the whole mix."""
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        cut = total * mid // shards
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, cut - first, method="marginals") if counts.sum() else counts
        down(left, lo, mid, first, cut)
        down(counts - left, mid, hi, cut, last)

    total = int(quotas.sum())
    down(np.asarray(quotas, np.int64), 0, shards, 0, total)
    return out


def _prefix(placed: DataFrame, state: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each source of ``state`` (_s, _from, _gap, _least) the longest run of documents behind _from, without those
    larger than _gap or smaller than _least, that holds _gap words at most: its end _to and its words _took. Sources with
    no such document are left out."""
    fits = placed.join(hint(state), "_s").where("_u > _from and _size >= _least and _sum <= _gap")
    blocks = fits.groupBy("_s", "_b", "_gap").agg(F.sum("_sum").alias("_words"), F.max("_u").alias("_last"))
    run = Window.partitionBy("_s").orderBy("_b")  # a million blocks at most
    ends = stored(blocks.withColumn("_end", F.sum("_words").over(run)), "ends")
    whole = ends.where("_end <= _gap").groupBy("_s").agg(F.max("_last").alias("_last"), F.max("_end").alias("_end"))
    cut = ends.where("_end > _gap").groupBy("_s").agg(F.min(F.struct("_b", (F.col("_end") - F.col("_words")).alias("_before"))).alias("_c")).select("_s", "_c.*")
    order = Window.partitionBy("_s").orderBy("_u")  # the documents of one block
    part = fits.join(hint(cut), ["_s", "_b"]).withColumn("_at", F.sum("_sum").over(order) + F.col("_before")).where("_at <= _gap")
    part = part.groupBy("_s").agg(F.max("_u").alias("_cut"), F.max("_at").alias("_at"))
    out = state.join(whole, "_s", "left").join(part, "_s", "left").withColumns({"_to": F.coalesce("_cut", "_last"), "_took": F.coalesce("_at", "_end")})
    return out.where("_to is not null").select("_s", "_from", "_to", "_least", "_gap", "_took")


def _in_steps(size: str) -> Column:
    """Whether the document's _u and size lie in one of its source's _steps."""
    return F.expr(f"exists(_steps, x -> _u > x._from and _u <= x._to and {size} between x._least and x._gap) and not array_contains(coalesce(_apart, array()), _u)")


def mixing_table(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, shards: int = 64, id_col: str = "doc_id",
                 text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """One row per source: _s, _words, _target, _blocks, _epochs, the draw of the last epoch (_steps, _apart, _extra_u; its
    first run of documents ends in _cut_block) and _ends, the unit numbers at which the shards' stretches end. Unit
    e x _blocks + b is block b in epoch e; documents that fill up behind _cut_block are dealt round the blocks before."""
    rows = stored(docs.select(_source_key(source_col).alias("_s"), word_count(text_col).alias("_size"), _permuted(id_col, text_col, seed).alias("_u")), "sizes")
    total = rows.count()
    per_block = max(8, -(-total // MAX_BLOCKS))
    sizes = rows.groupBy("_s").agg(F.sum("_size").alias("_words"), F.count("*").alias("_n"))
    goals = source_targets(sizes, weights, max_epochs).withColumn("_blocks", F.ceil(F.col("_n") / per_block).cast("long"))
    goals = goals.withColumn("_epochs", F.when(F.col("_words") > 0, F.least(F.floor(F.col("_target") / F.col("_words")), F.lit(max_epochs))).otherwise(0).cast("long"))
    goals = stored(goals.withColumn("_rest", F.when(F.col("_epochs") < max_epochs, F.greatest(F.col("_target") - F.col("_epochs") * F.col("_words"), F.lit(0.0))).otherwise(0.0)), "goals", 1)

    few = goals.count() <= SMALL
    hint = F.broadcast if few else lambda small: small
    placed = rows.join(hint(goals.select("_s", "_blocks", "_rest")), "_s").where("_rest > 0").withColumn("_b", _block("_u", "_blocks"))
    placed = stored(placed.groupBy("_s", "_b", "_u").agg(F.sum("_size").alias("_sum"), F.max("_size").alias("_size"), F.count("*").alias("_rows")), "placed")
    state = goals.where("_rest > 0").select("_s", F.lit(-1).cast("long").alias("_from"), F.col("_rest").alias("_gap"), F.lit(0).cast("long").alias("_least"))
    rounds = []
    while True:
        step = stored(_prefix(placed, state, hint), "step", 1)
        if step.isEmpty():
            break
        rounds.append(step)
        # documents without words fill nothing
        state = step.select("_s", F.col("_to").alias("_from"), (F.col("_gap") - F.col("_took")).alias("_gap"), F.lit(1).cast("long").alias("_least"))
    columns = ["_from", "_to", "_least", "_gap"]
    none = goals.limit(0).select("_s", *[F.lit(0).cast("double" if c == "_gap" else "long").alias(c) for c in [*columns, "_took"]])
    steps = stored(reduce(DataFrame.unionByName, rounds, none), "steps", 1)
    # repeated rows that fit alone but not together are left out by name, as a row does not know how often it is there
    apart = placed.where("_rows > 1").join(hint(steps), "_s").where("_u > _from and _u <= _to and _size between _least and _gap and _sum > _gap")
    apart = apart.groupBy("_s").agg(F.collect_list("_u").alias("_apart"))
    drawn = steps.groupBy("_s").agg(F.collect_list(F.struct(*columns)).alias("_steps"), F.sum("_took").alias("_took"), F.min(F.struct("_from", "_to"))["_to"].alias("_cut_u")).join(apart, "_s", "left")
    drawn = stored(drawn, "drawn", 1)
    # what is missing now is met best by nothing or by the smallest document left
    left = placed.join(hint(drawn), "_s", "left").where(~F.coalesce(_in_steps("_size"), F.lit(False))).join(hint(goals.select("_s", F.col("_rest").alias("_goal"))), "_s")
    left = left.withColumn("_miss", F.col("_goal") - F.coalesce("_took", F.lit(0))).where("abs(_sum - _miss) < _miss")
    extra = left.groupBy("_s").agg(F.min_by("_u", F.struct(F.abs(F.col("_sum") - F.col("_miss")), "_u")).alias("_extra_u"))
    goals = goals.join(drawn.drop("_took"), "_s", "left").join(extra, "_s", "left")
    goals = goals.withColumn("_cut_block", F.when(F.col("_rest") > 0, F.coalesce(_block("_cut_u", "_blocks"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    goals = goals.withColumn("_extra_u", F.coalesce("_extra_u", F.lit(-1).cast("long")))
    goals = goals.withColumn("_quota", F.col("_epochs") * F.col("_blocks") + F.least(F.col("_cut_block") + (F.col("_rest") > 0).cast("long"), F.col("_blocks")))

    def tree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task: eight bytes per source and shard."""
        found = sorted((r["_s"], r["_quota"]) for b in batches for r in b.to_pylist())
        if found:
            counts = split_quotas(np.array([q for _, q in found], np.int64), shards, seed)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found]), pa.array(list(np.cumsum(counts, axis=0).T), pa.list_(pa.int64()))], ["_s", "_ends"])

    stretches = goals.select("_s", "_quota").repartition(1).mapInArrow(tree, "_s string, _ends array<long>")
    return stored(goals.join(stretches, "_s"), "mix", 1)


def _drawn(docs: DataFrame, mix: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with the columns of its source in ``mix`` and _shards: the shard of each copy, in order of epochs."""
    rows = docs.withColumn("_s", _source_key(source_col)).withColumn("_u", _permuted(id_col, text_col, seed))
    joined = rows.join(F.broadcast(mix) if mix.count() <= SMALL else mix, "_s").withColumn("_b", _block("_u", "_blocks"))
    more = (F.col("_rest") > 0) & (F.coalesce(_in_steps("_words_in"), F.lit(False)) | (F.col("_u") == F.col("_extra_u")))
    joined = joined.withColumn("_words_in", word_count(text_col)).withColumn("_copies", F.col("_epochs") + F.when(more, 1).otherwise(0))
    unit = "e * _blocks + if(e < _epochs, _b, _b % (_cut_block + 1))"
    shard = f"transform(slice(sequence(0L, _epochs + 1), 1, cast(_copies as int)), e -> least(size(filter(_ends, x -> x <= {unit})), size(_ends) - 1))"
    return joined.withColumn("_shards", F.expr(shard))


def mixing_report(docs: DataFrame, mix: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, shards."""
    narrow = docs.select(quoted(id_col).alias(id_col), text_or_empty(text_col).alias("text"), quoted(source_col).alias("_source"))
    rows = _drawn(narrow, mix, id_col, "text", "_source", seed).withColumn("size", F.col("_words_in"))
    return rows.select(id_col, "size", F.col("_words").alias("source_size"), F.col("_target").alias("target"),
                       (F.col("size") * F.col("_copies")).alias("taken"), F.col("_shards").alias("shards"))


def mixed(docs: DataFrame, mix: DataFrame, *, shards: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The mix itself: a row for each copy, with the columns of ``docs``, shard by shard and shuffled within each."""
    row = free_name(docs.columns, "_doc")
    held = docs.select(packed(docs.columns, row), quoted(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), quoted(source_col).alias("_source"))
    copies = _drawn(held, mix, "_id", "_text", "_source", seed).select(row, "_u", F.posexplode("_shards").alias("_epoch", "_shard"))
    dealt = copies.withColumn("_at", F.xxhash64(F.lit(seed + 1), "_u", "_epoch")).repartitionByRange(shards, "_shard", "_at")
    return dealt.sortWithinPartitions("_shard", "_at").select(*unpacked(docs.columns, row))
