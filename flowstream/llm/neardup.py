"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents with the same words in the same order are one text. Every text gets the set of its five-word n-grams and a
MinHash signature whose band and row counts are chosen for the target recall. Texts meet by the shuffled hashes of
their bands; the links of each bucket to its smallest text connect possible neighbours into groups, and in each group
all pairs are compared on their full n-gram sets, large groups in tiles of bounded size. Neither the buckets nor the
groups are ever expanded into pairs: tiles return counts of links per text and the edges of a spanning forest.

Rules for odd input: null counts as empty; words are runs of other than space, tab, newline, vertical tab, form feed and
return, taken as they are; all empty texts are one text; a text with fewer than five words is linked with no other
text; repeated rows belong to the same text. An empty table gives an empty result. Other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from flowstream.llm.skew import components, join_counted
from flowstream.llm.text import blocks, flat, mix, ngram_hashes, packed, quoted, shuffle_partitions, span_hashes, stored, text_or_empty, unpacked, word_spans

WORDS = 5
TILE = 512  # texts on each side of a tile
HASHES = 160


def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which a pair at the threshold still shares a band with probability
    ``recall``, using no more than ``hashes`` values."""
    for rows in range(hashes, 0, -1):
        bands = ceil(log(1 - recall) / log(1 - threshold ** rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no band count reaches the recall with so few hashes")


def text_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A 128-bit key of each row's word sequence, the word hashes, and each row's first word."""
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    keys = np.empty((len(offsets) - 1, 2), np.uint64)
    for k, salt in enumerate((0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D)):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ (place * np.uint64(salt))), out=total[1:])
        keys[:, k] = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    flat_keys = keys.tobytes()
    return [flat_keys[i:i + 16] for i in range(0, len(flat_keys), 16)], words, first


def _coefficients(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (n, 2), np.uint64).astype(np.uint32) | np.array([1, 0], np.uint32)


def band_hashes(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """(rows with n-grams) x bands: 64-bit hashes of the minima."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    scratch = np.empty_like(low)
    for k, (a, b) in enumerate(_coefficients(bands * rows, seed)):
        np.multiply(low, a, out=scratch)
        np.add(scratch, b, out=scratch)
        band = out[:, k // rows]
        band[:] = mix(band * np.uint64(5) + np.minimum.reduceat(scratch, starts).astype(np.uint64) + np.uint64(k + 1))
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, seed: int) -> DataFrame:
    """_id, _key and _bands of every row; texts without n-grams have no bands."""
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "_t"):
            keys, words, first = text_keys(raw, offsets)
            grams, at = ngram_hashes(words, first, WORDS)
            values = band_hashes(grams, at, bands, rows, seed).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.diff(at) > 0)]) * bands
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(keys, pa.binary()), lists], ["_id", "_key", "_bands"])

    rows_ = docs.select(quoted(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    return rows_.mapInArrow(sign, rows_.select("_id").schema.add("_key", "binary").add("_bands", ArrayType(LongType())))


def _with_keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The rows with their text's key in a new column ``key``."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text_keys(raw, offsets)[0], pa.binary())], [*part.schema.names, key])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(key, BinaryType())]))


def similar(sets: list[np.ndarray], threshold: float, left: int | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per set, and the edges of a spanning forest. Sets are sorted distinct hashes; with ``left``, only pairs
    of one of the first ``left`` sets with one of the others count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    run = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
    width = np.diff(run)
    of = np.empty(len(ids), np.int64)
    of[order] = np.repeat(np.arange(len(width)), width)  # which run each element of each set lies in
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links, root, forest = np.zeros(n, np.int64), list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n if left is None else left):
        runs = of[bounds[i]:bounds[i + 1]]
        w = width[runs]
        runs, w = runs[w > 1], w[w > 1]
        if not len(runs):
            continue
        at = np.arange(w.sum()) + np.repeat(run[runs] - np.concatenate([[0], np.cumsum(w)[:-1]]), w)
        shared = np.bincount(owner[at], minlength=n)
        shared[:i + 1 if left is None else left] = 0
        found = np.flatnonzero(shared >= threshold * (sizes[i] + sizes - shared) - 1e-9)
        found = found[shared[found] > 0]
        links[i] += len(found)
        links[found] += 1
        for j in found.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((i, j))
    return links, forest


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``key``, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = flat(batch.column(batch.schema.get_field_index(key)))
        values = raw.tobytes()
        keys = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            part = batch.slice(at, i - at)
            if held and held[0].column(key)[0].as_py() != keys[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            at = i
    if held:
        yield pa.Table.from_batches(held)


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """From rows (_comp, _key, _text, _n = texts in the group): (a, b, links): per text its links, as a loop a = b, and
    forest edges with 0 links."""
    sized = members.withColumn("_parts", F.ceil(F.col("_n") / TILE).cast("int")).withColumn("_own", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int"))
    tiles = sized.withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
    tiles = tiles.select(F.concat("_comp", F.expr("cast(concat(':', least(_own, _other), ':', greatest(_own, _other)) as binary)")).alias("_tile"),
                         (F.col("_own") < F.col("_other")).alias("_first"), (F.col("_own") == F.col("_other")).alias("_same"), "_key", "_text")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "_tile"):
            if group.num_rows < 2:
                continue
            rows = sorted(zip(group.column("_first").to_pylist(), group.column("_key").to_pylist(), group.column("_text").to_pylist()), key=lambda r: (not r[0], r[1]))
            raw, offsets = flat(pa.array([r[2] for r in rows], pa.large_string()))
            starts, ends, first = word_spans(raw, offsets)
            grams, at = ngram_hashes(span_hashes(raw, starts, ends), first, WORDS)
            sets = [np.unique(grams[at[i]:at[i + 1]]) for i in range(len(rows))]
            left = None if group.column("_same")[0].as_py() else sum(r[0] for r in rows)
            links, forest = similar(sets, threshold, left)
            keys = [r[1] for r in rows]
            some = np.flatnonzero(links).tolist()
            a = [keys[i] for i in some] + [keys[i] for i, _ in forest]
            b = [keys[i] for i in some] + [keys[j] for _, j in forest]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([int(links[i]) for i in some] + [0] * len(forest), pa.int64())], ["a", "b", "links"])

    # a tile that is not on the diagonal holds texts of both parts; on the diagonal only those of one
    parts = shuffle_partitions(members.sparkSession)
    return tiles.repartition(parts, "_tile").sortWithinPartitions("_tile").mapInArrow(compare, "a binary, b binary, links long")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.999, seed: int = 3) -> DataFrame:
    """One row per document: _id, _key (its text), _class (the connected class), class_id (its smallest id; classes can
    share one where ids are null or repeated), n_copies (rows with its text), n_links (other texts with similarity of
    ``threshold`` or more), n_class (rows of the class)."""
    bands, rows = choose_bands(threshold, recall)
    signed = stored(_signed(docs, id_col, text_col, bands, rows, seed), "signed")
    total = signed.count()
    texts = stored(signed.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"), F.first("_bands").alias("_bands")), "texts")
    banded = stored(texts.select("_key", F.posexplode("_bands").alias("_band", "_value")), "bands")
    buckets = stored(banded.groupBy("_band", "_value").agg(F.min("_key").alias("_low"), F.count("*").alias("_n")).where("_n > 1"), "buckets")
    star = join_counted(banded, buckets, ["_band", "_value"], "_n", total * bands).select(F.col("_key").alias("a"), F.col("_low").alias("b"))
    groups = stored(components(star, "possible").select(F.col("node").alias("_key"), F.col("root").alias("_comp")), "possible")
    sizes = stored(groups.groupBy("_comp").agg(F.count("*").alias("_n")), "possible-sizes")
    members = join_counted(groups, sizes, ["_comp"], "_n", total)
    # one document's text for each text that has a possible neighbour
    wanted = members.join(texts.select("_key", "_rep"), "_key")
    source = docs.select(quoted(id_col).alias("_rep"), text_or_empty(text_col).alias("_text"))
    fetched = _with_keys(source, "_text", "_found")
    same = (fetched["_rep"].eqNullSafe(wanted["_rep"])) & (fetched["_found"] == wanted["_key"])
    fetched = fetched.join(wanted, same).select("_comp", "_key", "_n", "_text").dropDuplicates(["_key"])
    found = stored(_links(fetched, threshold), "links")
    links = found.where("links > 0").groupBy(F.col("a").alias("_key")).agg(F.sum("links").alias("_links"))
    forest = found.where("a <> b").select("a", "b")
    roots = stored(components(forest, "classes").select(F.col("node").alias("_key"), F.col("root").alias("_class")), "classes")
    labelled = (texts.select("_key", "_rep", "_copies").join(links, "_key", "left").join(roots, "_key", "left")
                .withColumn("_class", F.coalesce("_class", "_key")))
    labelled = stored(labelled, "labelled")
    classes = stored(labelled.groupBy("_class").agg(F.min("_rep").alias("class_id"), F.sum("_copies").alias("n_class"), F.count("*").alias("_texts")), "class-ids")
    texts = stored(join_counted(labelled, classes, ["_class"], "_texts", total).select("_key", "_class", "class_id", F.col("_copies").alias("n_copies"), F.coalesce("_links", F.lit(0)).alias("n_links"), "n_class"), "text-classes")
    return join_counted(signed.select("_id", "_key"), texts, ["_key"], "n_copies", total)


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, class_id, n_links, n_copies, n_class."""
    found = near_classes(docs, id_col=id_col, **options)
    return found.select(F.col("_id").alias(id_col), "class_id", "n_links", "n_copies", "n_class")


def keep_one_of_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns kept, with one row of each class: one with the smallest id, null ids last."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key"))
    keepers = classes.groupBy("_class").agg(first.alias("_first"))
    keepers = stored(keepers.select(F.col("_first._id").alias("_keep"), F.col("_first._key").alias("_key")), "keepers")
    rows = _with_keys(docs.select(packed(docs.columns, "_row"), quoted(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), "_text", "_found").drop("_text")
    kept = rows.join(keepers, rows["_id"].eqNullSafe(keepers["_keep"]) & (rows["_found"] == keepers["_key"]), "left_semi")
    return kept.dropDuplicates(["_id", "_found"]).select(*unpacked(docs.columns, "_row"))
