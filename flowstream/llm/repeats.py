"""Repeated passages by enhanced suffix arrays: common-prefix interval trees over the suffixes at shared anchors.

Anchors. Of the ``SEED``-byte strings in any window of ``length`` bytes the one with the least hash is the window's anchor,
so equal windows have the same anchor at the same place. Anchors that occur once in the corpus cannot lie in a repeat;
only the contexts of the others (what may belong to a common window, left and right) are shuffled, by anchor.

Trees. The contexts of an anchor are sorted by the text from the anchor on (the suffix array) and a stack scan over the
common prefix lengths of neighbours gives all intervals of suffixes with a common prefix, the nodes of the interval tree.
Within a node the suffixes are ordered by what stands to their left: those whose left extensions agree long enough form
a repeat; where their left characters differ (the diversity test) it cannot be extended, and all its occurrences are
a maximal repeat group. The longest extensions of a suffix to both sides over all nodes say which bytes it covers.

Equal contexts are merged before the tree, so copies do not make it larger, and its depth is bounded by ``length``. An
anchor with over ``TREE`` different contexts is handled exactly by counting the hashes of all its windows instead.

Rules for odd input: texts are UTF-8 bytes, null counts as empty; matches never cross documents; a text shorter than
``length`` bytes is never touched; repeated rows are occurrences of each other; an empty table gives an empty result. Only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowstream.llm.neardup import _groups as grouped
from flowstream.llm.skew import join_counted
from flowstream.llm.text import blocks, quoted, shuffle_partitions, span_hashes, stored, text_or_empty

LENGTH = 400
SEED = 128
TREE = 20_000


def seed_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position that has them."""
    at = np.arange(max(len(raw) - size + 1, 0))
    return span_hashes(raw, at, at + size)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``raw`` of the anchors of all windows, sorted, and their hashes."""
    h = seed_hashes(raw, seed)
    width = length - seed + 1
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # hash in the upper bits, place in the lower: the least value is the leftmost least hash
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # least value of each window from running minima within stretches of the window's width
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(v)] = v
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    # windows that lie within a row
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    least = least[np.arange(n) + length <= ends]
    at = np.unique(least & low).astype(np.int64)
    return at, h[at]


def _common(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    limit = np.minimum(len_a, len_b)
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, limit)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), sizes


def interval_tree(prefixes: np.ndarray) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval, by a stack scan over the neighbours' common prefixes
    (``prefixes[i]`` belongs to suffixes i and i + 1)."""
    out, stack = [], []
    for i, p in enumerate([*prefixes.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > p:
            value, first = stack.pop()
            out.append((value, first, i))
        if p >= 0 and (not stack or stack[-1][0] < p):
            stack.append((p, first))
    return out


def repeat_tree(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, list[int]]]]:
    """For contexts of one anchor (``lefts`` end at it, ``rights`` begin with it, each occurs ``counts`` times): how far
    the repeats that each lies in reach to the left and right (0, 0: none), and the maximal groups as (bytes to the left,
    length, members)."""
    m, cap = len(rights), length - seed
    reach_left, reach_right = np.zeros(m, np.int64), np.zeros(m, np.int64)
    groups: list[tuple[int, int, list[int]]] = []
    for i in range(m):
        if counts[i] > 1 and len(lefts[i]) + len(rights[i]) >= length:
            reach_left[i], reach_right[i] = len(lefts[i]), len(rights[i])
            if m == 1 and len(lefts[i]) < cap:
                groups.append((len(lefts[i]), len(lefts[i]) + len(rights[i]), [i]))
    if m < 2:
        return reach_left, reach_right, groups
    order = np.array(sorted(range(m), key=rights.__getitem__))
    right, n_right = _matrix([rights[i] for i in order], length)
    left, n_left = _matrix([lefts[i][::-1] for i in order], cap)
    place = np.empty(m, np.int64)  # of each suffix in the order of its reversed left context
    place[sorted(range(m), key=lambda j: left[j, :n_left[j]].tobytes())] = np.arange(m)
    prefixes = _common(right[:-1], right[1:], n_right[:-1], n_right[1:])
    for reach, first, last in interval_tree(prefixes):
        if reach < seed:
            continue
        own = np.arange(first, last + 1)
        own = own[np.argsort(place[own])]
        shared = _common(left[own[:-1]], left[own[1:]], n_left[own[:-1]], n_left[own[1:]])
        best = np.maximum(np.append(shared, 0), np.insert(shared, 0, 0))
        ok = best + reach >= length
        who = order[own[ok]]
        reach_left[who] = np.maximum(reach_left[who], best[ok])
        reach_right[who] = np.maximum(reach_right[who], reach)
        # runs whose left extensions agree for long enough; diverse ones are maximal
        long = np.flatnonzero(shared + reach >= length)
        for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1) if len(long) else []:
            agree = int(shared[run].min())
            if agree < cap:
                groups.append((agree, agree + reach, [int(order[own[j]]) for j in range(run[0], run[-1] + 2)]))
    return reach_left, reach_right, groups


def _digest(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(left + bytes([0]) + right + len(left).to_bytes(4, "little"), digest_size=16).digest()


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _t and _k, which is equal only for rows that repeat id and text."""
    text = text_or_empty(text_col)
    return docs.select(quoted(id_col).alias("_id"), text.alias("_t"), F.xxhash64(F.lit(1), quoted(id_col).cast("string"), text).alias("_k"))


def _contexts(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(hash, digest, _k, pos, left, right) of the anchors listed in _at (position and hash) of each row."""
    cap = length - seed

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[], [], [], [], [], []]
                for key, text, places in zip(part.column("_k").to_pylist(), part.column("_t").to_pylist(), part.column("_at").to_pylist()):
                    data = text.encode()
                    for p in {p["pos"]: p for p in places}.values():
                        a = p["pos"]
                        left, right = data[max(0, a - cap):a], data[a:a + length]
                        for column, value in zip(out, (p["hash"], _digest(left, right), key, a, left, right)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())],
                                                 ["hash", "digest", "_k", "pos", "left", "right"])

    return rows.select("_k", "_t", "_at").mapInArrow(cut, "hash long, digest binary, _k long, pos int, left binary, right binary")


def _tree_reach(distinct: DataFrame, length: int, seed: int) -> DataFrame:
    """(hash, digest, reach_left, reach_right) of the contexts that lie in a repeat, one tree per anchor."""
    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "_key"):
            lefts, rights, counts = (group.column(c).to_pylist() for c in ("left", "right", "n"))
            reach_left, reach_right, _ = repeat_tree(lefts, rights, counts, length, seed)
            some = np.flatnonzero(reach_right)
            if len(some):
                own = group.select(["hash", "digest"]).take(pa.array(some)).combine_chunks()
                yield pa.RecordBatch.from_arrays([own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.array(reach_left[some]), pa.array(reach_right[some])], ["hash", "digest", "reach_left", "reach_right"])

    keyed = distinct.withColumn("_key", F.col("hash").cast("string").cast("binary"))
    parts = shuffle_partitions(distinct.sparkSession)
    return keyed.repartition(parts, "_key").sortWithinPartitions("_key").mapInArrow(trees, "hash long, digest binary, reach_left long, reach_right long")


def _window_reach(distinct: DataFrame, length: int, seed: int) -> DataFrame:
    """The same by counting all windows: for anchors with more contexts than one tree should hold."""
    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].as_py(), batch.column("right")[i].as_py()
                raw = np.frombuffer(left + right, np.uint8)
                if len(raw) < length:
                    continue
                # each window counts at its own anchor only, so no occurrence counts twice
                places = np.lib.stride_tricks.sliding_window_view(seed_hashes(raw, seed), length - seed + 1).argmin(1)
                at = np.arange(len(places))
                at = at[at + places == len(left)]
                grams = seed_hashes(raw, length).view(np.int64)[at]
                n = len(at)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("hash")[i].as_py()] * n, pa.int64()), pa.array([batch.column("digest")[i].as_py()] * n, pa.binary()), pa.array([batch.column("n")[i].as_py()] * n, pa.int64()),
                                                      pa.array(grams), pa.array(np.maximum(len(left) - at, 0)), pa.array(at + length - len(left))], ["hash", "digest", "n", "gram", "to_left", "to_right"])

    rows = distinct.mapInArrow(windows, "hash long, digest binary, n long, gram long, to_left long, to_right long")
    rows = stored(rows, "windows")
    often = stored(rows.groupBy("gram").agg(F.sum("n").alias("_often"), F.count("*").alias("_rows")).where("_often > 1"), "window-counts")
    return join_counted(rows, often, ["gram"], "_rows", rows.count()).groupBy("hash", "digest").agg(F.max("to_left").alias("reach_left"), F.max("to_right").alias("reach_right"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, tree: int = TREE) -> DataFrame:
    """(_k, spans) of the rows with repeats: byte ranges [a, b) that repeats cover, possibly overlapping. Rows that
    repeat id and text share one _k."""
    marked = _marked(docs, id_col, text_col)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "_t"):
            at, h = anchors(raw, offsets, length, seed)
            row = np.searchsorted(offsets, at, "right") - 1
            keys = np.asarray(part.column("_k"))
            yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array((at - offsets[row]).astype(np.int32)), pa.array(h.view(np.int64))], ["_k", "pos", "hash"])

    found = stored(marked.select("_k", "_t").mapInArrow(find, "_k long, pos int, hash long"), "anchors")
    total = found.count()
    often = stored(found.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1"), "anchor-counts")
    # at most as many places per document as it has anchors
    listed = join_counted(found, often, ["hash"], "_n", total).groupBy("_k").agg(F.collect_list(F.struct("pos", "hash")).alias("_at"))
    contexts = stored(_contexts(marked.join(listed, "_k"), length, seed), "contexts")
    distinct = contexts.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    sizes = stored(contexts.select("hash", "digest").distinct().groupBy("hash").agg(F.count("*").alias("_m")).where(F.col("_m") > tree), "large-anchors", 1)
    if sizes.isEmpty():
        reach = _tree_reach(distinct, length, seed)
    else:
        # total contexts / tree rows at most
        large = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
        reach = _tree_reach(distinct.join(large, "hash", "left_anti"), length, seed).unionByName(_window_reach(distinct.join(large, "hash", "left_semi"), length, seed))
    reach = stored(reach, "reach")
    places = contexts.select("hash", "digest", "_k", "pos")
    many = stored(places.groupBy("hash", "digest").agg(F.count("*").alias("_often")).join(reach, ["hash", "digest"]), "reach-counts")
    covered = join_counted(places, many, ["hash", "digest"], "_often", total)
    return covered.groupBy("_k").agg(F.collect_set(F.struct((F.col("pos") - F.col("reach_left")).alias("a"), (F.col("pos") + F.col("reach_right")).alias("b"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, **options) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left)."""
    marked = _marked(docs, id_col, text_col)
    spans = stored(repeated_spans(docs, id_col=id_col, text_col=text_col, length=length, **options), "repeat-spans")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kept, removed, n_spans, n_bytes = [], [], [], []
                for text, found in zip(part.column("_t").to_pylist(), part.column("spans").to_pylist()):
                    data = text.encode()
                    runs = merged([(s["a"], s["b"]) for s in found or ()])
                    edges = [0, *[x for run in runs for x in run], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    n_bytes.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                    n_spans.append(len(runs))
                columns = [part.column("_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_text else [])], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    key = docs.select(quoted(id_col).alias(id_col)).schema[0]
    schema = StructType([key, *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")).fields])
    return marked.join(spans, "_k", "left").select("_id", "_t", "spans").mapInArrow(cut, schema)
