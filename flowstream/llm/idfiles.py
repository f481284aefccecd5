"""Token ids as compressed blocks: an arithmetic coder driven by context-mixing predictions of order 0 to 2.

File format. A file holds segments, in order of the documents' ids. A segment holds whole documents: their ids and token
counts, and the token stream cut into blocks of ``BLOCK`` tokens. A block starts from reset models and carries its token
count and the CRC-32 of its tokens (little-endian 32-bit), then 32-bit words of code, so each block is decoded and
checked by itself; a wrong block is found and named. Spark writes segments as rows of Parquet files, whose commit
protocol makes lost executors harmless.

Coding of an id. The order-2 and order-1 models remember, for the (hashed) last two ids and the last id, which id came
next and how often it was right in a row; adaptive hit rates per such state turn that into the weights of both models'
predicted ids. What is left of the range is the order-0 model's: adaptive shares of the classes [2^b - 1, 2^(b+1) - 1) of
ids (a BPE vocabulary is sorted by rank, so classes are frequency bands), uniform within a class. All models adapt after
each id. The blocks of a segment advance in lockstep as lanes of numpy arrays.

Rules for odd input: null counts as empty; every document ends with the end id, so none is without tokens; null ids come
first; repeated rows stay, next to each other; an empty table writes an empty file. Only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from tokenizers import Tokenizer

from flowstream.llm.text import quoted, shuffle_partitions, text_or_empty
from flowstream.session import fresh_path

BLOCK = 2048  # tokens
SEGMENT = 1 << 22  # tokens after which a segment ends with the document
TOTAL_BITS = 28
SLOTS_BITS = 11
CLASSES = 16
MAX_ID = (1 << CLASSES) - 2
SHARE_BITS = 16
FLOOR = 1 << (SHARE_BITS - 6)  # least share of a class
RATE = 5
SCALE = 14  # the order-0 range is scaled by shares in 32 bits
HIT_BITS = 16
LEAST_REST = 1 << (TOTAL_BITS - 5)  # least range of the order-0 model
STATES = 8


class _Lanes:
    """The models of many blocks side by side. ``predict`` gives the ranges, ``learn`` adapts to the ids that came."""

    def __init__(self, lanes: int) -> None:
        self.n = lanes
        self.base = np.arange(lanes, dtype=np.int32) << SLOTS_BITS
        self.slots = [np.zeros(lanes << SLOTS_BITS, np.int32) for _ in range(2)]  # id | state << 16, by order
        self.row = np.arange(lanes, dtype=np.int32)
        self.hit_at = self.row * STATES
        self.hits = [np.full((lanes, STATES), 1 << (HIT_BITS - 1 - o), np.int32) for o in (1, 0)]
        for h in self.hits:
            h[:, 0] = 0  # nothing seen in this context
        self.shares = np.tile(np.arange(CLASSES + 1, dtype=np.int32) << (SHARE_BITS - 4), (lanes, 1))
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)

    def shrink(self, keep: int) -> None:
        """Only the first ``keep`` lanes go on."""
        self.n = keep
        for name in ("base", "last", "before", "row", "hit_at", "shares"):
            setattr(self, name, getattr(self, name)[:keep])
        self.hits = [h[:keep] for h in self.hits]

    def predict(self) -> None:
        one = self.last.astype(np.uint32) * np.uint32(0x9E3779B1)
        two = one ^ ((self.before.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B))
        top = np.uint32(32 - SLOTS_BITS)
        self.at = [self.base + (x >> top).view(np.int32) for x in (one, two * np.uint32(0xC2B2AE35))]
        slot = [t.take(a) for t, a in zip(self.slots, self.at)]
        self.guess = [s & 0xFFFF for s in slot]
        self.state = [s >> 16 for s in slot]
        self.hit_of = [self.hit_at + s for s in self.state]
        self.old = [h.take(i) for h, i in zip(self.hits, self.hit_of)]
        # what the order-2 model leaves goes to order 1 by its hit rate, but the order-0 model keeps its least part
        self.w2 = np.minimum(self.old[1] << (TOTAL_BITS - HIT_BITS), (1 << TOTAL_BITS) - LEAST_REST)
        self.w1 = ((((1 << TOTAL_BITS) - LEAST_REST - self.w2) >> (HIT_BITS - 1)) * (self.old[0] >> 1))
        self.rest = (1 << TOTAL_BITS) - self.w2 - self.w1
        self.scaled = self.rest >> SCALE

    def learn(self, ids: np.ndarray, kind: np.ndarray, plain: np.ndarray) -> None:
        """``kind`` is an id's class; ``plain`` says where the order-0 model coded it."""
        for o in (0, 1):
            state = self.state[o]
            right = (self.guess[o] == ids) & (state > 0)
            goal = np.where(right, (1 << HIT_BITS) - 64, 64)
            self.hits[o].reshape(-1)[self.hit_of[o]] = self.old[o] + ((goal - self.old[o]) >> RATE)
            self.hits[o][:, 0] = 0
            self.slots[o][self.at[o]] = ids | (np.where(right, np.minimum(state + 1, STATES - 1), 1) << 16)
        move = _TARGETS.take(kind, axis=0)
        move -= self.shares
        move >>= RATE
        move *= plain[:, None]
        self.shares += move
        self.before, self.last = self.last, ids


def _targets() -> np.ndarray:
    """Where the class borders move when a class came: every other class keeps FLOOR."""
    borders = np.arange(CLASSES + 1, dtype=np.int64)
    return np.stack([np.where(borders <= c, borders * FLOOR, (1 << SHARE_BITS) - (CLASSES - borders) * FLOOR) for c in range(CLASSES)]).astype(np.int32)


_TARGETS = _targets()


def _class_of(ids: np.ndarray) -> np.ndarray:
    return np.frexp((ids + 1).astype(np.float32))[1] - 1


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code of each block of ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    if not len(order) or not sizes[0]:
        return [b""] * len(blocks)
    if max(int(b.max(initial=0)) for b in blocks) > MAX_ID:
        raise ValueError("ids must be below 65,535")
    grid = np.zeros((int(sizes[0]), len(order)), np.int32)
    for k, i in enumerate(order):
        grid[:len(blocks[i]), k] = blocks[i]
    kinds = _class_of(grid)
    out = np.zeros((len(order), int(sizes[0]) + 2), np.uint32)
    wrote = np.zeros(len(order), np.int64)
    low, span = np.zeros(len(order), np.uint64), np.full(len(order), 0xFFFFFFFFFFFFFFFF, np.uint64)
    m, u32, mask = _Lanes(len(order)), np.uint64(32), np.uint64(0xFFFFFFFF)
    shift = np.uint64(TOTAL_BITS)
    all_rows = np.arange(len(order))
    for t in range(int(sizes[0])):
        alive = int(np.searchsorted(-sizes, -t, "left"))
        if alive < m.n:
            m.shrink(alive)
        ids, kind = grid[t, :alive], kinds[t, :alive]
        m.predict()
        by2 = (m.guess[1] == ids) & (m.w2 > 0)
        by1 = (m.guess[0] == ids) & (m.w1 > 0) & ~by2
        at = m.row * (CLASSES + 1) + kind
        shares = m.shares.reshape(-1)
        lo = (m.scaled * shares.take(at)) >> (SHARE_BITS - SCALE)
        each = (((m.scaled * shares.take(at + 1)) >> (SHARE_BITS - SCALE)) - lo) >> kind
        start = np.where(by2, 0, np.where(by1, m.w2, m.w2 + m.w1 + lo + (ids + 1 - (np.int32(1) << kind)) * each))
        width = np.where(by2, m.w2, np.where(by1, m.w1, each))
        a, r = low[:alive], span[:alive]
        r >>= shift
        a += r * start.astype(np.uint64)
        r *= width.astype(np.uint64)
        need = np.flatnonzero(r <= mask)
        if len(need):
            x, y = a[need], r[need]
            # a range across a word border is cut at the border, so no carry can reach a written word
            y = np.where((x >> u32) == ((x + y - np.uint64(1)) >> u32), y, (mask - (x & mask)) + np.uint64(1))
            out[need, wrote[need]] = (x >> u32).astype(np.uint32)
            wrote[need] += 1
            a[need] = x << u32
            r[need] = y << u32
        m.learn(ids, kind, ~(by2 | by1))
    for k in range(2):
        out[all_rows, wrote + k] = ((low >> (u32 if k == 0 else np.uint64(0))) & mask).astype(np.uint32)
    codes = [b""] * len(blocks)
    for k, i in enumerate(order):
        codes[i] = out[k, :wrote[k] + 2].astype("<u4").tobytes() if sizes[k] else b""
    return codes


def decode_blocks(codes: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Ids of each block, given how many it has."""
    order = sorted(range(len(codes)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order], np.int64)
    if not len(order) or not sizes[0]:
        return [np.zeros(0, np.int64)] * len(codes)
    words = np.zeros((len(order), max(len(c) for c in codes) // 4 + 2), np.uint64)
    for k, i in enumerate(order):
        w = np.frombuffer(codes[i], "<u4")
        words[k, :len(w)] = w
    u32, shift, mask = np.uint64(32), np.uint64(TOTAL_BITS), np.uint64(0xFFFFFFFF)
    code = (words[:, 0] << u32) | words[:, 1]
    read = np.full(len(order), 2, np.int64)
    grid = np.zeros((int(sizes[0]), len(order)), np.int32)
    low, span = np.zeros(len(order), np.uint64), np.full(len(order), 0xFFFFFFFFFFFFFFFF, np.uint64)
    m = _Lanes(len(order))
    for t in range(int(sizes[0])):
        alive = int(np.searchsorted(-sizes, -t, "left"))
        if alive < m.n:
            m.shrink(alive)
        m.predict()
        a, r, c = low[:alive], span[:alive], code[:alive]
        r >>= shift
        v = ((c - a) // r).astype(np.int32)
        guessed = m.w2 + m.w1
        by2, plain = v < m.w2, v >= guessed
        by1 = ~(by2 | plain)
        v0 = v - guessed
        borders = (m.scaled[:, None] * m.shares) >> (SHARE_BITS - SCALE)
        coded = np.minimum((v0[:, None] >= borders[:, 1:]).sum(1, dtype=np.int32), CLASSES - 1)
        at = m.row * (CLASSES + 1) + coded
        lo = borders.reshape(-1).take(at)
        each = np.maximum((borders.reshape(-1).take(at + 1) - lo) >> coded, 1)
        most = (np.int32(1) << coded) - 1
        step = np.minimum(np.maximum((v0 - lo) // each, 0), most)
        ids = np.where(by2, m.guess[1], np.where(by1, m.guess[0], most + step))
        start = np.where(by2, 0, np.where(by1, m.w2, guessed + lo + step * each))
        width = np.where(by2, m.w2, np.where(by1, m.w1, each))
        a += r * start.astype(np.uint64)
        r *= width.astype(np.uint64)
        need = np.flatnonzero(r <= mask)
        if len(need):
            x, y = a[need], r[need]
            y = np.where((x >> u32) == ((x + y - np.uint64(1)) >> u32), y, (mask - (x & mask)) + np.uint64(1))
            c[need] = (c[need] << u32) | words[need, np.minimum(read[need], words.shape[1] - 1)]
            read[need] += 1
            a[need] = x << u32
            r[need] = y << u32
        grid[t, :alive] = ids
        m.learn(ids, coded, plain)
    out = [np.zeros(0, np.int64)] * len(codes)
    for k, i in enumerate(order):
        out[i] = grid[:sizes[k], k].copy()
    return out


# ---- tokens

#: Texts with these are tokenised whole; all others word by word, as the tokenizer never looks across white space.
_WHOLE = re.compile("[\x1c-\x1f\x85]|<\\|")
_PLAIN = re.compile("[\x00-įı-ſ]*")  # no character here changes under NFC or lowers to several
_CACHE_WORDS = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, bytes]]:
    """A worker's tokenizer and its cache of words' ids."""
    return Tokenizer.from_file(path), {}


def token_ids(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """The tokenizer's ids of every text, and the end id. Equal words are tokenised once; the cache has a fixed size."""
    tok, known = _tokenizer(path)
    split = [None if _WHOLE.search(t) else (t.lower() if _PLAIN.fullmatch(t) else t).split() for t in texts]
    new = list({w for words in split if words for w in words if w not in known})
    if len(known) + len(new) > _CACHE_WORDS:
        known.clear()
        new = list({w for words in split if words for w in words})
    for at in range(0, len(new), 20_000):
        part = new[at:at + 20_000]
        for w, e in zip(part, tok.encode_batch(part, add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u2").tobytes()
    end = np.array([end_id], "<u2").tobytes()
    out = []
    for t, words in zip(texts, split):
        code = np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() if words is None else b"".join(map(known.__getitem__, words))
        out.append(np.frombuffer(code + end, "<u2"))
    return out


def write_ids(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None) -> str:
    """Write the token files in ascending id order and return their folder."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    parts = shuffle_partitions(spark)
    rows = rows.repartitionByRange(parts, "_id", F.xxhash64("_t")).sortWithinPartitions("_id", F.xxhash64("_t"))
    id_type = rows.schema["_id"].dataType

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            stream = np.concatenate(held)
            blocks = [stream[i:i + BLOCK] for i in range(0, len(stream), BLOCK)]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(stream)], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                pa.array([[len(b) for b in blocks]], pa.list_(pa.int32())), pa.array([[zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]], pa.list_(pa.int64())),
                pa.array([encode_blocks(blocks)], pa.list_(pa.binary()))], ["part", "segment", "n_tokens", "ids", "sizes", "counts", "crcs", "codes"])

        for batch in batches:
            key_type = batch.schema.field("_id").type
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                for key, ids in zip(piece.column("_id").to_pylist(), token_ids(piece.column("_t").to_pylist(), tokenizer_path, end_id)):
                    keys.append(key)
                    held.append(ids)
                    size += len(ids)
                    if size >= SEGMENT:
                        yield close()
                        keys, held, size, number = [], [], 0, number + 1
        if held:
            yield close()

    schema = StructType([*StructType.fromDDL("part int, segment int, n_tokens long").fields, StructField("ids", ArrayType(id_type)),
                         *StructType.fromDDL("sizes array<long>, counts array<int>, crcs array<long>, codes array<binary>").fields])
    path = path or fresh_path(spark, "token-files")
    rows.mapInArrow(segments, schema).write.option("compression", "uncompressed").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32 and, if asked for, token_ids."""
    files = spark.read.parquet(path)
    # where each segment begins: sums within a file's part, and over the parts before it
    sizes = files.select("part", "segment", "n_tokens")
    before = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    begin = inner.join(F.broadcast(before), "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("begin"))  # one row per partition is broadcast
    key_type = files.schema["ids"].dataType.elementType
    more = [StructField("token_ids", ArrayType(StructType.fromDDL("x int")[0].dataType))] if with_ids else []

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i].as_py()
                counts, crcs = get("counts"), get("crcs")
                blocks = decode_blocks(get("codes"), counts)
                for k, (ids, crc) in enumerate(zip(blocks, crcs)):
                    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                        raise ValueError(f"part {get('part')}, segment {get('segment')}, block {k}: the ids do not have the stored checksum")
                stream = np.concatenate(blocks).astype("<u4")
                sizes = np.array(get("sizes"), np.int64)
                ends = np.cumsum(sizes)
                view = memoryview(stream.tobytes())
                crc = [zlib.crc32(view[4 * (e - n):4 * e]) for n, e in zip(sizes.tolist(), ends.tolist())]
                ids_of = batch.column("ids").slice(i, 1).flatten()
                columns = [ids_of, pa.array([get("part")] * len(sizes), pa.int32()), pa.array([get("segment")] * len(sizes), pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["_id", "part", "segment", "_at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(stream.astype(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([StructField("_id", key_type), *StructType.fromDDL("part int, segment int, _at long, n_tokens long, ids_crc32 long").fields, *more])
    found = files.mapInArrow(documents, schema).join(begin, ["part", "segment"])
    return found.select(F.col("_id").alias(id_col), (F.col("begin") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *[f.name for f in more])
