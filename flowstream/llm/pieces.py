"""SentencePiece encoding and decoding over a relational lattice of pieces.

Texts fall into units that no piece can cross: they are cut between two characters that stand side by side in no piece, so
before each run of word marks, around a character that is in no longer piece, and mostly between letters, digits and
signs. Each distinct unit is encoded once: its substrings are exploded and joined with the piece table (some
ten thousand rows, broadcast), by up to four characters and then in full, the matching edges are grouped by unit, and a fold over the
edges with Spark's higher-order functions picks the path. For a unigram model the fold is Viterbi over edge scores. A BPE
model's scores are merge ranks, and the best path by their sum is not what its tokenizer produces; there the fold applies
the edges in rank order, each where it spans exactly two segments, which gives the tokenizer's own ids.

Encoded units meet the texts by chunk, the part of an input file that one task reads: a task sends each of its units
once, however often it occurs, and gets the ids back. Units travel in sorted lists, one for each chunk and lane
(a share of all units by their hash), which take a fraction of the space of single rows; the ids travel back in the same order without them, the
last of each unit as a negative number. Decoding joins the pieces of the ids, bytes included.

Rules for odd input: null counts as empty, an empty text has no ids; characters without a piece become bytes; text that
holds the word mark itself decodes to spaces there, as in the tokenizer, and reports round_trip false; repeated rows are
encoded alike; an empty table gives an empty result. Only the columns asked for are read. A run of letters without a space, be it of any
length, is cut wherever no piece crosses; what can't be cut, as a run of one letter, takes time with the square of its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from flowstream.llm.text import blocks, quoted, shuffle_partitions, text_or_empty

MARK = "▁"
CHUNK = 8 << 20  # bytes of an input file that share one dictionary of units
LONG = 256  # characters of a unit that is looked at for places to cut
KEY = 4  # characters of a piece that it is joined by
TABLE_LETTERS = 4096  # up to so many different letters in pieces, the pairs that stand in pieces are tabulated
GAP = " "  # between the units of a list; no unit holds it, as texts have marks in its place


@dataclass(frozen=True)
class PieceModel:
    """Pieces, scores and ids as the fold needs them; ``kind`` is "bpe" or "unigram"."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    first_byte: int
    kind: str

    @property
    def longest(self) -> int:
        return max((len(p) for p, n in zip(self.pieces, self.normal) if n), default=1)

    def splitter(self) -> Callable[[str], list[str]]:
        """Splits a marked text into its units: it is cut between characters that stand side by side in no piece. Units over
        LONG characters are cut wherever no piece crosses."""
        longest = self.longest
        long = {p for p, n in zip(self.pieces, self.normal) if n and len(p) > 1}
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("a piece has a word mark behind a letter: words are no units of this model")
        pairs = {pair for p in long for pair in pairwise(p)}
        letters = sorted({c for pair in pairs for c in pair})
        width = len(letters) + 1
        number = np.zeros(0x110000, np.int32 if width <= TABLE_LETTERS else np.int64)
        number[list(map(ord, letters))] = np.arange(1, width)
        known = np.array([int(number[ord(a)]) * width + int(number[ord(b)]) for a, b in pairs], np.int64)
        if width <= TABLE_LETTERS:
            table = np.ones(width * width, bool)
            table[known] = False
            apart = table.take
        else:
            apart = lambda x: ~np.isin(x, known)

        def cut(unit: str) -> Iterator[str]:
            start = reach = 0
            for i in range(len(unit)):
                if i and reach <= i:
                    yield unit[start:i]
                    start = i
                reach = max(reach, i + next((k for k in range(min(longest, len(unit) - i), 1, -1) if unit[i:i + k] in long), 1))
            yield unit[start:]

        def split(text: str) -> list[str]:
            if not text:
                return []
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            k = number.take(codes)
            pair = k[:-1] * width
            pair += k[1:]
            ends = np.flatnonzero(apart(pair))
            spaced, own = np.full(len(codes) + len(ends), ord(GAP), np.uint32), np.ones(len(codes) + len(ends), bool)
            own[ends + np.arange(1, len(ends) + 1)] = False
            spaced[own] = codes
            units = spaced.tobytes().decode("utf-32-le").split(GAP)
            if len(text) > LONG and np.diff(ends, prepend=-1, append=len(text) - 1).max() > LONG:
                return [x for u in units for x in (cut(u) if len(u) > LONG else (u,))]
            return units

        return split

    def as_bytes(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        out = [p.replace(MARK, " ").encode() if n else b"" for p, n in zip(self.pieces, self.normal)]
        out[self.first_byte:self.first_byte + 256] = [bytes([b]) for b in range(256)]
        return out


def load_pieces(path: str, kind: str = "bpe") -> PieceModel:
    """The piece table of a model file without text normalisation, with byte pieces and a mark in front of each text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = tuple(sp.id_to_piece(i) for i in ids)
    byte_ids = [i for i in ids if sp.is_byte(i)]
    if [pieces[i] for i in byte_ids] != [f"<0x{b:02X}>" for b in range(256)] or byte_ids != list(range(byte_ids[0], byte_ids[0] + 256)):
        raise ValueError("the model has no byte pieces in a row")
    probe = "ﬁ  Ａ ́"
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model normalises its texts")
    normal = tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids)
    return PieceModel(pieces, tuple(sp.get_score(i) for i in ids), normal, byte_ids[0], kind)


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    rows = [(p[:KEY], p, len(p), i, float(s)) for i, (p, s, n) in enumerate(zip(model.pieces, model.scores, model.normal)) if n]
    return spark.createDataFrame([("", "", 0, -1, 0.0), *rows], "key string, piece string, l int, id int, score double")


#: Byte i of a state says whether a segment starts at character i ('1') or not ('0').
_ONES = "length(replace(cast(substring(s, e.i + 1, e.l + 1) as string), '0', ''))"
_ENDS = "substring(s, e.i + 1, 1) = x'31' and substring(s, e.i + e.l + 1, 1) = x'31'"
_MERGE = f"""aggregate(filter(edges, e -> e.l > 1), cast(repeat('1', n + 1) as binary), (s, e) ->
    if({_ENDS} and {_ONES} = 3, concat(substring(s, 1, e.i + 1), cast(repeat('0', e.l - 1) as binary), substring(s, e.i + e.l + 1, 2147483647)), s))"""
_BYTES = "transform(sequence(1, octet_length(substring(unit, p + 1, 1))), k -> cast(conv(hex(substring(encode(substring(unit, p + 1, 1), 'UTF-8'), k, 1)), 16, 10) as int) + {first})"
_SEGMENTS = f"""array_sort(concat(
    transform(filter(edges, e -> e.l > 0 and {_ENDS} and {_ONES} = 2), e -> struct(e.i as i, array(e.id) as ids)),
    transform(array_except(filter(sequence(0, n - 1), p -> substring(s, p + 1, 2) = x'3131'), transform(filter(edges, e -> e.l = 1), e -> e.i)), p -> struct(p as i, {_BYTES} as ids))))"""
#: best[j]: score of the best path to character j, the length and the id (-1: bytes) of its last edge.
_BEST = """aggregate(sequence(1, n), array(struct(cast(0 as double) as score, 0 as l, -1 as id)), (best, j) -> concat(best, array(array_max(concat(
    transform(filter(edges, e -> e.l > 0 and e.i + e.l = j), e -> struct(best[e.i].score + e.score as score, e.l as l, e.id as id)),
    if(exists(edges, e -> e.l = 1 and e.i = j - 1), cast(array() as array<struct<score: double, l: int, id: int>>), array(struct(best[j - 1].score + {unknown} as score, 1 as l, -1 as id))))))))"""
_BACK = f"""aggregate(sequence(1, n), struct(n as at, cast(array() as array<int>) as ids), (a, x) -> if(a.at = 0, a, struct(a.at - best[a.at].l as at,
    concat(if(best[a.at].id >= 0, array(best[a.at].id), element_at(transform(array(a.at - 1), p -> {_BYTES}), 1)), a.ids) as ids))).ids"""


def encode_units(units: DataFrame, model: PieceModel, by: Sequence[str] = ()) -> DataFrame:
    """(unit, ids, ...) for rows of distinct, non-empty marked strings in column unit; further columns stay. Rows that are
    partitioned by columns ``by``, which depend on the unit alone, are not shuffled."""
    carried = [c for c in units.columns if c not in ("unit", *by)]
    starts = units.select("unit", *by, *carried, F.explode(F.expr("sequence(0, length(unit) - 1)")).alias("i"))
    # Substrings of up to KEY characters are joined; those of KEY characters meet all pieces that begin so, which are then compared
    # in full. The empty piece matches once per unit, so a unit without any piece stays; its row alone carries the further columns.
    spans = starts.select("*", F.explode(F.expr(f"sequence(if(i = 0, 0, 1), least({KEY}, length(unit) - i))")).alias("k"))
    spans = spans.withColumns({c: F.when(F.col("k") == 0, quoted(c)) for c in carried}).withColumn("key", F.expr("substring(unit, i + 1, k)")).drop("k")
    # a whole number as key makes probing several times faster than text
    table = piece_table(units.sparkSession, model).withColumn("key", F.xxhash64("key"))
    edges = spans.withColumn("key", F.xxhash64("key")).join(F.broadcast(table), "key").where("substring(unit, i + 1, l) = piece").drop("key")
    edge = F.expr("struct(-score as rank, i, l, id)" if model.kind == "bpe" else "struct(i, l, id, score)")
    grouped = edges.groupBy("unit", *by).agg(F.collect_list(edge).alias("edges"), *[F.first(quoted(c), ignorenulls=True).alias(c) for c in carried])
    grouped = grouped.withColumn("edges", F.array_sort("edges")).withColumn("n", F.length("unit"))
    if model.kind == "bpe":
        done = grouped.withColumn("s", F.expr(_MERGE)).withColumn("ids", F.expr(f"flatten(transform({_SEGMENTS.format(first=model.first_byte)}, x -> x.ids))"))
    else:
        worst = min(s for s, n in zip(model.scores, model.normal) if n) - 10
        done = grouped.withColumn("best", F.expr(_BEST.format(unknown=f"cast({worst!r} as double)"))).withColumn("ids", F.expr(_BACK.format(first=model.first_byte)))
    return done.select("unit", *by, "ids", *carried)


def _chunk(df: DataFrame, id_col: str):
    """A number for the part of the input file a row comes from; rows that come from no file are dealt by their id."""
    spark = df.sparkSession
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = F.when(F.input_file_name() == "", F.lit(4 * shuffle_partitions(spark))).otherwise(F.lit(max(1, -(-size // CHUNK))))
    return F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64(quoted(id_col).cast("string")), parts)), F.lit((1 << 31) - 1)).cast("int")


def encode(docs: DataFrame, model: PieceModel, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: its id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip
    (whether the ids decode to the text) and, if asked for, ids."""
    rows = docs.select(quoted(id_col).alias("_id"), _chunk(docs, id_col).alias("_chunk"), text_or_empty(text_col).alias("_t"))
    id_type = rows.schema["_id"].dataType
    split, decoded = model.splitter(), model.as_bytes()
    id_bits = "short" if len(decoded) <= 1 << 15 else "int"
    lanes = 2 * shuffle_partitions(docs.sparkSession)
    piece_bytes = np.array([len(p) for p in decoded])
    marked = lambda text: MARK + text.replace(" ", MARK) if text else ""

    def dealt(own: Iterable[str]) -> dict[int, list[str]]:
        by_lane: dict[int, list[str]] = {}
        for unit in sorted(own):
            by_lane.setdefault(zlib.crc32(unit.encode()) % lanes, []).append(unit)
        return by_lane

    def lists(chunk: int, own: set[str]) -> pa.RecordBatch:
        by_lane = dealt(own)
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(by_lane), pa.int32()), pa.array(list(by_lane), pa.int32()), pa.array(map(GAP.join, by_lane.values()), pa.string())],
                                          ["_chunk", "_lane", "_units"])

    def unit_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set[str]] = {}
        for batch in batches:
            for chunk, text in zip(batch.column("_chunk").to_pylist(), (x.as_py() for x in batch.column("_t"))):
                own = found.setdefault(chunk, set())
                own.update(split(marked(text)))
                if len(own) > 200_000:  # bounds the memory; what is sent twice is merged below
                    yield lists(chunk, own)
                    own.clear()
        for chunk, own in found.items():
            yield lists(chunk, own)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for part, raw, offsets in blocks(batches, "_t", 4 << 20):  # longer stretches compress better
            chunks = np.asarray(part.column("_chunk"))
            for chunk in np.unique(chunks):
                own = np.flatnonzero(chunks == chunk)
                data = raw if len(own) == len(chunks) else np.concatenate([raw[offsets[i]:offsets[i + 1]] for i in own])
                yield pa.RecordBatch.from_arrays([pa.array([int(chunk)], pa.int32()), pa.array([part.column("_id").take(pa.array(own)).to_pylist()], pa.list_(part.schema.field("_id").type)),
                                                  pa.array([np.diff(offsets)[own].tolist()], pa.list_(pa.int64())), pa.array([codec.compress(data.tobytes(), asbytes=True)], pa.binary())],
                                                 ["_chunk", "_ids", "_sizes", "_blob"])

    sent = rows.select("_chunk", "_t").mapInArrow(unit_sets, "_chunk int, _lane int, _units string").repartitionById(lanes, F.col("_lane"))
    units = sent.select("_chunk", "_lane", F.explode(F.split("_units", GAP)).alias("unit")).groupBy("unit", "_lane").agg(F.collect_set("_chunk").alias("_chunks"))
    known = encode_units(units, model, ["_lane"]).select("_lane", F.explode("_chunks").alias("_chunk"), "unit", "ids")
    known = known.groupBy("_lane", "_chunk").agg(F.array_sort(F.collect_list(F.struct("unit", "ids"))).alias("_known"))
    # -1 - id marks a unit's last id
    known = known.select("_chunk", "_lane", F.expr("flatten(transform(_known.ids, x -> transform(x, (id, i) -> if(i = size(x) - 1, -1 - id, id))))").cast(f"array<{id_bits}>").alias("_codes"))
    held = rows.mapInArrow(packed, StructType([StructField("_chunk", IntegerType()), StructField("_ids", ArrayType(id_type)), StructField("_sizes", ArrayType(LongType())), StructField("_blob", BinaryType())]))
    names = [id_col, "n_tokens", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])]

    def join(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")

        def each() -> Iterator[str]:
            for sizes, blob in zip(texts.column("_sizes"), texts.column("_blob")):
                sizes = sizes.as_py()
                data, at = codec.decompress(blob.as_buffer(), sum(sizes), asbytes=True) if sum(sizes) else b"", 0
                for size in sizes:
                    yield data[at:at + size].decode()
                    at += size

        # a text is kept as the numbers of its units
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        held_as = [(array("i", map(number.__getitem__, split(marked(text)))), MARK not in text) for text in each()]
        units = list(number)
        number.clear()
        # the ids of a lane's units come in the order of the units, which the texts tell
        by_lane, ids_of, lost = dealt(units), {}, set()
        for lane, codes in zip(dictionary.column("_lane").to_pylist(), dictionary.column("_codes")):
            values = np.asarray(codes.values).astype("<i4")
            last = np.flatnonzero(values < 0)
            values[last] = -1 - values[last]
            plain, raw, ends = [u.replace(MARK, " ").encode() for u in by_lane[lane]], values.tobytes(), (4 * (last + 1)).tolist()
            ids_of.update((u, raw[a:b]) for u, a, b in zip(by_lane[lane], [0, *ends], ends))
            back = np.cumsum(piece_bytes[values])[last]
            if (np.cumsum([len(p) for p in plain]) != back).any() or b"".join(map(decoded.__getitem__, values.tolist())) != b"".join(plain):
                lost.update(u for u, p in zip(by_lane[lane], plain) if b"".join(map(decoded.__getitem__, np.frombuffer(ids_of[u], "<i4").tolist())) != p)
        # a text comes back if each of its units does, and no mark stood in it
        wrong = {i for i, u in enumerate(units) if u in lost} if lost else lost
        code_of = list(map(ids_of.__getitem__, units))
        out = [(b"".join(map(code_of.__getitem__, own)), unmarked and (not wrong or wrong.isdisjoint(own))) for own, unmarked in held_as]
        ids = [key for keys in texts.column("_ids").to_pylist() for key in keys]
        del ids_of, code_of, by_lane, held_as, units, dictionary
        code = [c for c, _ in out]
        table = {id_col: pa.array(ids, texts.schema.field("_ids").type.value_type), "n_tokens": pa.array([len(c) // 4 for c in code], pa.int64()),
                 "ids_crc32": pa.array([zlib.crc32(c) for c in code], pa.int64()), "round_trip": pa.array([ok for _, ok in out], pa.bool_())}
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in code], dtype=np.int64)])
            table["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(code), "<i4")))
        return pa.table(table)

    schema = StructType([StructField(id_col, id_type), *StructType.fromDDL("n_tokens long, ids_crc32 long, round_trip boolean").fields, *([StructField("ids", ArrayType(IntegerType()))] if with_ids else [])])
    return held.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(join, schema).select(*names)


def decode(coded: DataFrame, model: PieceModel, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Adds the text of each row's ids; null ids give null."""
    pieces = model.as_bytes()

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else b"".join(map(pieces.__getitem__, x))[1:].decode(errors="replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text_col])

    return coded.mapInArrow(texts, StructType([*coded.schema.fields, StructType.fromDDL(f"`{text_col}` string").fields[0]]))
