"""Mixing, pieces, token files and the pipeline."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from flowstream.llm.idfiles import decode_blocks, encode_blocks, read_ids, write_ids
from flowstream.llm.mixing import mixed, mixing_report, mixing_table, split_quotas
from flowstream.llm.pieces import PieceModel, decode, encode, encode_units, load_pieces
from flowstream.llm.queries import QUERIES
from tests.llm.fixtures import empty, odd, odd_rows, words

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess over the caps until nothing is above."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while len(fixed) < len(sizes):
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over
    return fixed


def test_pieces_query_returns_ids(spark, tmp_path):
    texts = ["one two  three", "", "naïve 漢字", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=str(PIECES))
    got = {r.doc_id: r for r in QUERIES["op5_sentencepiece"](spark, str(tmp_path)).collect()}
    assert {i: list(got[i].ids) for i in got} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, words(rng.randrange(1, 60), i), rng.choice(["a", "a", "a", "a", "b", "ä", "c", None, "tiny"] if i % 50 else ["d"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = mixing_table(docs)
    got = {r.doc_id: r for r in mixing_report(docs, table).collect()}
    sizes, taken = {}, {}
    for i, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert got[i].size == n and got[i].taken in (0, n, 2 * n, 3 * n) and len(got[i].shards) * n == got[i].taken
        sizes[s], taken[s] = sizes.get(s, 0) + n, taken.get(s, 0) + got[i].taken
    targets = plain_targets(sizes)
    for i, _, s in rows:
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(targets[s])
    assert all(abs(taken[s] - targets[s]) <= max(40, .01 * targets[s]) for s in sizes)
    again = {r.doc_id: r for r in mixing_report(docs.repartition(7), mixing_table(docs.repartition(3, "text"))).collect()}
    assert again == got
    out = mixed(docs, table)
    assert out.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert copies == {i: len(r.shards) for i, r in got.items() if r.shards}


def test_mixing_goes_on_past_long_documents(spark):
    """A source is taken to its target up to its smallest document, wherever its long ones stand."""
    rows = []
    for k in range(6):
        rng = random.Random(k)
        rows += [(1000 * k + i, words(20_000 if i == 0 else rng.randrange(50, 400), 1000 * k + i), f"s{k}") for i in range(300)]
    rows += [r for r in rows if r[2] == "s5" and r[0] % 3 == 0]  # repeated rows are taken together
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing_report(docs, mixing_table(docs, weights=(1, 2, 1, 3, 1, 2))).collect()
    taken, targets = {}, {}
    for r in got:
        s = r.doc_id // 1000
        taken[s], targets[s] = taken.get(s, 0) + r.taken, r.target
    assert all(abs(taken[s] - targets[s]) <= 50 for s in targets), (taken, targets)
    assert len({len(r.shards) for r in got if r.doc_id == 5003}) == 1


def test_mixing_odd(spark):
    docs = odd(spark)
    got = mixing_report(docs, mixing_table(docs)).collect()
    assert len(got) == len(odd_rows()) and all(r.taken <= 3 * r.size for r in got)
    assert mixing_report(empty(spark), mixing_table(empty(spark))).count() == 0
    blank = docs.where("text is null or trim(text) = ''")
    assert {(r.size, r.target, r.taken) for r in mixing_report(blank.where("doc_id < 3"), mixing_table(blank.where("doc_id < 3"))).collect()} == {(0, 0.0, 0)}


def test_splitting_tree():
    quotas = np.array([900, 0, 7, 130, 1])
    out = split_quotas(quotas, 13, 5)
    assert (out.sum(0) == quotas).all() and np.ptp(out.sum(1)) <= 1 and (out >= 0).all()
    mean = np.mean([split_quotas(quotas, 4, s)[0] for s in range(300)], axis=0)
    assert np.allclose(mean, quotas / 4, atol=1.5)


def test_pieces_equal_the_library(spark):
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), load_pieces(PIECES)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "ab", "  ", "é", "\n", "😀", "123", "ing", "▁", "\t", "<s>", "Straße "]) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += [r[1] for r in odd_rows() if r[1] is not None and len(r[1]) < 20_000] + ["   ", "a" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = encode(docs, model)
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
        assert got[i].round_trip == ("▁" not in t)
    back = {r.doc_id: r.text for r in decode(coded, model).collect()}
    assert all(back[i] == sp.decode(got[i].ids) for i in got)


def test_words_with_signs_share_a_unit(spark):
    """A word with a sign or number behind it is no unit of its own, and the ids stay the library's, also where ids need over 16 bits."""
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), load_pieces(PIECES)
    split, rng = model.splitter(), random.Random(3)
    signs = [",", ".", ";", "!", "?", ")", "2024", "§", "é"]
    assert len({split(f"▁onhatith{s}")[0] for s in signs[:6]}) == 1
    for _ in range(300):
        unit = "▁" + "".join(rng.choice([*signs, "th", "on", "'s", "(", "-", "_", "漢", "▁"]) for _ in range(rng.randrange(1, 9)))
        assert "".join(split(unit)) == unit
    texts = [" ".join("".join(rng.choice([*signs, "th", "on", "'s", "(", "-", "_", "漢"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = 40_000 - len(model.pieces)  # pieces that no text holds
    wide = PieceModel(model.pieces + tuple(f"\ue000{chr(0xE001 + i)}" for i in range(more // 2)) + ("\ue000",) * (more - more // 2), model.scores + (-1e9,) * more,
                      model.normal + (True,) * (more // 2) + (False,) * (more - more // 2), model.first_byte, model.kind)
    assert len(wide.pieces) > 1 << 15
    for m in (model, wide):
        assert {r.doc_id: (r.ids, r.round_trip) for r in encode(docs, m).collect()} == {i: (sp.encode(t), True) for i, t in enumerate(texts)}


def test_pieces_odd(spark):
    model = load_pieces(PIECES)
    got = encode(odd(spark), model, with_ids=False).collect()
    assert len(got) == len(odd_rows()) and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert encode(empty(spark), model).count() == 0


def test_viterbi_of_a_unigram_model(spark):
    rng = random.Random(6)
    normal = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "abab"]
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *normal]
    scores = [0.0] * 257 + [-rng.uniform(1, 9) for _ in normal]
    model = PieceModel(tuple(pieces), tuple(scores), tuple([False] * 257 + [True] * len(normal)), 1, "unigram")
    units = ["▁" * rng.randrange(2) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    units = sorted(set(units))

    def best(u):
        found = [(0.0, [])] + [None] * len(u)
        for j in range(1, len(u) + 1):
            ways = [(found[i][0] + scores[257 + normal.index(u[i:j])], found[i][1] + [257 + normal.index(u[i:j])]) for i in range(j) if u[i:j] in normal]
            if u[j - 1] not in normal:
                ways.append((found[j - 1][0] + min(scores[257:]) - 10, found[j - 1][1] + [1 + b for b in u[j - 1].encode()]))
            found[j] = max(ways)
        return found[-1][1]

    got = {r.unit: r.ids for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), model).collect()}
    assert set(got) == set(units)
    for u in units:  # equal scores may be reached by several paths
        assert model.as_bytes() and b"".join(model.as_bytes()[i] for i in got[u]) == u.replace("▁", " ").encode()
        assert sum(scores[i] for i in got[u]) == pytest.approx(sum(scores[i] for i in best(u)))


@pytest.mark.parametrize("sizes", [[], [0], [1], [3, 3000, 0, 7], [2048] * 20])
def test_blocks_round_trip(sizes):
    rng = np.random.default_rng(len(sizes))
    blocks = [rng.integers(0, 65_535, n) if i % 2 else np.tile(rng.integers(0, 500, 9), n // 9 + 1)[:n] for i, n in enumerate(sizes)]
    codes = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(codes, sizes)))
    if sizes == [2048] * 20:
        assert sum(len(c) for c in codes[::2]) < 2048 * 10 / 4  # repeated ids become a fraction of a bit


def test_token_files(spark):
    rows = odd_rows() + [(50 + i, t, *[None] * 7) for i, t in enumerate(["İstanbul ΣΑΣ Σ", "é Å", "a\x1cb <|endoftext|> c", "don't 12,5 x y\x85z", "ſtraße K"])]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    got = read_ids(spark, write_ids(docs, WORDS), with_ids=True).collect()
    tok = Tokenizer.from_file(WORDS)
    expected = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]
    assert sorted(map(str, ((r.doc_id, r.token_ids) for r in got))) == sorted(map(str, expected))
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.token_ids) and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        at += r.n_tokens
    assert read_ids(spark, write_ids(empty(spark), WORDS)).count() == 0


def test_damaged_block_is_found(spark):
    path = write_ids(odd(spark), WORDS)
    bad = spark.read.parquet(path).withColumn("crcs", F.transform("crcs", lambda c: c + 1))
    bad.write.parquet(path + "-bad")
    with pytest.raises(Exception, match="checksum"):
        read_ids(spark, path + "-bad").collect()


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, words(rng.randrange(60, 120), i, 3000) + (" badword nastiest" * 8 if i % 10 == 0 else ""), "en", f"s{i % 4}", 1) for i in range(300)]
    rows += [(1000 + i, rows[i + 1][1], "en", "s1", 1) for i in range(5)]
    rows += [(2000 + i, rows[i + 11][1] + " end", "en", "s2", 1) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    clean = {r[0] for r in rows if "badword" not in r[1]}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - set(range(1, 6))  # of equal texts the largest id stays
    assert set(kept[2]) == set(kept[1]) - set(range(2000, 2005))  # of a class the smallest
    assert set(kept[3]) <= set(kept[2]) and sorted(kept[4]) == sorted(kept[3])
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = {r[0]: r[1] for r in rows}
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in ran) == sorted(kept[4])
    assert all(r.ids == sp.encode(text[r.doc_id]) and r.round_trip for r in ran)


def test_long_runs_without_a_space(spark):
    """Random letters, base64, Chinese and one repeated sign, next to ordinary words: ids as the library's, in seconds."""
    import base64
    import random
    import time

    rng = random.Random(5)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), base64.b64encode(rng.randbytes(40_000)).decode(),
             "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(30_000)), "a line " + "=" * 3000 + " and words", "▁ mark", "plain words 😀 été"]
    started = time.monotonic()
    got = {r.doc_id: r for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), load_pieces(path)).collect()}
    assert time.monotonic() - started < 60
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t) and got[i].round_trip == ("▁" not in t)
