"""Exact copies, near copies and repeated passages against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowstream.llm.exact import drop_exact_copies, mark_exact
from flowstream.llm.neardup import choose_bands, jaccard_join, keep_one_of_class
from flowstream.llm.repeats import interval_tree, without_repeats
from flowstream.llm.skew import components
from tests.llm.fixtures import empty, odd, odd_rows, words


def test_exact_odd(spark):
    rows = odd_rows()
    got = [tuple(r) for r in mark_exact(odd(spark)).collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is not None, x), reverse=True)):
            expected[(i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(got) == expected


def test_exact_rows_kept(spark):
    docs = odd(spark)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r[1] or "" for r in kept.collect()) == sorted({r[1] or "" for r in odd_rows()})
    assert {r[0] for r in kept.where("text = '" + odd_rows()[6][1] + "'").collect()} == {7}


def test_exact_hot_text(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    got = mark_exact(docs)
    assert got.where("kept").count() == 4001
    assert got.where("group_size = 2000 and keep_id = 5997").count() == 2000


@pytest.mark.parametrize("operator", [mark_exact, drop_exact_copies, jaccard_join, keep_one_of_class, without_repeats])
def test_empty(spark, operator):
    assert operator(empty(spark)).count() == 0


def test_bands_reach_recall():
    bands, rows = choose_bands(.8, .999)
    assert 1 - (1 - .8 ** rows) ** bands >= .999 and bands * rows <= 160


def plain_classes(texts):
    keys = [tuple((t or "").split()) for t in texts]
    distinct = sorted(set(keys))
    sets = [frozenset(k[i:i + 5] for i in range(len(k) - 4)) for k in distinct]
    links, root = [0] * len(distinct), list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    place = {k: i for i, k in enumerate(distinct)}
    return [(find(place[k]), links[place[k]], keys.count(k)) for k in keys]


def near_texts():
    rng, out = random.Random(4), []
    for g in range(12):
        base = words(rng.randrange(5, 120), 100 + g, 5000).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(99)}"
            out.append(" ".join(copy))
    return out


def test_jaccard_join(spark):
    texts = [*near_texts(), *(r[1] for r in odd_rows())]
    expected = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join(docs).collect()}
    smallest = {}
    for i, (c, _, _) in enumerate(expected):
        smallest.setdefault(c, i)
    assert [(got[i].class_id, got[i].n_links, got[i].n_copies) for i in range(len(texts))] == [(smallest[c], n, k) for c, n, k in expected]


def test_jaccard_large_group_in_tiles(spark, monkeypatch):
    """More near copies than a tile holds, all linked with each other."""
    monkeypatch.setattr("flowstream.llm.neardup.TILE", 16)
    base = words(200, 9, 9000)
    docs = spark.createDataFrame([(i, f"{base} end{i}") for i in range(70)], "doc_id long, text string")
    got = jaccard_join(docs).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {69}


def test_one_of_class_stays(spark):
    docs = odd(spark)
    kept = keep_one_of_class(docs)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.collect() if r[0] is not None)
    assert 6 in ids and not {7, 8, 9} & set(ids) and len(ids) == len(set(ids)) + ids.count(14) - 1


def test_each_class_keeps_one_where_ids_are_null_or_repeated(spark):
    """Classes are told apart by their texts: none is dropped because another one has its id."""
    a, b, c, d = (words(60, i, 9000) for i in range(4))
    rows = [(14, a), (14, b), (None, c), (None, d), (None, f"{d} end"), (None, f"{a} end"), (20, f"{b} end"), (14, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in keep_one_of_class(docs).collect())
    assert len(kept) == 4 and {(14, a), (14, b), (0, c)} < set(kept)
    assert (set(kept) - {(14, a), (14, b), (0, c)}).pop() in {(0, d), (0, f"{d} end")}
    lone = spark.createDataFrame([(None, words(30, 100 + i, 9000)) for i in range(200)], "doc_id long, text string")
    assert keep_one_of_class(lone).count() == 200


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(260)] + [(f"{i:03d}", f"{i + 1:03d}") for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string"), "t").collect()}
    assert got == {x: find(x) for x in root}


def test_interval_tree():
    assert sorted(interval_tree(np.array([2, 5, 5, 1]))) == [(1, 0, 4), (2, 0, 3), (5, 1, 3)]


def plain_removal(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                gone[i:i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é"])
@pytest.mark.parametrize("tree", [20_000, 3])
def test_repeats(spark, letters, tree):
    rng = random.Random(len(letters))
    text = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    passages = [text(30, 90) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 30):], text(1, 60), "a" * rng.randint(0, 60)]) for _ in range(rng.randint(0, 5))) for _ in range(100)]
    texts += [*texts[:4], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in without_repeats(docs, length=40, seed=12, tree=tree).orderBy("doc_id").collect()]
    assert got == plain_removal(texts, 40)


def test_repeats_odd(spark):
    rows = odd_rows()
    got = Counter(tuple(r) for r in without_repeats(odd(spark)).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, plain_removal([r[1] for r in rows], 400)))
