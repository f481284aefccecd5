"""Trained filters: planted signals, odd input, plain measures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowstream.llm.language import detect, fit_languages
from flowstream.llm.private import KINDS, classify, luhn, pattern, private_spans, spans
from flowstream.llm.quality import fit_ratios, quality
from flowstream.llm.toxicity import drop_toxic, fit_toxicity, toxicity_scores
from tests.llm.fixtures import empty, odd, odd_rows, words


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        text = words(rng.randrange(5, 150), i)
        if i % 5 == 0:
            text += "".join(f" {rng.choice(['badword', 'awfulness', 'nastiest'])}" for _ in range(1 + len(text) // 100))
        rows.append((i, text, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.where("doc_id < 400").selectExpr("doc_id", "y as toxic")
    return docs, labels, fit_toxicity(docs, labels)


def test_toxicity_held_out(toxic):
    docs, _, model = toxic
    got = toxicity_scores(docs.where("doc_id >= 400"), model, keep=["doc_id", "y"]).collect()
    assert np.mean([(r.score >= .7) == bool(r.y) for r in got]) > .95
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_odd(spark, toxic):
    docs = odd(spark)
    scored = toxicity_scores(docs, toxic[2], keep=["doc_id", "a.b c"], score_col="s").collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r.s <= 1 for r in scored)
    kept = drop_toxic(docs, toxic[2])
    assert kept.columns == docs.columns and kept.count() == sum(r.s < .7 for r in scored)
    assert drop_toxic(empty(spark), toxic[2]).count() == 0


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(6, 0), (7, 0), (None, 1), (8, None)], 0.0), ([(6, 1)], 1.0)])
def test_toxicity_without_two_classes(spark, labels, score):
    docs = odd(spark)
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity_scores(docs, model, keep=["doc_id"]).collect()} == {score}


def test_languages(spark):
    sounds = {"xx": ["ba", "bo", "bi"], "yy": ["ka", "ku", "ké"], "zz": ["шо", "ша", "жи"]}
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang) for i, lang in enumerate(list(sounds) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs.where("doc_id < 90"))
    got = {r.doc_id: r for r in detect(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    strange = detect(odd(spark), model).collect()
    assert len(strange) == len(odd_rows())
    by_text = {t: "und" for t in (None, "", "   \n\t ")}
    for r, s in zip(odd_rows(), detect(odd(spark).coalesce(1), model).collect()):
        assert r[0] == s.doc_id and (s.lang_pred in sounds) == (r[1] not in by_text)
    assert detect(empty(spark), model).count() == 0
    none = fit_languages(empty(spark))
    assert {r.lang_pred for r in detect(odd(spark), none).collect()} == {"und"}


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_quality(spark):
    rng = random.Random(5)
    good = [(i, words(80, i), 1) for i in range(100)]
    bad = [(100 + i, " ".join(f"q{rng.randrange(300)}##" for _ in range(80)), 0) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, y int")
    ratio = fit_ratios(docs, docs.where("y = 1 and doc_id < 60").select("doc_id"))
    got = {r.doc_id: r for r in quality(docs, ratio).collect()}
    assert all(got[i].kept == bool(y) for i, _, y in good + bad)
    rows = odd_rows()
    strange = Counter(tuple(r)[:7] for r in quality(odd(spark), ratio).collect())
    assert strange == Counter((r[0], *plain_measures(r[1])) for r in rows)
    random_texts = ["".join(rng.choice("ab \n\té#|") for _ in range(rng.randrange(200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(random_texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:7] for r in quality(docs, ratio).collect()} == {i: plain_measures(t) for i, t in enumerate(random_texts)}
    assert quality(empty(spark), fit_ratios(empty(spark), empty(spark).select("doc_id"))).count() == 0


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_random():
    rng = random.Random(0)
    for _ in range(30_000):
        t = "".join(rng.choice("a1.@-+ 2_é(0)") for _ in range(rng.randrange(30)))
        assert [(KINDS[k], a, b) for k, a, b in spans(t)[0]] == plain_base(t)


def test_private(spark):
    rows = odd_rows()
    got = private_spans(odd(spark)).collect()
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(rows[14][1]))
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got if r.n_email] == [(1, 1, 1, 1, hashlib.sha256(text.encode()).hexdigest())]
    assert all(r.spans == "" for r in got if not r.n_email) and len(got) == len(rows)
    assert private_spans(empty(spark)).count() == 0


def test_method_adds_spans(spark):
    """Phones run together with other digits and written-out addresses are no base spans; votes bring them back."""
    rows = [(i, f"call us: +1 (212) 555-01{i:02d} or mail: me{i}@mail.example.com today") for i in range(60)]
    rows += [(100, "phone +1 (315) 555-0199 4111111111111111 end"), (101, "mail: jo [at] mail.example [dot] com now"), (102, "order 999.999.1.1 and nothing else")]
    got = {r.doc_id: r for r in private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].n_added >= 1 and "phone:6:" in got[100].spans
    assert got[101].n_added == 1 and got[101].spans.startswith("email:6:")
    assert got[102].n_added == 0 and all(got[i].n_added == 0 for i in range(60))


def test_reliable_votes_win():
    text = "mail: a@b.com"
    good = pattern(text, 0, 6, 13, True)
    bad = pattern("version 999.1.1.1", 1, 8, 17, False)
    p = classify(np.array([good, bad]), np.array([50.0, 50.0]))
    assert p[0] > .9 > .1 > p[1]


def test_added_spans_equal_a_plain_sweep_and_take_linear_time():
    import random
    import time

    from flowstream.llm import private as P

    def plain(text):
        base, _ = P.spans(text)
        wide = []
        wide += [(P.EMAIL, m.start(), m.end()) for m in P.WRITTEN.finditer(text)]
        wide += [(P.IP, *m.span()) for m in P.QUAD.finditer(text) if not P._quad_ok(m[0])]
        for m in P.DIGITS.finditer(text):
            n = len(P._only_digits(m[0]))
            if 13 <= m.end() - m.start() <= 37 and 13 <= n <= 19:
                wide += [] if P.luhn(P._only_digits(m[0])) else [(P.CARD, *m.span())]
            elif m.end() - m.start() > 19:
                wide += [(P.CARD, x.start(), x.end()) for x in P.LONE_CARD.finditer(text, *m.span()) if P.luhn(x[0])]
        wide += [(P.PHONE, *m.span()) for m in P.NATIONAL.finditer(text)]
        taken, clear = [(a, b) for _, a, b in base], []
        for kind, a, b in sorted(wide, key=lambda x: (x[1], -x[2], x[0])):
            if not any(x < b and a < y for x, y in taken):
                clear.append((kind, a, b))
                taken.append((a, b))
        return sorted(clear)

    rng = random.Random(3)
    bits = ["555-0187 ", "(212) 555-0199 ", "+1 212 555 0123 ", "4111 1111 1111 1111 ", "4111111111111112 ", "300.1.2.3 ", "10.0.0.7 ", "a (at) b (dot) com ", "x@y.org ", "word ", "12 345 6789 ", "1.2.3.4.5 ", "-", "9"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        assert P.spans(text)[1] == plain(text), text
    phones = "".join(f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}\n" for _ in range(140_000))  # 2 MB
    started = time.monotonic()
    assert len(P.spans(phones)[1]) == 140_000 and time.monotonic() - started < 20


def test_toxicity_of_repeated_ids_does_not_depend_on_partitions(spark):
    from flowstream.llm.toxicity import fit_toxicity

    rows = [(i % 60, f"{'bad vile' if i % 60 % 3 == 0 else 'calm kind'} words {i} {i * 7 % 13}") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [fit_toxicity(docs.repartition(n), labels, epochs=5) for n in (1, 4, 7)]
    for m in models[1:]:
        assert m.bias == models[0].bias and (m.weights == models[0].weights).all()
