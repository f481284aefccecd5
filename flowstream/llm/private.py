"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier trained on their weighed votes decides.

Base spans (emails, addresses of hosts, payment cards, phone numbers of exact form) always count. Wider candidates are
broken or written-out forms of the same kinds. Three labelers vote on every candidate, base or not, and may abstain: the
exact form (regex), known prefixes and endings (gazetteer), and words in front of the span (context). Expectation-
maximisation over the counted vote patterns estimates each labeler's reliability per kind and a posterior for each
pattern; a logistic model on span features is fitted to these posteriors and adds the candidates it is sure of.

Rules for odd input: null counts as empty; a text without spans gives zero counts, an empty span list and the SHA-256 of
nothing; added spans never overlap base spans or each other; repeated rows get equal results; an empty table gives an
empty result. All scans take time in proportion to the text, also over long runs of digits or address characters.
Positions are code points, ends exclusive. Only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowstream.llm.text import quoted, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A match always begins where a run of digits begins, so looking behind changes nothing but the time.
QUAD = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider forms.
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]{1,63}){1,4}")
NATIONAL = re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
#: Fixed values of the labelers.
ENDINGS = frozenset("com org net edu gov int io info biz co uk de fr es it eu us ca au jp cn in br ru nl ch at se no".split())
CUES = (("mail", "email", "e-mail", "contact", "write", "correo"), ("ip", "host", "server", "address", "addr", "from"),
        ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"), ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "teléfono"))
AGAINST = ("version", "v", "no", "nr", "id", "order", "isbn", "page", "section", "$", "€")
LONE_CARD = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")  # within a run of too many digits
WINDOW = 24  # characters before a span that the context labeler reads


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _quad_ok(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and further candidates as (kind, start, end), each sorted."""
    base = [(EMAIL, a, b) for a, b in _emails(text)]
    wide: list[tuple[int, int, int]] = []
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        wide += [(EMAIL, m.start(), m.end()) for m in WRITTEN.finditer(text)]
    if DIGIT.search(text):
        for m in QUAD.finditer(text):
            (base if _quad_ok(m[0]) else wide).append((IP, *m.span()))
        for m in DIGITS.finditer(text):
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _only_digits(m[0])) <= 19:
                (base if luhn(d) else wide).append((CARD, *m.span()))
            elif m.end() - m.start() > 19:
                wide += [(CARD, x.start(), x.end()) for x in LONE_CARD.finditer(text, *m.span()) if luhn(x[0])]
        if "+" in text:
            base += [(PHONE, *m.span()) for m in PLUS.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
        wide += [(PHONE, *m.span()) for m in NATIONAL.finditer(text)]
    base.sort()
    if wide:
        # one sweep: base spans may overlap, so their stretches are joined first; both lists go by start
        taken: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], b)
            else:
                taken.append([a, b])
        clear, at, free = [], 0, 0
        for kind, a, b in sorted(wide, key=lambda x: (x[1], -x[2], x[0])):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if a >= free and (at == len(taken) or b <= taken[at][0]):
                clear.append((kind, a, b))
                free = b
        wide = sorted(clear)
    return base, wide


def votes(text: str, kind: int, a: int, b: int, exact: bool) -> tuple[int, int, int]:
    """Regex, gazetteer and context labelers: 1 for, 2 against, 0 abstains."""
    span = text[a:b]
    digits = _only_digits(span[:64])
    form = 1 if exact or (kind == CARD and 13 <= len(digits) <= 19 and luhn(digits)) else 2 if kind in (IP, CARD) else 0
    if kind == EMAIL:
        known = 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower() in ENDINGS else 0
    elif kind == IP:
        first = int(span.split(".")[0][-4:])
        known = 1 if 0 < first < 224 else 2
    elif kind == CARD:
        known = 1 if re.match(r"4|5[1-5]|2[2-7]|3[0-9]|6", digits) else 2
    else:
        known = 2 if len(digits) < 7 else 1 if span[0] == "+" or span[0] == "(" or (len(digits) == 10 and digits[0] not in "01") else 0
    before = re.findall(r"[^\s:;,.()]+", text[max(0, a - WINDOW):a].lower())[-3:]
    context = 1 if any(w in CUES[kind] for w in before) else 2 if before and before[-1] in AGAINST else 0
    return form, known, context


def pattern(text: str, kind: int, a: int, b: int, exact: bool) -> int:
    """Votes and span features as one small number."""
    form, known, context = votes(text, kind, a, b, exact)
    n = min(3, len(_only_digits(text[a:min(b, a + 64)])) // 5)
    open_left = int(a == 0 or not text[a - 1].isalnum())
    open_right = int(b == len(text) or not text[b].isalnum())
    return ((((((kind * 3 + form) * 3 + known) * 3 + context) * 4 + n) * 2 + open_left) * 2) + open_right


def _parts(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind, form, known, context, n, left, right of pattern numbers."""
    out = []
    for size in (2, 2, 4, 3, 3, 3):
        out.append(p % size)
        p = p // size
    return (p, *out[::-1])


def posteriors(p: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability that a candidate of each pattern is personal data: per kind, two classes whose labelers vote
    independently, fitted by expectation-maximisation from a majority start."""
    kind, *labelers = _parts(p)[:4]
    out = np.zeros(len(p))
    for k in np.unique(kind):
        own = kind == k
        v, w = np.stack([x[own] for x in labelers], 1), n[own].astype(float)
        lean = (v == 1).sum(1) - (v == 2).sum(1)
        y = 1 / (1 + np.exp(-2.0 * lean))
        for _ in range(rounds):
            prior = ((w * y).sum() + 1) / (w.sum() + 2)
            score = np.full(len(w), np.log(prior / (1 - prior)))
            for j in range(3):
                for vote in range(3):
                    of = v[:, j] == vote
                    # the prior counts say that votes for are likelier in truth and votes against in error
                    like = (w[of] @ y[of] + (4, 8, 1)[vote]) / (w @ y + 13)
                    unlike = (w[of] @ (1 - y[of]) + (4, 1, 8)[vote]) / (w @ (1 - y) + 13)
                    score[of] += np.log(like / unlike)
            y = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        out[own] = y
    return out


def classify(p: np.ndarray, n: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The span classifier's probability per pattern: logistic regression on kind and features, trained on posteriors."""
    target = posteriors(p, n)
    kind, *rest = _parts(p)
    columns = [kind == k for k in range(4)] + [f == x for f, size in zip(rest, (3, 3, 3, 4, 2, 2)) for x in range(1, size)]
    x = np.stack(columns, 1).astype(float)
    weight = np.log1p(n)
    weight = weight / weight.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps of a convex fit with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (weight * (q - target)) + 1e-4 * theta
        hess = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(len(theta))
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))


def private_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans (with the added ones), n_added."""
    rows = docs.select(quoted(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    fields = "base array<struct<kind: int, a: int, b: int, p: int>>, wide array<struct<kind: int, a: int, b: int, p: int>>"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.list_(pa.struct([(f, pa.int32()) for f in ("kind", "a", "b", "p")]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                base, wide = [], []
                for text in part.column("_t").to_pylist():
                    found = spans(text)
                    for into, own, exact in ((base, found[0], True), (wide, found[1], False)):
                        into.append([{"kind": k, "a": a, "b": b, "p": pattern(text, k, a, b, exact)} for k, a, b in own])
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(base, schema), pa.array(wide, schema)], ["_id", "base", "wide"])

    found = stored(rows.mapInArrow(scan, StructType([rows.schema[0], *StructType.fromDDL(fields).fields])), "spans")
    # at most a few thousand patterns exist, however many spans there are
    counts = found.select(F.explode(F.concat("base", "wide")).alias("s")).groupBy("s.p").count().toPandas().sort_values("p")
    p = counts["p"].to_numpy(int)
    sure_of = p[classify(p, counts["count"].to_numpy(float)) >= sure].tolist() if len(p) else []
    added = F.filter("wide", lambda s: s["p"].isin(sure_of)) if sure_of else F.filter("wide", lambda s: F.lit(False))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(c):
        return F.concat_ws(",", F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["a"].cast("string"), s["b"].cast("string"))))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.withColumn("_added", added).select(
        F.col("_id").alias(id_col), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "_added")).alias("spans"), F.size("_added").cast("long").alias("n_added"))
