"""Small tables with the odd cases every operator must take: nulls, empty and very long texts, ties, repeated rows,
clashing column names, and no rows at all."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, score double, kept boolean, _id string, _text string, `a.b c` int"


def words(n: int, seed: int, pool: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    base = words(120, 1, 10_000)
    near = base.rsplit(" ", 4)[0] + " other words at end"
    texts = [None, None, "", "   \n\t ", "a", "été ▁ x 😀", base, base, near, base + " ", words(60, 2), "x" * 30_000, words(9_000, 3), "the cat sat on the mat " * 40,
             "mail me: jo.e@mail.example.com or +1 (212) 555-0187, card 4111 1111 1111 1111, host 10.0.0.7\nline\nline\n"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], 0.5, True, "x", "y", 1) for i, t in enumerate(texts)]
    rows.append((None, "text without an id, but with some words", "en", "s1", None, None, None, None, None))
    rows.append(rows[6])  # a repeated row
    rows.append((14, "the same id, another text", "en", "s3", 1.0, False, "x", "y", 2))
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
