"""Language identification: multinomial naive Bayes over hashed character n-grams.

Byte n-grams of one to four bytes (ASCII letters small) are counted per language over all training rows; the smoothed log
probabilities form a matrix of buckets x languages that is broadcast. A batch of texts is scored by adding the matrix rows
of its n-grams. The score is the posterior of the language after tempering by the square root of the text's length, as the
n-grams of a text are far from independent.

Rules for odd input: ``und`` with score 0.0 for a text that is null, empty or without a letter, and for every text when
there is no training row; a training row without language or text is left out; ties go to the language that is first by
code point; repeated rows are predicted alike. Columns other than id, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowstream.llm.text import blocks, char_grams, quoted, text_or_empty

SIZES, BITS = (1, 2, 3, 4), 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code point order, log priors, and log probabilities by bucket (rows) and language (columns)."""

    languages: tuple[str, ...]
    priors: np.ndarray
    matrix: np.ndarray


def fit_languages(docs: DataFrame, *, train_where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5) -> LanguageModel:
    """Counts over all training rows: a task adds up its rows and sends buckets x languages at most."""
    lang = quoted(lang_col).cast("string")
    rows = docs.where(train_where) if train_where is not None else docs
    rows = rows.where(lang.isNotNull() & quoted(text_col).isNotNull()).select(lang.alias("_l"), text_or_empty(text_col).alias("_t"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for part, raw, offsets in blocks(batches, "_t"):
            own = np.array(part.column("_l").to_pylist(), object)
            grams = list(char_grams(raw, offsets, SIZES, BITS))
            for name in set(own.tolist()):
                mine = own == name
                into = totals.setdefault(name, np.zeros(1 << BITS, np.int64))
                texts[name] = texts.get(name, 0) + int(mine.sum())
                for h, at in grams:
                    into += np.bincount(h[np.repeat(mine, np.diff(at))], minlength=1 << BITS)
        for name, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(counts[some], texts[name]))], ["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(got["lang"])))
    index = {name: i for i, name in enumerate(languages)}
    counts, texts = np.zeros((1 << BITS, len(languages))), np.zeros(len(languages))
    column, bucket, n = got["lang"].map(index).to_numpy(int), got["bucket"].to_numpy(int), got["n"].to_numpy(float)
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    texts[column[bucket < 0]] = n[bucket < 0]
    matrix = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * len(counts))
    return LanguageModel(languages, np.log(texts / max(texts.sum(), 1)), matrix.astype(np.float32))


def detect(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes x 2^BITS x languages
    rows = docs.select(quoted(id_col).alias(id_col), text_or_empty(text_col).alias("_t"))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, raw, offsets in blocks(batches, "_t"):
            n = len(offsets) - 1
            if not m.languages:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([UNKNOWN] * n), pa.array([0.0] * n)], [id_col, "lang_pred", "score"])
                continue
            total, grams = np.zeros((n, len(m.languages))), np.zeros(n)
            for h, at in char_grams(raw, offsets, SIZES, BITS):
                row = np.repeat(np.arange(n), np.diff(at))
                grams += np.diff(at)
                for k in range(len(m.languages)):
                    total[:, k] += np.bincount(row, m.matrix[h, k], n)
            total = total / np.sqrt(np.maximum(grams, 1))[:, None] + m.priors
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            letters = np.asarray(pc.match_substring_regex(part.column("_t"), r"\p{L}").to_numpy(zero_copy_only=False), bool)
            names = np.where(letters, np.array(m.languages, object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names.tolist(), pa.string()), pa.array(np.where(letters, score, 0.0))], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(predict, StructType([rows.schema[0], *StructType.fromDDL("lang_pred string, score double").fields]))
