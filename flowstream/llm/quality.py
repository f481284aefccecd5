"""Quality rules: plain text measures, and a log-likelihood ratio between trusted text and the raw corpus.

Byte n-grams of all documents are counted in hashed buckets, once for the trusted documents (the labelled good ones) and
once for the whole corpus. The two smoothed multinomials give every bucket a log ratio; a document's score is the mean log
ratio of its n-grams, so its length plays no part. Characters rather than words: their counts are dense also in a small
corpus, so a document is not marked down merely for words that no trusted document has. A document is dropped when it fails the plain rules or
its score lies below a fixed threshold.

Rules for odd input: null has no words; a document without words fails the plain rules (under ``MIN_WORDS``) and scores
0; without trusted documents all ratios are 0 and only the plain rules decide; repeated rows get equal results; an empty
table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowstream.llm.text import blocks, char_grams, ngram_hashes, quoted, row_of, segment_sums, span_hashes, text_or_empty, word_spans

MIN_WORDS = 50
SIZES, BITS = (2, 3, 4), 16
SMOOTH = 0.1  # weight of the raw shares in the trusted multinomial, as a part of its size
THRESHOLD = -0.25  # mean log ratio per n-gram
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: words that lie in a three-word window which the row holds twice or more."""
    grams, at = ngram_hashes(words, first, 3)
    if not len(grams):
        return np.zeros(len(first) - 1, np.int64)
    row = row_of(at)
    order = np.lexsort((grams, row))
    same = (grams[order][1:] == grams[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, bool)
    begin = (np.arange(len(grams)) + (first[:-1] - at[:-1])[row])[twice]
    for k in range(3):
        covered[begin + k] = True
    return segment_sums(covered[:-1], first)


def repeated_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    n_rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(n_rows, np.int64)
    breaks = np.flatnonzero(raw == 0x0A)
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.unique(np.concatenate([filled, breaks + 1]))
    starts = starts[starts < len(raw)]
    # a line ends at its break or at the end of its row
    ends = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, starts)], offsets[np.searchsorted(offsets, starts, "right")])
    row = np.searchsorted(offsets, starts, "right") - 1
    word_at, _, _ = word_spans(raw, offsets)
    has_word = np.searchsorted(word_at, ends) > np.searchsorted(word_at, starts)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    h = span_hashes(raw, starts, ends)
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=n_rows)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, offsets)
    return starts, ends, first, span_hashes(raw, starts, ends)


def fit_ratios(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio per bucket, from counts over all documents. ``trusted`` holds ids in its first column. A task sends its
    counts once, so what is shuffled is bounded by tasks x buckets, and the result by the buckets."""
    good = trusted.select(trusted.columns[0]).toDF("_id").where("_id is not null").distinct().withColumn("_good", F.lit(True)).hint("merge")  # the same plan at any size
    marks = docs.select(quoted(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).join(good, "_id", "left").select(F.coalesce("_good", F.lit(False)).alias("_good"), "_t")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int64)
        for part, raw, offsets in blocks(batches, "_t"):
            is_good = np.asarray(part.column("_good").to_numpy(zero_copy_only=False), bool)
            for bucket, at in char_grams(raw, offsets, SIZES, BITS):
                totals[0] += np.bincount(bucket, minlength=1 << BITS)
                totals[1] += np.bincount(bucket[np.repeat(is_good, np.diff(at))], minlength=1 << BITS)
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])], ["bucket", "n_raw", "n_good"])

    counts = marks.mapInArrow(count, "bucket long, n_raw long, n_good long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good")).toPandas()
    return ratios(counts["bucket"].to_numpy(), counts["n_raw"].to_numpy(), counts["n_good"].to_numpy())


def ratios(bucket: np.ndarray, n_raw: np.ndarray, n_good: np.ndarray) -> np.ndarray:
    """Log of the smoothed trusted share of a bucket over its smoothed raw share; 0 where nothing is trusted."""
    raw, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[bucket.astype(int)], good[bucket.astype(int)] = n_raw, n_good
    if not good.sum():
        return np.zeros(1 << BITS)
    share = (raw + 1) / (raw.sum() + len(raw))
    weight = SMOOTH * good.sum()  # smoothing towards the raw shares bounds every ratio from below, at any size
    return np.log((good + weight * share) / (good.sum() + weight)) - np.log(share)


def quality(docs: DataFrame, ratio: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 8 bytes x 2^BITS
    rows = docs.select(quoted(id_col).alias(id_col), text_or_empty(text_col).alias("_t"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "_t"):
            starts, ends, first, words = _words(raw, offsets)
            n_words = np.diff(first)
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # bytes that begin a code point
            n_repeat = repeated_words(words, first)
            total, n_grams = np.zeros(len(n_words)), np.zeros(len(n_words))
            for bucket, at in char_grams(raw, offsets, SIZES, BITS):
                total += segment_sums(shared.value[bucket], at)
                n_grams += np.diff(at)
            score = total / np.maximum(n_grams, 1)
            failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(segment_sums(points[ends] - points[starts], first)),
                                              pa.array(segment_sums(SYMBOLS[raw], offsets)), pa.array(repeated_lines(raw, offsets)), pa.array(n_repeat),
                                              pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], [id_col, *names])

    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"]
    return rows.mapInArrow(measure, StructType([rows.schema[0], *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(names, kinds))).fields]))
