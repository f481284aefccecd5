"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Every text is the set of its hashed byte n-grams. The log-count ratio of a gram (how much likelier it is in a text
of label 1) scales its feature, a logistic regression is fitted on the scaled, length-normalised features, and a
logistic calibration on other labelled rows turns margins into scores.

Rules for odd input: a null text counts as empty and gets the score of a text without features; an unlabelled id,
a null label or a null id never enters the fit; an id labelled twice counts with its larger label; with labels of one
class only, every score is 0.0 or 1.0 accordingly; without any label it is 0.0. Repeated rows are scored alike; of labelled rows that share
an id, the one whose sorted features are smallest enters the fit.
Columns of the documents are never touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowstream.llm.text import blocks, char_grams, packed, quoted, text_or_empty, unpacked


ROWS = 200  # rows whose features are expanded at a time


@dataclass(frozen=True)
class NgramModel:
    """Weights per gram bucket (ratio and coefficient multiplied), intercept, calibration slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    sizes: tuple[int, ...]
    bits: int

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins + self.bias) + self.offset, -60, 60)))


def gram_sets(raw: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The sorted distinct gram buckets of each row."""
    parts = list(char_grams(raw, offsets, sizes, bits))
    seen = np.zeros(1 << bits, bool)
    for i in range(len(offsets) - 1):
        grams = np.concatenate([h[o[i]:o[i + 1]] for h, o in parts])
        if len(grams) < 256:
            yield np.unique(grams)
            continue
        seen[grams] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, with smoothed targets (so separable data stay finite)."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = x.std() or 1.0
    z, a, c = x / spread, 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
        d, h = p - goal, p * (1 - p) + 1e-9
        g = np.array([(d * z).sum() + 1e-3 * a, d.sum()])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]]), g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -4, 4)
    return a / spread, c


def _weights(grams: list[np.ndarray], label: np.ndarray, bits: int, epochs: int, decay: float) -> tuple[np.ndarray, float]:
    """Ratio times coefficient per bucket, and the intercept."""
    size = 1 << bits
    n = np.array([len(g) for g in grams])
    ones, zeros = max(label.sum(), 1), max((1 - label).sum(), 1)
    seen = np.zeros((2, size))
    for g, y in zip(grams, label):
        seen[int(y), g] += 1
    ratio = np.log((seen[1] + 1) / (ones + 2)) - np.log((seen[0] + 1) / (zeros + 2))
    scale = 1 / np.sqrt(np.maximum(n, 1))
    balance = np.where(label == 1, .5 / ones, .5 / zeros)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, epochs + 1):  # Adam over all rows at once: no order of rows to depend on
        scaled, g, gb = w * ratio, decay * w, 0.0
        for at in range(0, len(grams), ROWS):  # in parts, so the memory is that of a few hundred rows
            part = slice(at, at + ROWS)
            ids = np.concatenate(grams[part])
            offsets = np.concatenate([[0], np.cumsum(n[part])])
            p = 1 / (1 + np.exp(-np.clip(_row_sums(scaled[ids], offsets) * scale[part] + b, -60, 60)))
            d = (p - label[part]) * balance[part]
            g += np.bincount(ids, np.repeat(d * scale[part], n[part]), size) * ratio
            gb += d.sum()
        m, v, mb, vb = .9 * m + .1 * g, .999 * v + .001 * g * g, .9 * mb + .1 * gb, .999 * vb + .001 * gb * gb
        fix1, fix2 = 1 - .9 ** t, 1 - .999 ** t
        w -= .05 * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= .05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return (w * ratio).astype(np.float32), float(b)


def train(grams: list[np.ndarray], y: np.ndarray, half: np.ndarray, bits: int, epochs: int, decay: float) -> tuple[np.ndarray, float, float, float]:
    """Weights, intercept, slope and offset from gram sets and labels. The calibration curve goes through the margins
    that each half of the rows gets from a fit on the other half; the weights come from all rows."""
    label = y.astype(float)
    margins = np.zeros(len(y))
    halves = [np.flatnonzero(half), np.flatnonzero(~half)]
    apart = all(len(set(y[h])) == 2 for h in halves)
    for own, other in (halves, halves[::-1]) if apart else [(np.arange(len(y)),) * 2]:
        w, b = _weights([grams[i] for i in own], label[own], bits, epochs, decay)
        margins[other] = [w[grams[i]].sum(dtype=np.float64) / np.sqrt(max(len(grams[i]), 1)) + b for i in other]
    if apart:
        w, b = _weights(grams, label, bits, epochs, decay)
    return w, b, *map(float, _logistic(margins, label))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 train_where: Column | None = None, per_class: int = 2000, sizes: tuple[int, ...] = (3, 4, 5), bits: int = 18,
                 epochs: int = 60, decay: float = 1e-5, seed: int = 7) -> NgramModel:
    """Fit on at most ``per_class`` labelled rows of either class (drawn by hash of the id; ``train_where`` is a condition
    on the label table). One task trains on that bounded sample."""
    key = quoted(id_col)
    rows = labels.where(train_where) if train_where is not None else labels
    rows = (rows.where(key.isNotNull() & quoted(label_col).isNotNull()).groupBy(key.alias("_id"))
            .agg(F.max((quoted(label_col) > 0).cast("int")).alias("_y")))
    order = F.xxhash64("_id", F.lit(seed))
    drawn = [rows.where(F.col("_y") == y).orderBy(order, "_id").limit(per_class) for y in (0, 1)]
    sample = drawn[0].unionByName(drawn[1]).withColumn("_half", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(2)) == 0)
    texts = docs.select(key.alias("_id"), text_or_empty(text_col).alias("_t")).join(F.broadcast(sample), "_id")  # 2 x per_class rows

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "_t"):
            sets = [g.astype(np.int32).tobytes() for g in gram_sets(raw, offsets, sizes, bits)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), part.column("_half"), pa.array(sets, pa.binary())], ["_id", "_y", "_half", "g"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of rows that share an id, the one with the smallest features counts, whatever the partitions
        rows = sorted({r["_id"]: r for r in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["g"], reverse=True)}.items(), key=lambda x: str(x[0]))
        y = np.array([r["_y"] for _, r in rows], int)
        if len(set(y.tolist())) == 2:
            grams = [np.frombuffer(r["g"], np.int32) for _, r in rows]
            w, b, slope, offset = train(grams, y, np.array([r["_half"] for _, r in rows], bool), bits, epochs, decay)
        else:
            w, b, slope, offset = np.zeros(1 << bits, np.float32), 0.0, 0.0, 60.0 if y.any() else -60.0
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "b": [b], "slope": [slope], "offset": [offset]})

    got = (texts.mapInArrow(features, texts.select("_id", "_y", "_half").schema.add("g", "binary"))
           .repartition(1).mapInArrow(learn, "w binary, b double, slope double, offset double").first())
    if got is None:
        return NgramModel(np.zeros(1 << bits, np.float32), 0.0, 0.0, -60.0, sizes, bits)
    return NgramModel(np.frombuffer(got["w"], np.float32), got["b"], got["slope"], got["offset"], sizes, bits)


def _batch_scores(model: NgramModel, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    margins = [model.weights[g].sum(dtype=np.float64) / np.sqrt(max(len(g), 1)) for g in gram_sets(raw, offsets, model.sizes, model.bits)]
    return model.scores(np.array(margins, np.float64))


def toxicity_scores(docs: DataFrame, model: NgramModel, *, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` of every row and its score from 0 to 1. Only those columns and the text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes x 2^bits
    rows = docs.select(packed(keep, "_row"), text_or_empty(text_col).alias("_text"))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(_batch_scores(shared.value, raw, offsets))], ["_row", "_score"])

    scored = rows.mapInArrow(score, StructType([rows.schema["_row"], StructField("_score", DoubleType())]))
    return scored.select(*unpacked(keep, "_row"), F.col("_score").alias(score_col))


def drop_toxic(docs: DataFrame, model: NgramModel, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs.columns, "_row"), text_or_empty(text_col).alias("_text"))

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "_text"):
            yield part.select(["_row"]).filter(pa.array(_batch_scores(shared.value, raw, offsets) < threshold))

    return rows.mapInArrow(clean, StructType([rows.schema["_row"]])).select(*unpacked(docs.columns, "_row"))
