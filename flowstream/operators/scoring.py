"""Test-then-train anomaly scoring in windows, and scoring with a model frozen after the warm-up.

A window scorer rates window w with what it learned from the windows before it. Windows are bounded,
so runs of windows are small groups: every row is sent to the run of its own window, to be scored and to train the
next windows, and to the next run if windows there learn from it. One shuffle, no serial state; one stream of any
length spreads over all tasks.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.functions import partitions as part
from flowstream.operators.keyed import _ddl
from flowstream.operators.ordering import BLOCK_ROWS, _keys
from flowstream.operators.steps import run_steps
from flowstream.session import spread_by, written

RUN = 8  # windows that are scored together when models live for several
RUN_ROWS = 8192  # rows of the windows that are scored together when they learn from the rows before them


class Scorer(Protocol):
    """What a pluggable scorer offers. ``window`` rows per window, ``back`` training windows.

    ``score(train, ages, query, rng)``: training rows with their age in windows (1 = the previous window).

    A scorer whose models outlive a window has ``build(train, first, rng)``, which makes the packed model of one window, and
    ``rate(built, query)`` with the models of the ``back`` windows before and their ages. Then each model is made once.

    Where it has them, ``score_windows`` and ``build_windows`` do the work of ``score`` and ``build`` for many windows in one call.
    """

    window: int
    back: int

    def score(self, train: np.ndarray, ages: np.ndarray, query: np.ndarray, rng) -> np.ndarray: ...


# Fixed values below: default parameters of the five scorers.
@dataclass(frozen=True)
class HalfSpaceTrees:
    window: int = 1900
    trees: int = 100
    depth: int = 6
    size_limit: float = 0.05
    anomaly_threshold: float = 0.48
    seed: int = 1
    back = 1

    def score(self, train, ages, query, rng):
        return self.score_windows([train], [ages], [query], [rng])[0]

    def score_windows(self, trains, ages, queries, rngs):
        return part.half_space_scores(trains, queries, self.trees, self.depth, self.size_limit, self.seed)


@dataclass(frozen=True)
class OnlineIsolationForest:
    window: int = 2048
    trees: int = 100
    max_leaf: int = 16
    growth: str = "adaptive"
    subsample: float = 0.9
    branching: int = 4
    seed: int = 1
    back = 1

    def score(self, train, ages, query, rng):
        return self.score_windows([train], [ages], [query], [rng])[0]

    def score_windows(self, trains, ages, queries, rngs):
        full = max(np.log(self.window / self.max_leaf) / np.log(self.branching), 1.0)
        leaf = (lambda level: self.max_leaf * self.branching**level) if self.growth == "adaptive" else (lambda level: self.max_leaf)
        sizes = [len(q) for q in queries]
        total = np.zeros(sum(sizes))
        for _ in range(self.trees):
            samples = [train[rng.random(len(train)) < self.subsample] for train, rng in zip(trains, rngs)]
            depth, size = part.isolation_depths(samples, queries, rngs, int(np.ceil(full)), leaf, self.branching)
            rest = np.log(np.maximum(size, 1) / self.max_leaf) / np.log(self.branching)
            total += depth + np.maximum(rest, 0)
        return np.split(2 ** (-total / self.trees / full), np.cumsum(sizes)[:-1])


@dataclass(frozen=True)
class RandomCutForest:
    tree_size: int = 1000
    trees: int = 100
    seed: int = 42
    back = 1

    @property
    def window(self):
        return self.tree_size

    def score(self, train, ages, query, rng):
        return self.score_windows([train], [ages], [query], [rng])[0]

    def score_windows(self, trains, ages, queries, rngs):
        sizes = [len(q) for q in queries]
        total, rows = np.zeros(sum(sizes)), np.repeat([len(t) for t in trains], sizes)
        for _ in range(self.trees):
            total += part.collusive_displacements(trains, queries, rngs) / rows
        return np.split(total / self.trees, np.cumsum(sizes)[:-1])


@dataclass(frozen=True)
class AdaptiveIsolationForest:
    """Every window grows ``m_trees`` new trees, which replace the oldest of ``trees``; the first window grows all.

    A tree stays as it was grown until it is replaced, and counts ``weights`` times less per window of age.
    """

    window: int = 768
    trees: int = 100
    height: int = 12
    m_trees: int = 30
    weights: float = 0.7
    seed: int = 1

    @property
    def back(self):
        return -(-self.trees // self.m_trees)

    def alive(self, age: int) -> int:
        """How many trees of a window this old are not yet replaced, if that window grew so many."""
        return max(self.trees - (age - 1) * self.m_trees, 0)

    def build(self, train, first, rng):
        """Trees grown on a window's rows, packed; ``first`` marks the first window of a stream."""
        return self.build_windows([train], [first], [rng])[0]

    def build_windows(self, trains, firsts, rngs):
        grown = part.grow_forests(trains, [self.trees if first else min(self.m_trees, self.trees) for first in firsts], rngs, self.height)
        return [g.packed() for g in grown]

    def rate(self, built, query):
        """Scores by the trees still alive; ``built`` holds (age in windows, packed trees)."""
        norm = 2 * (np.log(max(self.window - 1, 2)) + 0.5772156649) - 2
        total, weight = np.zeros(len(query)), 0.0
        for age, blob in sorted(built, key=lambda b: b[0]):
            grown = part.Trees.unpacked(blob)
            used = min(grown.trees, self.alive(age))
            depth, size = grown.depths(query, used)
            rest = np.where(size > 1, 2 * (np.log(np.maximum(size - 1, 1)) + 0.5772156649) - 2 * (size - 1) / np.maximum(size, 1), 0)
            w = self.weights ** (age - 1)
            total += w * (2 ** (-(depth + np.maximum(rest, 0)) / norm)).sum(axis=0)
            weight += w * used
        return total / weight

    def score(self, train, ages, query, rng):
        return self.rate([(1, self.build(train, True, rng))], query)


@dataclass(frozen=True)
class Autoencoder:
    """One hidden layer, trained row by row on the warm-up rows; score 2**(-threshold / error)."""

    hidden: int = 12
    learning_rate: float = 0.0024146
    threshold: float = 0.85
    seed: int = 1
    window = 0
    back = 0

    def fit(self, train, rng):
        k = train.shape[1]
        hidden = min(self.hidden, max(1, k - 1))
        w1, b1 = rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden)
        w2, b2 = rng.normal(0, 1 / np.sqrt(hidden), (hidden, k)), np.zeros(k)
        for x in train:
            h = 1 / (1 + np.exp(-(x @ w1 + b1)))
            y = 1 / (1 + np.exp(-(h @ w2 + b2)))
            dy = (y - x) * y * (1 - y) * 2 / k
            dh = (w2 @ dy) * h * (1 - h)
            w2 -= self.learning_rate * np.outer(h, dy)
            b2 -= self.learning_rate * dy
            w1 -= self.learning_rate * np.outer(x, dh)
            b1 -= self.learning_rate * dh
        return w1, b1, w2, b2

    def apply(self, model, query):
        w1, b1, w2, b2 = model
        y = 1 / (1 + np.exp(-(1 / (1 + np.exp(-(query @ w1 + b1))) @ w2 + b2)))
        error = np.sqrt(((query - y) ** 2).mean(axis=1))
        with np.errstate(divide="ignore"):
            return np.where(error > 0, 2 ** (-self.threshold / error), 0.0)


SCORERS = {
    "HST": ("HalfSpaceTrees", HalfSpaceTrees),
    "OIF": ("OnlineIsolationForest", OnlineIsolationForest),
    "AE": ("Autoencoder", Autoencoder),
    "RRCF": ("RobustRandomCutForest", RandomCutForest),
    "AIF": ("AdaptiveIsolationForest", AdaptiveIsolationForest),
}


def scorers(names: Sequence[str] | None = None, overrides: dict[str, dict] | None = None) -> dict[str, Scorer]:
    """Configured scorers by algorithm name; an unknown parameter is an error."""
    overrides = overrides or {}
    out = {}
    for short in names or SCORERS:
        name, kind = SCORERS[short]
        unknown = set(overrides.get(short, {})) - {f.name for f in fields(kind)}
        if unknown:
            raise TypeError(f"{short} has no parameter {sorted(unknown)}")
        out[name] = replace(kind(), **overrides.get(short, {}))
    return out


def _rng(seed: int, *parts):
    return np.random.default_rng([seed, zlib.crc32(repr(parts).encode())])


def _plain(key) -> tuple:
    return tuple(str(k) for k in key)


def _run_windows(scorer) -> int:
    """How many windows are worked on together."""
    return max(1, RUN_ROWS // scorer.window)


def _places(windows: np.ndarray) -> dict[int, slice]:
    """Where the rows of each window stand; they stand window after window."""
    ids, starts = np.unique(windows, return_index=True)
    return {int(w): slice(a, b) for w, a, b in zip(ids, starts, [*starts[1:], len(windows)])}


def window_models(df: DataFrame, features: Sequence[str], scorer, keys=None, seq: str = "seq") -> DataFrame:
    """The model of every window, made once: (keys, window, model). A model is used until later windows replace it."""
    keys = _keys(keys)
    rows = df.select(*keys, seq, *[F.col(c).cast("double").alias(c) for c in features if c not in (*keys, seq)], F.expr(f"`{seq}` div {scorer.window}").alias("window"))
    rows = rows.withColumn("_run", F.expr(f"window div {_run_windows(scorer)}"))

    def make(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window", seq])
        x, places = pdf[list(features)].to_numpy(dtype=float), _places(pdf["window"].to_numpy())
        work = [(x[at], w == 0, _rng(scorer.seed, *_plain((*key[:-1], w)))) for w, at in places.items()]
        blobs = scorer.build_windows(*map(list, zip(*work))) if hasattr(scorer, "build_windows") else [scorer.build(*part) for part in work]
        return pd.DataFrame([{**dict(zip(keys, key)), "window": w, "model": blob} for w, blob in zip(places, blobs)])

    by = [*keys, "_run"]
    return spread_by(rows, by).groupBy(*by).applyInPandas(make, ", ".join(filter(None, [_ddl(df, keys), "window long, model binary"])))


def _scores_of_models(df: DataFrame, features: Sequence[str], scorer, keys: list[str], seq: str, keep: Sequence[str]) -> DataFrame:
    """Scores by models that live for several windows. Rows and models meet in runs of ``RUN`` windows, so
    a model is sent to few places only."""
    carried = list(dict.fromkeys([*keys, seq, *keep]))
    rows = df.select(*carried, *[F.col(c).cast("double").alias(c) for c in features if c not in carried], F.expr(f"`{seq}` div {scorer.window}").alias("_w"))
    rows = rows.withColumn("_run", F.expr(f"_w div {RUN}"))
    models = written(window_models(df, features, scorer, keys, seq), "models")
    used_in = F.sequence(F.expr(f"(window + 1) div {RUN}"), F.expr(f"(window + {scorer.back}) div {RUN}"))
    models = models.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "window", "model", F.explode(used_in).alias("_to"))

    def run(key, pdf: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_w", seq])
        x, score = pdf[list(features)].to_numpy(dtype=float), np.full(len(pdf), np.nan)
        built = dict(zip(made["window"].astype(int), made["model"]))
        for w, at in _places(pdf["_w"].to_numpy()).items():
            known = [(age, built[w - age]) for age in range(1, scorer.back + 1) if w - age in built]
            if known:
                score[at] = scorer.rate(known, x[at])
        return pdf[carried].assign(score=score)

    left, right = [*keys, "_run"], [*[f"_k{i}" for i in range(len(keys))], "_to"]
    both = spread_by(rows, left).groupBy(*left).cogroup(spread_by(models, right).groupBy(*right))
    return both.applyInPandas(run, f"{_ddl(df, carried)}, score double")


def window_scores(df: DataFrame, features: Sequence[str], scorer: Scorer, keys=None, seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """Score of every row by the windows before its own; rows of the first window have no score (null)."""
    keys = _keys(keys)
    if hasattr(scorer, "build"):
        return _scores_of_models(df, features, scorer, keys, seq, keep)
    carried = list(dict.fromkeys([*keys, seq, *keep]))
    per_run = _run_windows(scorer)
    rows = df.select(*carried, *[F.col(c).cast("double").alias(c) for c in features if c not in carried], F.expr(f"`{seq}` div {scorer.window}").alias("_w"))
    # the runs that score a row or learn from it
    rows = rows.withColumn("_run", F.explode(F.sequence(F.expr(f"_w div {per_run}"), F.expr(f"(_w + {scorer.back}) div {per_run}"))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_w", seq])
        windows = pdf["_w"].to_numpy()
        x, score, places = pdf[list(features)].to_numpy(dtype=float), np.full(len(pdf), np.nan), _places(windows)
        mine = windows // per_run == key[-1]
        at, work = [], []
        for w, here in places.items():
            known = [(age, x[places[w - age]]) for age in range(1, scorer.back + 1) if w - age in places]
            if w // per_run == key[-1] and known:
                at.append(here)
                ages = np.repeat([age for age, _ in known], [len(rows) for _, rows in known])
                work.append((np.concatenate([rows for _, rows in known]), ages, x[here], _rng(scorer.seed, *_plain((*key[:-1], w)))))
        if work:
            got = scorer.score_windows(*map(list, zip(*work))) if hasattr(scorer, "score_windows") else [scorer.score(*part) for part in work]
            for here, values in zip(at, got):
                score[here] = values
        return pdf.loc[mine, carried].assign(score=score[mine])

    by = [*keys, "_run"]
    return spread_by(rows, by).groupBy(*by).applyInPandas(run, f"{_ddl(df, carried)}, score double")


def freeze_after_warmup(df: DataFrame, features: Sequence[str], scorer, warmup: int, keys=None, seq: str = "seq",
                        keep: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Train on the first ``warmup`` rows of each stream only, then score every row with that model.

    The model of a stream goes to each of its row blocks, so scoring is parallel also within a stream. For
    window scorers the model is the bounded slice of warm-up rows itself. Warm-up 0 leaves nothing learned, hence no score.
    """
    keys = _keys(keys)
    carried = list(dict.fromkeys([*keys, seq, *keep]))
    rows = df.select(*carried, *[F.col(c).cast("double").alias(c) for c in features if c not in carried])
    rows = rows.withColumn("_blk", F.expr(f"`{seq}` div {block_rows}"))
    by = keys or ["_one"]  # without keys the whole table is one stream
    if not keys:
        rows = rows.withColumn("_one", F.lit(0))
    out_schema = f"{_ddl(df, carried)}, score double"

    def train(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(seq)[list(features)].to_numpy(dtype=float)
        model = scorer.fit(x, _rng(scorer.seed, *_plain(key))) if hasattr(scorer, "fit") else x
        return pd.DataFrame([{**dict(zip(by, key)), "model": pickle.dumps(model)}])

    def rate(blob, key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        out = pdf[carried]
        if pdf.empty or blob is None:
            return out.assign(score=np.nan)
        model = pickle.loads(blob)
        x = pdf[list(features)].to_numpy(dtype=float)
        if hasattr(scorer, "apply"):
            return out.assign(score=scorer.apply(model, x))
        return out.assign(score=scorer.score(model, np.ones(len(model), dtype=int), x, _rng(scorer.seed, *_plain(key[:-1]))))

    models = rows.filter(F.col(seq) < warmup).groupBy(*by).applyInPandas(train, f"{_ddl(rows, by)}, model binary")
    if not keys:
        # a single model: it travels with the task
        first = models.first()
        blob = bytes(first["model"]) if first else None

        def score_block(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return rate(blob, (0, *key), pdf)

        return spread_by(rows, ["_blk"]).groupBy("_blk").applyInPandas(score_block, out_schema)

    def score(key, pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        return rate(None if given.empty else given["model"].iloc[0], key, pdf)

    by_block = [*by, "_blk"]
    given = models.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "model")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]  # a null key is a stream too
    spread = rows.select(*by_block).distinct().join(given, same)
    spread = spread.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by_block)], "model")
    left = spread_by(rows, by_block).groupBy(*by_block)
    right = spread_by(spread, [f"_m{i}" for i in range(len(by_block))]).groupBy(*[f"_m{i}" for i in range(len(by_block))])
    return left.cogroup(right).applyInPandas(score, out_schema)


def prequential_score(df: DataFrame, features: Sequence[str], algorithms: dict[str, Scorer], warmup: int = 0, keys=None, seq: str = "seq",
                      keep: Sequence[str] = (), frozen: bool = False) -> DataFrame:
    """Scores of several algorithms over the same streams: (keys, algorithm, seq, score, kept columns).

    Scorers without windows (the autoencoder) and all scorers of a frozen run learn from the warm-up rows only. Plug-ins
    with a ``step`` (see ``flowstream.operators.steps``) score and learn row by row, all in one pass; they can't be frozen.
    """
    parts = []
    stepping = {name: s for name, s in algorithms.items() if hasattr(s, "step")}
    if stepping:
        if frozen:
            raise ValueError(f"a step plug-in has no frozen form: {sorted(stepping)}")
        parts.append(run_steps(df, stepping, keys, seq, keep, features))
    for name, scorer in algorithms.items():
        if name in stepping:
            continue
        if frozen or not scorer.window:
            got = freeze_after_warmup(df, features, scorer, warmup, keys, seq, keep)
        else:
            got = window_scores(df, features, scorer, keys, seq, keep)
        parts.append(got.withColumn("algorithm", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
