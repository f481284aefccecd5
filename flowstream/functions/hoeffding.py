"""Hoeffding tree pieces in numpy: route a batch, count statistics, merge them, try splits.

Domingos & Hulten 2000 with Gaussian numeric observers. A tree learns from the summed statistics of one
window of rows, so the rows can be counted anywhere and only small arrays meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

SPLIT_POINTS = 10  # fixed value: cut candidates per feature
TOGETHER_TREES = 5  # fewer trees are counted one by one
TOGETHER_VALUES = 2_000_000  # rows x features x classes of the trees counted in one go
_erf = np.vectorize(math.erf, otypes=[float])


class Leaf:
    def __init__(self, classes: int, features: int, prior=None):
        self.prior = np.zeros(classes) if prior is None else prior
        self.n = np.zeros(classes)
        self.s1, self.s2 = np.zeros((classes, features)), np.zeros((classes, features))
        self.lo, self.hi = np.full((classes, features), np.inf), np.full((classes, features), -np.inf)
        self.tried = 0.0
        self.majority_ok = self.bayes_ok = 0.0


class Split:
    def __init__(self, feature: int, cut: float, left, right):
        self.feature, self.cut, self.left, self.right = feature, cut, left, right
        self.history = RateHistory()
        self.alternate = None
        self.race = np.zeros(4)  # rows and errors of the subtree and of its alternate since that began


@dataclass
class LeafCounts:
    """What one batch of rows adds to a leaf."""
    n: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    majority_ok: float
    bayes_ok: float
    rows: float
    errors: float

    def add(self, o: "LeafCounts") -> "LeafCounts":
        return LeafCounts(self.n + o.n, self.s1 + o.s1, self.s2 + o.s2, np.minimum(self.lo, o.lo), np.maximum(self.hi, o.hi),
                          self.majority_ok + o.majority_ok, self.bayes_ok + o.bayes_ok, self.rows + o.rows, self.errors + o.errors)


def leaves(node, path: str = "") -> list[tuple[str, Leaf]]:
    """(path, leaf) pairs; a path is a word of l and r from the root."""
    if isinstance(node, Leaf):
        return [(path, node)]
    return leaves(node.left, path + "l") + leaves(node.right, path + "r")


def route(node, x: np.ndarray, rows: np.ndarray, path: str = "") -> list[tuple[str, Leaf, np.ndarray]]:
    """(path, leaf, row numbers) of every leaf that receives rows."""
    if not len(rows):
        return []
    if isinstance(node, Leaf):
        return [(path, node, rows)]
    left = x[rows, node.feature] <= node.cut
    return route(node.left, x, rows[left], path + "l") + route(node.right, x, rows[~left], path + "r")


def _majority(leaf: Leaf) -> int:
    return int(np.argmax(leaf.n + leaf.prior))


def _bayes(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    seen = np.nonzero(leaf.n > 0)[0]
    if not len(seen):
        return np.full(len(x), _majority(leaf))
    n = leaf.n[seen][:, None]
    mean = leaf.s1[seen] / n
    var = np.maximum(leaf.s2[seen] / n - mean**2, 1e-9)
    logp = np.log(n[:, 0] / n.sum()) - 0.5 * (((x[:, None, :] - mean) ** 2 / var) + np.log(var)).sum(axis=2)
    return seen[np.argmax(logp, axis=1)]


def _uses_bayes(leaf: Leaf, kind: str, nb_threshold: float) -> bool:
    return (kind == "nb" or (kind == "nba" and leaf.bayes_ok > leaf.majority_ok)) and leaf.n.sum() > nb_threshold


def leaf_predict(leaf: Leaf, x: np.ndarray, kind: str, nb_threshold: float = 0) -> np.ndarray:
    return _bayes(leaf, x) if _uses_bayes(leaf, kind, nb_threshold) else np.full(len(x), _majority(leaf))


def predict(root, x: np.ndarray, kind: str, nb_threshold: float = 0) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for _, leaf, rows in route(root, x, np.arange(len(x))):
        out[rows] = leaf_predict(leaf, x[rows], kind, nb_threshold)
    return out


def count(root, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, kind: str, nb_threshold: float = 0,
          inside: str = "", preds: np.ndarray | None = None) -> dict[str, LeafCounts]:
    """Per leaf path: weighted class counts and moments of the batch, and how the leaf would have predicted it.

    ``preds``, if given, takes the tree's prediction of every row.
    """
    out = {}
    for path, leaf, rows in route(root, x, np.arange(len(x)), inside):
        xs, ys, ws = (x, y, w) if len(rows) == len(x) else (x[rows], y[rows], w[rows])
        onehot = (ys[:, None] == np.arange(classes)) * ws[:, None]
        lo, hi = np.full((classes, x.shape[1]), np.inf), np.full((classes, x.shape[1]), -np.inf)
        weighed = ws > 0
        for c in sorted(set(ys[weighed].tolist())):
            mine = xs[(ys == c) & weighed]
            lo[c], hi[c] = mine.min(axis=0), mine.max(axis=0)
        majority = _majority(leaf)
        hits = np.count_nonzero(ys == majority)
        bayes_hits, bayes = hits, majority
        if kind != "majority" and (leaf.n > 0).any():
            bayes = _bayes(leaf, xs)
            bayes_hits = np.count_nonzero(ys == bayes)
        used = _uses_bayes(leaf, kind, nb_threshold)
        if preds is not None:
            preds[rows] = bayes if used else majority
        out[path] = LeafCounts(onehot.sum(axis=0), onehot.T @ xs, onehot.T @ xs**2, lo, hi, float(hits), float(bayes_hits),
                               float(len(ys)), float(len(ys) - (bayes_hits if used else hits)))
    return out


def count_together(trees: Sequence[tuple], x: np.ndarray, y: np.ndarray, classes: int) -> tuple[list[dict[str, LeafCounts]], np.ndarray]:
    """``count`` for many trees in one go: the counts of each tree, and its predictions (0 for rows that it is not given).

    A tree is (root, rows, weights, kind, nb_threshold), with a weight for each row of ``x``. The rows of all leaves lie one behind the other,
    so numpy is called once for all of them; only the sums of products are made leaf by leaf, to be rounded as in ``count``.
    """
    out: list[dict[str, LeafCounts]] = [{} for _ in trees]
    preds = np.zeros((len(trees), len(x)), dtype=np.int64)
    if len(trees) < TOGETHER_TREES or len(y) and (y.min() < 0 or y.max() >= classes):
        for t, (root, rows, w, kind, nb_threshold) in enumerate(trees):
            own = np.zeros(len(rows), dtype=np.int64)
            whole = len(rows) == len(x)
            out[t] = count(root, *((x, y, w) if whole else (x[rows], y[rows], w[rows])), classes, kind, nb_threshold, preds=own)
            preds[t, rows] = own
        return out, preds
    share = max(1, TOGETHER_VALUES // max(1, len(x) * x.shape[1] * classes))
    for first in range(0, len(trees), share):
        found = [(t, path, leaf, rows) for t in range(first, min(first + share, len(trees))) for path, leaf, rows in route(trees[t][0], x, trees[t][1])]
        if found:
            _count_leaves(found, trees, x, y, classes, out, preds)
    return out, preds


def _count_leaves(found: list[tuple], trees: Sequence[tuple], x: np.ndarray, y: np.ndarray, classes: int, out: list[dict], preds: np.ndarray) -> None:
    sizes = [len(rows) for _, _, _, rows in found]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at, leaf_of = np.concatenate([f[3] for f in found]), np.repeat(np.arange(len(found)), sizes)
    tree_of = np.repeat([f[0] for f in found], sizes)
    xs, ys = x[at], y[at]
    ws = np.concatenate([trees[t][2][rows] for t, _, _, rows in found])

    n = np.array([leaf.n for _, _, leaf, _ in found])
    total, seen = n.sum(axis=1), n > 0
    majority = (n + np.array([leaf.prior for _, _, leaf, _ in found])).argmax(axis=1)
    at_least = np.where(seen, n, 1.0)
    mean = np.array([leaf.s1 for _, _, leaf, _ in found]) / at_least[:, :, None]
    var = np.maximum(np.array([leaf.s2 for _, _, leaf, _ in found]) / at_least[:, :, None] - mean**2, 1e-9)
    share = np.log(at_least / np.maximum(total, 1e-300)[:, None])
    logp = share[leaf_of] - 0.5 * (((xs[:, None, :] - mean[leaf_of]) ** 2 / var[leaf_of]) + np.log(var)[leaf_of]).sum(axis=2)
    learned = np.array([trees[t][3] != "majority" for t, _, _, _ in found]) & seen.any(axis=1)
    majority_of = majority[leaf_of]
    bayes = np.where(learned[leaf_of], np.where(seen[leaf_of], logp, -np.inf).argmax(axis=1), majority_of)
    uses = np.array([_uses_bayes(leaf, *trees[t][3:5]) for t, _, leaf, _ in found])
    final = np.where(uses[leaf_of], bayes, majority_of)
    preds[tree_of, at] = final

    onehot = (ys[:, None] == np.arange(classes)) * ws[:, None]
    squares, counted = xs**2, np.add.reduceat(onehot, starts, axis=0)
    hits = np.add.reduceat(np.column_stack([ys == majority_of, ys == bayes, ys != final]).astype(float), starts, axis=0).tolist()
    lo, hi = np.full((len(found) * classes, x.shape[1]), np.inf), np.full((len(found) * classes, x.shape[1]), -np.inf)
    weighed = np.nonzero(ws > 0)[0]
    cell = leaf_of[weighed] * classes + ys[weighed]
    order = np.argsort(cell, kind="stable")
    cells, begins = np.unique(cell[order], return_index=True)
    if len(cells):
        sorted_x = xs[weighed[order]]
        lo[cells], hi[cells] = np.minimum.reduceat(sorted_x, begins, axis=0), np.maximum.reduceat(sorted_x, begins, axis=0)
    for i, (t, path, _, rows) in enumerate(found):
        a, b = starts[i], ends[i]
        weights = onehot[a:b].T
        majority_ok, bayes_ok, errors = hits[i]
        out[t][path] = LeafCounts(counted[i], weights @ xs[a:b], weights @ squares[a:b], lo[i * classes:(i + 1) * classes], hi[i * classes:(i + 1) * classes],
                                  majority_ok, bayes_ok, float(len(rows)), errors)


def _impurity(p: np.ndarray, criterion: str) -> np.ndarray:
    total = p.sum(axis=0)
    f = np.divide(p, total, out=np.zeros_like(p), where=total > 0)
    if criterion == "gini":
        return 1 - (f**2).sum(axis=0)
    return -(f * np.log2(np.maximum(f, 1e-300))).sum(axis=0)


def _merit(left: np.ndarray, right: np.ndarray, criterion: str) -> np.ndarray:
    """Gain of splitting class weights into left and right (first axis: classes)."""
    if criterion == "hellinger":
        a = left[1:].sum(axis=0) / np.maximum((left + right)[1:].sum(axis=0), 1e-12)
        b = left[0] / np.maximum((left + right)[0], 1e-12)
        return np.sqrt((np.sqrt(a) - np.sqrt(b)) ** 2 + (np.sqrt(np.maximum(1 - a, 0)) - np.sqrt(np.maximum(1 - b, 0))) ** 2)
    nl, nr = left.sum(axis=0), right.sum(axis=0)
    n = np.maximum(nl + nr, 1e-12)
    return _impurity(left + right, criterion) - (nl * _impurity(left, criterion) + nr * _impurity(right, criterion)) / n


def _range(criterion: str, classes: int) -> float:
    return {"gini": 1.0, "hellinger": math.sqrt(2)}.get(criterion, math.log2(max(classes, 2)))


def cut_gains(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, lo: np.ndarray, hi: np.ndarray, usable: np.ndarray, criterion: str) -> tuple:
    """Per leaf the best gain (-inf where nothing can be cut), the second feature's, the feature, the cut and the class weights left of it.

    ``usable`` says which features of a leaf (first axis) may be cut.
    """
    seen, mean = n > 0, s1 / np.maximum(n, 1e-12)[:, :, None]
    sd = np.sqrt(np.maximum(s2 / np.maximum(n, 1e-12)[:, :, None] - mean**2, 1e-12))
    lo = np.where(seen[:, :, None], lo, np.inf).min(axis=1)
    hi = np.where(seen[:, :, None], hi, -np.inf).max(axis=1)
    which, features = np.nonzero(usable & (hi > lo) & (seen.sum(axis=1) >= 2)[:, None])
    if not len(which):
        return np.full(len(n), -np.inf), np.zeros(len(n)), np.zeros(len(n), dtype=np.int64), np.zeros(len(n)), np.zeros(n.shape)
    # all cuts of all features of all leaves at once: (class, leaf and feature, cut)
    low, weights = lo[which, features], n[which].T[:, :, None]
    cuts = low[:, None] + (hi[which, features] - low)[:, None] * np.arange(1, SPLIT_POINTS + 1) / (SPLIT_POINTS + 1)
    z = (cuts - mean[which, :, features].T[:, :, None]) / (sd[which, :, features].T[:, :, None] * math.sqrt(2))
    left = weights * 0.5 * (1 + np.fromiter(map(math.erf, z.ravel().tolist()), dtype=float, count=z.size).reshape(z.shape))
    gain = _merit(left, weights - left, criterion)
    at = gain.argmax(axis=1)
    every = np.arange(len(at))
    gains = np.full(lo.shape, -np.inf)
    gains[which, features] = gain[every, at]
    row = np.zeros(lo.shape, dtype=np.int64)
    row[which, features] = every
    leaf, feature = np.arange(len(n)), gains.argmax(axis=1)
    unknown = np.nonzero(np.isnan(gains).any(axis=1))[0]  # features with missing values: only a gain that is less gives way
    for i in unknown.tolist():
        feature[i] = sorted(features[which == i].tolist(), key=lambda k: -gains[i, k])[0]
    best = gains[leaf, feature]
    gains[leaf, feature] = -np.inf
    second = gains.max(axis=1)
    for i in unknown.tolist():
        others = [k for k in features[which == i].tolist() if k != feature[i]]
        second[i] = gains[i, sorted(others, key=lambda k: -gains[i, k])[0]] if others else -np.inf
    j = row[leaf, feature]
    return best, np.where(second == -np.inf, 0.0, second), feature, cuts[j, at[j]], left[:, j, at[j]].T


def split_allowed(gain: np.ndarray, second: np.ndarray, weight: np.ndarray, confidence: np.ndarray, tie: np.ndarray, criterion: str, classes: int) -> np.ndarray:
    """Whether the Hoeffding bound lets leaves of these weights be split."""
    with np.errstate(all="ignore"):
        eps = np.sqrt(_range(criterion, classes) ** 2 * np.log(1 / confidence) / (2 * weight))
        return (gain > 0) & ((gain - np.maximum(second, 0.0) > eps) | (eps < tie))


def best_cuts(leaves: Sequence[Leaf], picks: Sequence[np.ndarray], criterion: str) -> list[tuple | None]:
    """Per leaf what ``cut_gains`` finds over the picked features; None where nothing can be cut."""
    usable = np.zeros((len(leaves), leaves[0].s1.shape[1]), dtype=bool)
    for i, pick in enumerate(picks):
        usable[i, pick] = True
    gain, second, feature, cut, left = cut_gains(*(np.array([getattr(leaf, part) for leaf in leaves]) for part in ("n", "s1", "s2", "lo", "hi")), usable, criterion)
    return [None if g == -np.inf else (g, s, f, c, w) for g, s, f, c, w in zip(gain.tolist(), second.tolist(), feature.tolist(), cut.tolist(), left)]


def split_at(leaf: Leaf, best: tuple | None, criterion: str, confidence: float, tie: float):
    """A Split with two fresh leaves, or the leaf itself when the Hoeffding bound does not allow one."""
    if best is None:
        return leaf
    gain, second, f, cut, left = best
    eps = math.sqrt(_range(criterion, len(leaf.n)) ** 2 * math.log(1 / confidence) / (2 * leaf.n.sum()))
    if gain <= 0 or not (gain - max(second, 0.0) > eps or eps < tie):
        return leaf
    shape = leaf.s1.shape
    return Split(f, cut, Leaf(*shape, prior=left), Leaf(*shape, prior=leaf.n - left))


def try_split(leaf: Leaf, features: np.ndarray, criterion: str, confidence: float, tie: float):
    """The leaf after a look at all cuts of the features, split or as it was."""
    return split_at(leaf, best_cuts([leaf], [features], criterion)[0], criterion, confidence, tie)


BUCKETS = 5  # fixed value: buckets of one size before the two oldest are joined


class RateHistory:
    """Errors per window of a node or member, newest part in full, older windows joined: a bucket of level r holds 2**r windows.

    ADWIN's exponential histogram over (rows, errors) pairs. State and the time of a test grow with the logarithm of
    the windows. Sums are exact; only the places where the history may be cut get coarser with age, so a cut is found
    if a plain list has one at the same place, and then at the same bound.
    """

    def __init__(self) -> None:
        self.levels: list[list[tuple[float, float]]] = [[]]  # per level, oldest first
        self.rows = self.errors = 0.0

    def __len__(self) -> int:
        return sum(len(level) for level in self.levels)

    def add(self, rows: float, errors: float) -> None:
        self.rows, self.errors = self.rows + rows, self.errors + errors
        self.levels[0].append((rows, errors))
        r = 0
        while len(self.levels[r]) > BUCKETS:
            if r + 1 == len(self.levels):
                self.levels.append([])
            (n1, e1), (n2, e2) = self.levels[r][:2]
            self.levels[r] = self.levels[r][2:]
            self.levels[r + 1].append((n1 + n2, e1 + e2))
            r += 1

    def changed(self, delta: float) -> int:
        """How many of the oldest buckets to forget because the rate rose since, else 0."""
        if self.rows <= 1 or len(self) < 2:
            return 0
        p = self.errors / self.rows
        log_term = math.log(2 * math.log(max(self.rows, 3)) / delta)
        n0 = e0 = 0.0
        at, last = 0, len(self) - 1
        for level in reversed(self.levels):
            for n, e in level:
                if at == last:
                    return 0
                at += 1
                n0, e0 = n0 + n, e0 + e
                n1, e1 = self.rows - n0, self.errors - e0
                if n0 < 1 or n1 < 1:
                    continue
                m = 1 / n0 + 1 / n1
                eps = math.sqrt(2 * m * p * (1 - p) * log_term) + 2 / 3 * log_term * m
                if e1 / n1 - e0 / n0 > eps:
                    return at
        return 0

    def forget(self, buckets: int) -> "RateHistory":
        """Drop the oldest buckets."""
        for level in reversed(self.levels):
            while buckets and level:
                n, e = level.pop(0)
                self.rows, self.errors, buckets = self.rows - n, self.errors - e, buckets - 1
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()
        return self


@dataclass
class Member:
    """One tree of a learner with its drift state."""
    root: object
    history: RateHistory = field(default_factory=RateHistory)
    background: object = None
    ok: float = 0.0
    seen: float = 0.0
