"""Hoeffding trees of many short streams in shared arrays: one window of every stream is counted, learned and watched for drift at a time.

The rules are those of ``hoeffding`` and of the members in ``operators.learners``; here nodes, leaf statistics and error histories of all
trees lie in arrays, so a window costs no calls per tree. What a stream's trees learn does not depend on the streams beside it.
Subtree drift and a limit of leaves are not offered here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from flowstream.functions.hoeffding import BUCKETS, cut_gains, split_allowed


class Histories:
    """``RateHistory`` of many trees: buckets by (tree, level, place), the oldest of a level first."""

    def __init__(self, trees: int):
        self.n, self.e = np.zeros((trees, 1, BUCKETS + 1)), np.zeros((trees, 1, BUCKETS + 1))
        self.held = np.zeros((trees, 1), dtype=np.int64)

    def add(self, trees: np.ndarray, n: np.ndarray, e: np.ndarray) -> None:
        level = 0
        while len(trees):
            if level == self.held.shape[1]:
                self.n, self.e = (np.concatenate([a, np.zeros_like(a[:, :1])], axis=1) for a in (self.n, self.e))
                self.held = np.concatenate([self.held, np.zeros_like(self.held[:, :1])], axis=1)
            at = self.held[trees, level]
            self.n[trees, level, at], self.e[trees, level, at] = n, e
            self.held[trees, level] = at + 1
            trees = trees[at + 1 > BUCKETS]
            n, e = (a[trees, level, 0] + a[trees, level, 1] for a in (self.n, self.e))
            for a in (self.n, self.e):
                a[trees, level, :-2], a[trees, level, -2:] = a[trees, level, 2:], 0.0
            self.held[trees, level] -= 2
            level += 1

    def changed(self, trees: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """How many of the oldest buckets each tree is to forget because its rate rose since, else 0."""
        n, e = (a[trees, ::-1].reshape(len(trees), -1) for a in (self.n, self.e))
        held = (np.arange(BUCKETS + 1) < self.held[trees, ::-1, None]).reshape(len(trees), -1)
        n0, e0, at = n.cumsum(axis=1), e.cumsum(axis=1), held.cumsum(axis=1)
        rows, errors = n0[:, -1:], e0[:, -1:]
        with np.errstate(all="ignore"):
            n1, e1, p = rows - n0, errors - e0, errors / rows
            log_term = np.log(2 * np.log(np.maximum(rows, 3)) / delta[:, None])
            m = 1 / n0 + 1 / n1
            eps = np.sqrt(2 * m * p * (1 - p) * log_term) + 2 / 3 * log_term * m
            risen = held & (at < at[:, -1:]) & (n0 >= 1) & (n1 >= 1) & (rows > 1) & (e1 / n1 - e0 / n0 > eps)
        first = risen.argmax(axis=1)
        every = np.arange(len(trees))
        return np.where(risen[every, first], at[every, first], 0)

    def forget(self, tree: int, buckets: int) -> None:
        for level in range(self.held.shape[1] - 1, -1, -1):
            gone = min(buckets, int(self.held[tree, level]))
            if gone:
                for a in (self.n, self.e):
                    a[tree, level] = np.concatenate([a[tree, level, gone:], np.zeros(gone)])
                self.held[tree, level] -= gone
                buckets -= gone

    def clear(self, tree: int) -> None:
        self.n[tree], self.e[tree], self.held[tree] = 0.0, 0.0, 0


class Grove:
    """The trees of ``streams`` streams, one for each configured member; ``members`` are (learner's number, learner, member's number)."""

    def __init__(self, streams: int, members: Sequence[tuple], classes: int, features: int, weights: Callable, pick: Callable):
        self.members, self.classes, self.features, self.weights, self.pick = list(members), classes, features, weights, pick
        self.m, self.trees = len(members), streams * len(members)
        per = lambda name: np.tile([getattr(cfg, name) for _, cfg, _ in members], streams)
        self.grace, self.confidence, self.tie, self.criterion = per("grace"), per("confidence"), per("tie"), per("criterion")
        self.nb_threshold, self.leaf = per("nb_threshold"), per("leaf")
        self.delta, self.warning_delta, self.background_on = per("delta"), per("warning_delta"), per("background")
        self.watched = (per("drift") == "member") & per("drift_detection")
        self.ok, self.seen = np.zeros(self.trees), np.zeros(self.trees)
        self.history = Histories(self.trees)
        self.nodes, room = 0, 4 * self.trees
        shape = (room, classes, features)
        self.feature, self.cut = np.full(room, -1), np.zeros(room)
        self.left, self.right, self.tree = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
        self.depth, self.code = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)  # of the path from the root
        self.n, self.prior = np.zeros(shape[:2]), np.zeros(shape[:2])
        self.s1, self.s2, self.lo, self.hi = np.zeros(shape), np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)
        self.tried, self.majority_ok, self.bayes_ok = np.zeros(room), np.zeros(room), np.zeros(room)
        self.root = self._new(np.arange(self.trees))
        self.background = np.full(self.trees, -1)

    _OF_NODES = ("feature", "cut", "left", "right", "tree", "depth", "code", "n", "prior", "s1", "s2", "lo", "hi", "tried", "majority_ok", "bayes_ok")

    def _new(self, trees: np.ndarray) -> np.ndarray:
        """Fresh leaves of the trees."""
        end = self.nodes + len(trees)
        if end > len(self.feature):
            for name in self._OF_NODES:
                old = getattr(self, name)
                fill = {"feature": -1, "lo": np.inf, "hi": -np.inf}.get(name, 0)
                setattr(self, name, np.concatenate([old, np.full((max(end, 2 * len(old)) - len(old), *old.shape[1:]), fill, dtype=old.dtype)]))
        out = np.arange(self.nodes, end)
        self.tree[out], self.nodes = trees, end
        return out

    def _route(self, node: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The leaf of every (row, tree) from the tree's root."""
        node = node.copy()
        open_ = np.nonzero(self.feature[node] >= 0)[0]
        while len(open_):
            at = node[open_]
            node[open_] = np.where(x[row[open_], self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            open_ = open_[self.feature[node[open_]] >= 0]
        return node

    def window(self, streams: np.ndarray, sizes: np.ndarray, number: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The next window of some streams, their rows one after the other: predictions by learner, made before the trees learn from it."""
        r, m = len(x), self.m
        stream_of = np.repeat(streams, sizes)
        trees = (stream_of[:, None] * m + np.arange(m)).ravel()
        rows = np.repeat(np.arange(r), m)
        w = np.empty((r, m))
        for learner in dict.fromkeys(l for l, _, _ in self.members):
            mine = [j for j, (l, _, _) in enumerate(self.members) if l == learner]
            w[:, mine] = self.weights(self.members[mine[0]][1], np.array([self.members[j][2] for j in mine])[None, :], at[:, None])
        w = w.ravel()
        also = np.nonzero(self.background[trees] >= 0)[0]
        node = self._route(np.concatenate([self.root[trees], self.background[trees[also]]]), x, np.concatenate([rows, rows[also]]))
        final, wrong = self._count(node, np.concatenate([rows, rows[also]]), np.concatenate([w, w[also]]), x, y)

        pred = final[:r * m].reshape(r, m)
        share = np.divide(self.ok, self.seen, out=np.ones(self.trees), where=self.seen > 0)
        out = []
        for learner in dict.fromkeys(l for l, _, _ in self.members):
            votes = np.zeros((r, self.classes))
            for j, (l, cfg, _) in enumerate(self.members):
                if l == learner:
                    votes[np.arange(r), pred[:, j]] += share[stream_of * m + j] if cfg.weighted_vote else 1.0
            out.append(votes.argmax(axis=1).astype(np.int32))

        active = (streams[:, None] * m + np.arange(m)).ravel()
        errors = np.bincount(trees, weights=wrong[:r * m], minlength=self.trees)[active]
        n = np.repeat(sizes, m).astype(float)
        self.ok[active], self.seen[active] = self.ok[active] + n - errors, self.seen[active] + n
        numbers = np.zeros(self.trees, dtype=np.int64)
        numbers[active] = np.repeat(number, m)
        self._split(node, numbers)
        self._drift(active, n, errors)
        return out

    def _count(self, node: np.ndarray, row: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the rows to their leaves: the prediction of the leaf as it stood before, and whether it was wrong, of every pair."""
        c, f = self.classes, self.features
        touched = np.zeros(self.nodes, dtype=bool)
        touched[node] = True
        leaf = np.nonzero(touched)[0]
        place = np.zeros(self.nodes, dtype=np.int64)
        place[leaf] = np.arange(len(leaf))
        of = place[node]
        xs, ys = [v[row] for v in np.ascontiguousarray(x.T)], y[row]
        n = self.n[leaf]
        seen = n > 0
        majority = (n + self.prior[leaf]).argmax(axis=1)
        at_least = np.where(seen, n, 1.0)
        total = n.sum(axis=1)
        mean = self.s1[leaf] / at_least[:, :, None]
        var = np.maximum(self.s2[leaf] / at_least[:, :, None] - mean**2, 1e-9)
        share = np.log(at_least / np.maximum(total, 1e-300)[:, None])
        moments = np.ascontiguousarray(np.stack([mean, var, np.log(var)]).transpose(0, 2, 3, 1))
        logp = np.empty((len(of), c))
        for i in range(c):
            far = 0.0
            for j in range(f):
                centre, spread, log = (a[of] for a in moments[:, i, j])
                centre -= xs[j]
                far += centre**2 / spread + log
            logp[:, i] = np.where(seen[:, i], share[:, i], -np.inf)[of] - 0.5 * far
        kind = self.leaf[self.tree[leaf]]
        learned = (kind != "majority") & seen.any(axis=1)
        majority_of = majority[of]
        bayes = np.where(learned[of], logp.argmax(axis=1), majority_of)
        uses = ((kind == "nb") | (kind == "nba") & (self.bayes_ok[leaf] > self.majority_ok[leaf])) & (total > self.nb_threshold[self.tree[leaf]])
        final = np.where(uses[of], bayes, majority_of)

        k = len(leaf)
        cell = of * c + ys
        counted = np.bincount(cell, weights=w, minlength=k * c).reshape(k, c)
        self.n[leaf] += counted
        weighed = np.nonzero(w > 0)[0]
        some = cell[weighed]
        for j in range(f):
            v = xs[j]
            self.s1[leaf, :, j] += np.bincount(cell, weights=w * v, minlength=k * c).reshape(k, c)
            self.s2[leaf, :, j] += np.bincount(cell, weights=w * v**2, minlength=k * c).reshape(k, c)
            for held, smaller, none in ((self.lo, np.minimum, np.inf), (self.hi, np.maximum, -np.inf)):
                ends = np.full(k * c, none)
                smaller.at(ends, some, v[weighed])
                held[leaf, :, j] = smaller(held[leaf, :, j], ends.reshape(k, c))
        self.majority_ok[leaf] += np.bincount(of, weights=ys == majority_of, minlength=k)
        self.bayes_ok[leaf] += np.bincount(of, weights=ys == bayes, minlength=k)
        return final, (ys != final).astype(float)

    def _split(self, node: np.ndarray, numbers: np.ndarray) -> None:
        """Splits the leaves among ``node`` that have seen enough and that the Hoeffding bound allows to split."""
        touched = np.zeros(self.nodes, dtype=bool)
        touched[node] = True
        leaf = np.nonzero(touched)[0]
        weight = self.n[leaf].sum(axis=1)
        tree = self.tree[leaf]
        due = weight - self.tried[leaf] >= self.grace[tree]
        leaf, weight, tree = leaf[due], weight[due], tree[due]
        self.tried[leaf] = weight
        for criterion in dict.fromkeys(self.criterion[tree].tolist()):
            of = self.criterion[tree] == criterion
            mine, owner = leaf[of], tree[of]
            usable = np.array([self.pick(self.members[t % self.m][1], self.members[t % self.m][2], w, d, code, self.features)
                               for t, w, d, code in zip(owner.tolist(), numbers[owner].tolist(), self.depth[mine].tolist(), self.code[mine].tolist())])
            gain, second, feature, cut, left = cut_gains(self.n[mine], self.s1[mine], self.s2[mine], self.lo[mine], self.hi[mine], usable, criterion)
            go = split_allowed(gain, second, weight[of], self.confidence[owner], self.tie[owner], criterion, self.classes)
            mine, owner, feature, cut, left = mine[go], owner[go], feature[go], cut[go], left[go]
            if not len(mine):
                continue
            first, other = self._new(owner), self._new(owner)
            self.prior[first], self.prior[other] = left, self.n[mine] - left
            for new, step in ((first, ord("l")), (other, ord("r"))):
                self.depth[new] = self.depth[mine] + 1
                self.code[new] = self.code[mine] + step * (self.depth[mine] + 1)
            self.feature[mine], self.cut[mine], self.left[mine], self.right[mine] = feature, cut, first, other

    def _drift(self, active: np.ndarray, n: np.ndarray, errors: np.ndarray) -> None:
        """Members whose errors rose are replaced, or given a tree in the background."""
        watched = self.watched[active]
        mine = active[watched]
        if not len(mine):
            return
        self.history.add(mine, n[watched], errors[watched])
        old = self.history.changed(mine, self.delta[mine])
        warned = mine[(old == 0) & self.background_on[mine] & (self.background[mine] < 0)]
        warned = warned[self.history.changed(warned, self.warning_delta[warned]) > 0] if len(warned) else warned
        for t, buckets in zip(mine[old > 0].tolist(), old[old > 0].tolist()):
            self.history.forget(t, buckets)
        gone = mine[old > 0]
        stands_by = self.background_on[gone] & (self.background[gone] >= 0)
        self.root[gone[stands_by]] = self.background[gone[stands_by]]
        self.root[gone[~stands_by]] = self._new(gone[~stands_by])
        self.background[gone], self.ok[gone], self.seen[gone] = -1, 0.0, 0.0
        self.background[warned] = self._new(warned)

    def replace(self, tree: int) -> None:
        """Starts a tree anew, with an error history of its own."""
        self.root[tree], self.background[tree], self.ok[tree], self.seen[tree] = self._new(np.array([tree]))[0], -1, 0.0, 0.0
        self.history.clear(tree)
