"""Small numpy helpers for the window scorers: random space partitions of at most a few windows of rows.

A forest that serves one window only is never stored: training and query rows walk down a tree together while it is drawn,
and a query row only needs where it stops. Trees that outlive their window are grown once and packed (``grow_forests``).

Windows come as lanes: many are worked on level by level in the same arrays, as a window of a few hundred rows alone takes
longer to call numpy than to compute. Nodes and rows stand lane after lane, and each lane draws from its own generator
what it would draw alone, so results do not depend on the lanes beside it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

TABLE_DEPTH = 12  # up to this depth the nodes of a tree are tabulated
LEHMER = 2_147_483_647  # fixed value: modulus of the node hash


def node_hash(seed: int, tree: int, node: np.ndarray) -> np.ndarray:
    """Number in [0, LEHMER) per tree node, by integer arithmetic that SQL can repeat."""
    first = (seed * 1_299_709 + tree * 7_919 + node.astype(np.int64) * 104_729 + 17) * 48_271 % LEHMER
    return (first + node * 40_503) * 69_621 % LEHMER


def _start_ranges(seed: int, tree: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    s = node_hash(seed + 1, tree, np.arange(k)) / LEHMER
    reach = 2 * np.maximum(s, 1 - s)
    return s - reach, s + reach


@lru_cache(maxsize=2048)
def _half_space_table(seed: int, tree: int, depth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of every inner node of one shallow tree. The shape does not depend on data,
    so a worker makes it once for all windows."""
    feature, cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
    lo, hi = (r[None, :] for r in _start_ranges(seed, tree, k))
    for level in range(depth):
        nodes = np.arange(1 << level, 2 << level)
        f = node_hash(seed, tree, nodes) % k
        at = np.arange(len(nodes))
        c = (lo[at, f] + hi[at, f]) / 2
        feature[nodes], cut[nodes] = f, c
        lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
        hi[2 * at, f], lo[2 * at + 1, f] = c, c
    return feature, cut


def _half_space_steps(x: np.ndarray, seed: int, tree: int, depth: int):
    """Node of every row at levels 0, 1, ..., depth."""
    rows, k = np.arange(len(x)), x.shape[1]
    node = np.ones(len(x), dtype=np.int64)
    yield node
    if depth <= TABLE_DEPTH:
        feature, cut = _half_space_table(seed, tree, depth, k)
        for _ in range(depth):
            node = 2 * node + (_picked(x, feature.take(node)) >= cut.take(node))
            yield node
        return
    # deep trees have more nodes than rows: follow each row's own work range
    lo, hi = (np.tile(r, (len(x), 1)) for r in _start_ranges(seed, tree, k))
    for _ in range(depth):
        f = node_hash(seed, tree, node) % k
        cut = (lo[rows, f] + hi[rows, f]) / 2
        right = x[rows, f] >= cut
        lo[rows[right], f[right]] = cut[right]
        hi[rows[~right], f[~right]] = cut[~right]
        node = 2 * node + right
        yield node


def _cut_up(values: np.ndarray, sizes) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def half_space_scores(trains: list[np.ndarray], queries: list[np.ndarray], trees: int, depth: int, size_limit: float, seed: int) -> list[np.ndarray]:
    """Half-space trees: mass of the previous window's rows where a query row stops, times 2**level.

    A node halves the current work range of a hash-chosen feature. The sum over trees S becomes
    1 / (1 + S / (trees * rows)): 1/2 at uniform density, towards 1 in empty regions.
    """
    lanes, t_sizes, q_sizes = len(trains), [len(t) for t in trains], [len(q) for q in queries]
    t_lane, q_lane = np.repeat(np.arange(lanes), t_sizes), np.repeat(np.arange(lanes), q_sizes)
    n = np.array(t_sizes)[q_lane]
    limit = size_limit * n
    both = np.vstack([*trains, *queries])
    cut = len(t_lane)
    total = np.zeros(len(q_lane))
    for tree in range(trees):
        open_ = np.ones(len(q_lane), dtype=bool)
        for level, node in enumerate(_half_space_steps(both, seed, tree, depth)):
            if level <= TABLE_DEPTH:
                count, place = 1 << level, node - (1 << level)
            else:
                ids, place = np.unique(node, return_inverse=True)
                count = len(ids)
            mass = np.bincount(t_lane * count + place[:cut], minlength=lanes * count)[q_lane * count + place[cut:]]
            stop = open_ & ((mass <= limit) | (level == depth))
            total[stop] += mass[stop] * 2.0**level
            open_ &= ~stop
            if not open_.any():
                break
    return _cut_up(1 / (1 + total / (trees * n)), q_sizes)


def _uniform(rngs, sizes) -> np.ndarray:
    """Uniform numbers, ``sizes`` of them from each lane's generator."""
    sizes = sizes.tolist()
    out, at = np.empty(sum(sizes)), 0
    for rng, n in zip(rngs, sizes):
        if n:
            rng.random(out=out[at:at + n])
            at += n
    return out


def _features(rngs, k: int, sizes) -> np.ndarray:
    """Features drawn at random, ``sizes`` of them from each lane's generator."""
    return np.concatenate([rng.integers(0, k, n) for rng, n in zip(rngs, sizes.tolist()) if n])


def _boxes(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corner per node; rows stand node after node, and every node holds a row."""
    starts = np.cumsum(sizes) - sizes
    return np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)


def _row_sums(x: np.ndarray) -> np.ndarray:
    """``x.sum(axis=1)``, faster for a few columns; the same to the last bit."""
    if x.shape[1] >= 8:
        return x.sum(axis=1)
    total = x[:, 0].copy()
    for j in range(1, x.shape[1]):
        total += x[:, j]
    return total


def _picked(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of every row the value of feature ``f``."""
    return x.ravel().take(np.arange(0, x.size, x.shape[1]) + f)


def _into_children(x: np.ndarray, child: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows put in order of their child node, and how many each of the ``count`` children holds."""
    order = np.argsort(child.astype(np.min_scalar_type(count)), kind="stable")  # short numbers are sorted by their digits
    return x.take(order, axis=0), np.bincount(child, minlength=count)


def _above(values: np.ndarray, cuts: np.ndarray, node: np.ndarray) -> np.ndarray:
    """How many of its node's cuts each value is above."""
    total = np.zeros(len(values), dtype=np.int64)
    for j in range(cuts.shape[1]):
        total += values > cuts[:, j].take(node)
    return total


def isolation_depths(trains: list[np.ndarray], queries: list[np.ndarray], rngs, limit: int, leaf, branching: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Level and training rows of the node where each query row stops in one random tree per lane; lanes joined.

    ``leaf(level)`` is the node size from which a node splits: a random feature of the node's box is cut at
    ``branching - 1`` uniform values.
    """
    lanes, k = len(trains), trains[0].shape[1]
    t_sizes, q_sizes = np.array([len(t) for t in trains]), np.array([len(q) for q in queries])
    query = np.concatenate(queries)
    depth, size = np.zeros(len(query)), np.repeat(t_sizes, q_sizes).astype(float)
    x, sizes, lane = np.concatenate(trains), t_sizes, np.arange(lanes)
    q_rows, q_node = np.arange(len(query)), np.repeat(lane, q_sizes)
    if not t_sizes.all():
        kept = sizes > 0
        on = kept[q_node]
        q_rows, q_node = q_rows[on], (np.cumsum(kept) - 1)[q_node[on]]
        sizes, lane = sizes[kept], lane[kept]
    for level in range(limit + 1):
        needed = np.bincount(lane[q_node], minlength=lanes) > 0  # a lane ends with its query rows
        if not needed.any():
            break
        kept = needed[lane]
        if not kept.all():
            x, q_node = x.compress(np.repeat(kept, sizes), axis=0), (np.cumsum(kept) - 1)[q_node]
            sizes, lane = sizes[kept], lane[kept]
        lo, hi = _boxes(x, sizes)
        depth[q_rows], size[q_rows] = level, sizes[q_node]
        at, f = np.arange(len(sizes)), _features(rngs, k, np.bincount(lane, minlength=lanes))
        low = _picked(lo, f)
        width = _picked(hi, f) - low
        split = (sizes >= max(leaf(level), 2)) & (width > 0)
        if level == limit or not split.any():
            break
        goes_on = np.bincount(lane[split], minlength=lanes) > 0
        drawn = goes_on[lane]
        cuts = np.zeros((len(sizes), branching - 1))
        cuts[drawn] = low[drawn, None] + _uniform(rngs, np.bincount(lane[drawn], minlength=lanes) * (branching - 1)).reshape(-1, branching - 1) * width[drawn, None]
        first = (np.cumsum(split) - 1) * branching  # first child of each node that splits
        live, node = np.repeat(split, sizes), np.repeat(at[split], sizes[split])
        x = x.compress(live, axis=0)
        child = first[node] + _above(_picked(x, f[node]), cuts, node)
        on = split[q_node]
        q_rows, q_node = q_rows[on], q_node[on]
        q_child = first[q_node] + _above(query.ravel().take(q_rows * k + f[q_node]), cuts, q_node)
        x, held = _into_children(x, child, int(split.sum()) * branching)
        full = held > 0
        lane, sizes = np.repeat(lane[split], branching)[full], held[full]
        known = full[q_child]
        depth[q_rows[~known]], size[q_rows[~known]] = level + 1, 0
        q_rows, q_node = q_rows[known], (np.cumsum(full) - 1)[q_child[known]]
    return depth, size


@dataclass(frozen=True)
class Trees:
    """Binary trees, level after level and within a level tree after tree. Children of the i-th inner node are
    nodes ``trees + 2 * i`` and the next one, so only inner nodes' cuts and leaves' sizes are kept."""

    trees: int
    inner: np.ndarray    # per node: has children
    feature: np.ndarray  # per inner node
    cut: np.ndarray      # per inner node; rows above go right
    size: np.ndarray     # per leaf: training rows in it

    def packed(self) -> bytes:
        head = np.array([self.trees, len(self.inner), len(self.cut)], dtype=np.int64).tobytes()
        body = np.packbits(self.inner).tobytes() + self.feature.astype(np.uint16).tobytes() + self.cut.astype(np.float64).tobytes() + self.size.astype(np.uint32).tobytes()
        return zlib.compress(head + body, 1)

    @staticmethod
    def unpacked(blob: bytes) -> "Trees":
        raw = zlib.decompress(blob)
        trees, nodes, inner = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24 + -(-nodes // 8)
        flags = np.unpackbits(np.frombuffer(raw, np.uint8, at - 24, 24), count=nodes).astype(bool)
        feature = np.frombuffer(raw, np.uint16, inner, at).astype(np.int64)
        cut = np.frombuffer(raw[at + 2 * inner:at + 10 * inner], np.float64)
        size = np.frombuffer(raw[at + 10 * inner:], np.uint32).astype(np.int64)
        return Trees(trees, flags, feature, cut, size)

    def depths(self, query: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Level and size of the leaf of every query row in each of the ``first`` trees: arrays trees x rows."""
        rank = np.cumsum(self.inner) - 1
        n, k = query.shape
        flat = np.ascontiguousarray(query).ravel()
        leaf, depth = np.repeat(np.arange(first), n), np.zeros(first * n, dtype=np.int64)
        at = np.flatnonzero(self.inner[leaf])
        node, start, level = leaf[at], at % n * k, 0
        while len(at):
            i = rank[node]
            node = self.trees + 2 * i + (flat[start + self.feature[i]] > self.cut[i])
            level += 1
            on = self.inner[node]
            leaf[at[~on]], depth[at[~on]] = node[~on], level
            at, node, start = at[on], node[on], start[on]
        size = self.size[leaf - rank[leaf] - 1]
        return depth.reshape(first, n), size.reshape(first, n)


def grow_trees(train: np.ndarray, trees: int, rng, height: int) -> Trees:
    """Isolation trees over the same rows, all at once: a random feature of a node's box is cut at a uniform value."""
    return grow_forests([train], [trees], [rng], height)[0]


def grow_forests(trains: list[np.ndarray], trees: list[int], rngs, height: int) -> list[Trees]:
    """``grow_trees`` for each lane."""
    lanes, k = len(trains), trains[0].shape[1]
    x, lane = np.concatenate([np.tile(t, (n, 1)) for t, n in zip(trains, trees)]), np.repeat(np.arange(lanes), trees)
    sizes, parts = np.repeat([len(t) for t in trains], trees), [[] for _ in trains]
    for level in range(height + 1):
        lo, hi = _boxes(x, sizes)
        counts = np.bincount(lane, minlength=lanes)
        at, f = np.arange(len(sizes)), _features(rngs, k, counts)
        low, high = _picked(lo, f), _picked(hi, f)
        split = (sizes >= 2) & (high > low) & (level < height)
        cut = np.minimum(low + _uniform(rngs, counts) * (high - low), np.nextafter(high, -np.inf))  # both sides hold a row
        ends = np.cumsum(counts)
        for i in np.flatnonzero(counts):
            own = slice(ends[i] - counts[i], ends[i])
            on = split[own]
            parts[i].append((on, f[own][on], cut[own][on], sizes[own][~on]))
        live, node = np.repeat(split, sizes), np.repeat(at[split], sizes[split])
        x = x.compress(live, axis=0)
        if not len(x):
            break
        child = 2 * (np.cumsum(split) - 1)[node] + (_picked(x, f[node]) > cut[node])
        x, sizes = _into_children(x, child, 2 * int(split.sum()))
        lane = np.repeat(lane[split], 2)
    return [Trees(n, *(np.concatenate(p) for p in zip(*own))) for n, own in zip(trees, parts)]


def collusive_displacement(train: np.ndarray, query: np.ndarray, rng) -> np.ndarray:
    """Robust random cut tree over ``train``; per query row the largest (sibling rows / own subtree rows)
    it would cause if inserted. A query row leaves the tree where a cut first separates it from the node's box."""
    return collusive_displacements([train], [query], [rng])


def collusive_displacements(trains: list[np.ndarray], queries: list[np.ndarray], rngs) -> np.ndarray:
    """``collusive_displacement`` for each lane; lanes joined."""
    lanes, k = len(trains), trains[0].shape[1]
    query = np.concatenate(queries)
    best = np.zeros(len(query))
    x, sizes, lane = np.concatenate(trains), np.array([len(t) for t in trains]), np.arange(lanes)
    q_rows, q_node = np.arange(len(query)), np.repeat(lane, [len(q) for q in queries])
    while len(q_rows):
        lo, hi = _boxes(x, sizes)
        box = _row_sums(hi - lo)
        point, q_box = query.take(q_rows, axis=0), box[q_node]
        ext = _row_sums(np.maximum(hi.take(q_node, axis=0), point) - np.minimum(lo.take(q_node, axis=0), point))
        out = _uniform(rngs, np.bincount(lane[q_node], minlength=lanes)) * ext < ext - q_box
        best[q_rows[out]] = np.maximum(best[q_rows[out]], sizes[q_node[out]])
        stay = ~out & (q_box > 0)
        q_rows, q_node = q_rows[stay], q_node[stay]
        if not len(q_rows):
            break
        kept = (np.bincount(lane[q_node], minlength=lanes) > 0)[lane]  # a lane ends with its query rows
        if not kept.all():
            x, q_node = x.compress(np.repeat(kept, sizes), axis=0), (np.cumsum(kept) - 1)[q_node]
            sizes, lane, lo, hi, box = sizes[kept], lane[kept], lo.compress(kept, axis=0), hi.compress(kept, axis=0), box[kept]
        split = box > 0
        at, counts = np.arange(len(sizes)), np.bincount(lane, minlength=lanes)
        pick, part = [np.empty(len(sizes)) for _ in range(2)]
        begin = 0
        for rng, n in zip(rngs, counts.tolist()):
            if n:
                rng.random(out=pick[begin:begin + n])
                rng.random(out=part[begin:begin + n])
                begin += n
        pick *= box
        width, run, f = hi - lo, 0.0, np.zeros(len(sizes), dtype=np.int64)
        for j in range(k - 1):  # the feature where the running sum of widths passes the pick
            run = run + width[:, j]
            f += run <= pick
        cut = _picked(lo, f) + part * _picked(width, f)
        place = np.cumsum(split) - 1
        live, node = np.repeat(split, sizes), np.repeat(at[split], sizes[split])
        x = x.compress(live, axis=0)
        child = 2 * place[node] + (_picked(x, f[node]) > cut[node])
        x, held = _into_children(x, child, 2 * int(split.sum()))
        q_child = 2 * place[q_node] + (query.ravel().take(q_rows * k + f[q_node]) > cut[q_node])
        own = held[q_child]
        best[q_rows] = np.maximum(best[q_rows], (sizes[q_node] - own) / (own + 1))
        full = held > 0
        known = own > 0
        q_rows, q_node = q_rows[known], (np.cumsum(full) - 1)[q_child[known]]
        sizes, lane = held[full], np.repeat(lane[split], 2)[full]
    return best
