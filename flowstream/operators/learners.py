"""Hoeffding trees and their ensembles, test-then-train, in windows.

Per window one job: pieces of the window's rows meet all current trees and are counted into their leaves
(small arrays), the counts of one tree meet the tree in one task, and that task grows it. Trees go from window to window
through the shared folder, not through the driver. The trees as they stood before each window then predict that window's rows in a
single parallel pass. Training per window instead of per row is a deliberate change of granularity.

With stream keys every stream has trees of its own. Then one job trains all streams side by side: a stream's rows
meet in one task, window after window, and its trees are the state of ``keyed_scan``. Streams of a task that are no longer than a
segment learn together, a window of each at a time (``flowstream.functions.groves``), unless a learner watches subtrees or limits its leaves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields, replace
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as _typed

from flowstream.functions import hoeffding as H
from flowstream.functions.groves import Grove
from flowstream.functions.partitions import LEHMER, node_hash
from flowstream.operators.keyed import SEGMENT_ROWS, _ddl, _segments, keyed_scan
from flowstream.operators.ordering import _keys
from flowstream.operators.steps import run_steps
from flowstream.session import fresh_path, spread_by

CHUNK_ROWS = 100_000  # most rows of a piece of a window
PIECE_ROWS = 100      # least rows of a piece, where cores allow it
PACK_STREAMS = 256    # most streams that learn together
PACK_ROWS = 400_000   # rows after which no further stream is taken along
MAX_MODEL_BYTES = 256 << 20  # the trees of one window are sent to every task


# Fixed values below: default parameters of the four learners.
@dataclass(frozen=True)
class Learner:
    members: int = 1
    lam: float = 0.0              # Poisson rate of row weights; 0 means weight 1
    max_features: float = 1.0     # share of the features a split may use
    grace: int = 200
    confidence: float = 0.01
    tie: float = 0.05
    criterion: str = "infogain"
    leaf: str = "nba"
    nb_threshold: float = 0
    max_leaves: int | None = None  # no limit unless given
    drift: str = "none"           # none, subtree (alternate subtrees), member (replace members)
    delta: float = 0.002
    warning_delta: float = 0.01
    drift_detection: bool = True
    background: bool = False
    weighted_vote: bool = False
    seed: int = 1


def hoeffding_tree(**params) -> Learner:
    return replace(Learner(), **params)


def hoeffding_adaptive_tree(**params) -> Learner:
    return replace(Learner(drift="subtree", seed=0), **params)


def leveraging_bagging(**params) -> Learner:
    return replace(Learner(members=100, lam=6.0, drift="member"), **params)


def adaptive_random_forest(**params) -> Learner:
    return replace(Learner(members=100, lam=6.0, max_features=0.6, grace=50, drift="member", background=True, weighted_vote=True), **params)


LEARNERS = {
    "LB": ("LeveragingBagging", leveraging_bagging),
    "HAT": ("HoeffdingAdaptiveTree", hoeffding_adaptive_tree),
    "ARF": ("AdaptiveRandomForest", adaptive_random_forest),
    "HT": ("HoeffdingTree", hoeffding_tree),
}


def learners(names: Sequence[str] | None = None, overrides: dict[str, dict] | None = None) -> dict[str, Learner]:
    """Configured learners by name; an unknown parameter is an error."""
    overrides = overrides or {}
    out = {}
    for short in names or LEARNERS:
        name, make = LEARNERS[short]
        unknown = set(overrides.get(short, {})) - {f.name for f in fields(Learner)}
        if unknown:
            raise TypeError(f"{short} has no parameter {sorted(unknown)}")
        out[name] = make(**overrides.get(short, {}))
    return out


@lru_cache(maxsize=64)
def _poisson_cdf(lam: float) -> np.ndarray:
    k = np.arange(60)
    return np.cumsum(np.exp(-lam + k * np.log(lam) - np.concatenate([[0], np.cumsum(np.log(np.arange(1, 60)))])))


def _weights(cfg: Learner, member, seq: np.ndarray) -> np.ndarray:
    """Poisson weight per (row, member) from a hash, the same on every run and partitioning."""
    if cfg.lam <= 0:
        return np.ones(np.broadcast_shapes(np.shape(member), seq.shape))
    u = node_hash(cfg.seed, member, seq % LEHMER) / LEHMER
    return np.searchsorted(_poisson_cdf(cfg.lam), u, side="right").astype(float)


def _count_members(members: dict[tuple, tuple[Learner, H.Member]], seq, x, y, classes: int) -> tuple[list[dict], np.ndarray]:
    """What a window's rows add to each (learner, member) tree and its companions, and the predictions of the trees."""
    weights: dict[tuple, np.ndarray] = {}
    for name in dict.fromkeys(name for name, _ in members):
        mine = [key for key in members if key[0] == name]
        rows = _weights(members[mine[0]][0], np.array([i for _, i in mine])[:, None], seq[None, :])
        weights |= dict(zip(mine, rows))
    every = np.arange(len(x))
    trees, parts = [], []
    for key, (cfg, m) in members.items():
        jobs = [("main", m.root, every)]
        if m.background is not None:
            jobs.append(("background", m.background, every))
        if cfg.drift == "subtree":
            jobs += [("alt:" + path, _at(m.root, path).alternate, rows) for path, rows in _alternate_rows(m.root, x, every)]
        parts.append([part for part, _, _ in jobs])
        trees += [(root, rows, weights[key], cfg.leaf, cfg.nb_threshold) for _, root, rows in jobs]
    counts, preds = H.count_together(trees, x, y, classes)
    firsts = np.cumsum([0, *(len(p) for p in parts)])
    return [dict(zip(p, counts[a:])) for p, a in zip(parts, firsts)], preds[firsts[:-1]]


def _at(node, path: str):
    for step in path:
        node = node.left if step == "l" else node.right
    return node


def _alternate_rows(node, x, rows, path=""):
    if isinstance(node, H.Leaf) or not len(rows):
        return []
    mine = [(path, rows)] if node.alternate is not None else []
    left = x[rows, node.feature] <= node.cut
    return mine + _alternate_rows(node.left, x, rows[left], path + "l") + _alternate_rows(node.right, x, rows[~left], path + "r")


def _merge(parts: list[dict]) -> dict:
    out: dict[str, dict] = {}
    for p in parts:
        for name, by_leaf in p.items():
            mine = out.setdefault(name, {})
            for path, c in by_leaf.items():
                mine[path] = mine[path].add(c) if path in mine else c
    return out


def _absorb(root, counts: dict) -> None:
    """Add the window's counts to the leaves."""
    for path, c in counts.items():
        leaf = _at(root, path)
        leaf.n, leaf.s1, leaf.s2 = leaf.n + c.n, leaf.s1 + c.s1, leaf.s2 + c.s2
        leaf.lo, leaf.hi = np.minimum(leaf.lo, c.lo), np.maximum(leaf.hi, c.hi)
        leaf.majority_ok += c.majority_ok
        leaf.bayes_ok += c.bayes_ok


def _split_due(trees: Sequence[tuple], window: int) -> list:
    """Splits the leaves that the Hoeffding bound allows, for all (root, learner, member) trees together; the roots after it."""
    due: dict[str, list[tuple]] = {}
    for t, (root, cfg, member) in enumerate(trees):
        leaves = H.leaves(root)
        if cfg.max_leaves is not None and len(leaves) >= cfg.max_leaves:
            continue
        for path, leaf in leaves:
            weight = leaf.n.sum()
            if weight - leaf.tried >= cfg.grace:
                due.setdefault(cfg.criterion, []).append((t, path, leaf, weight, _pick(cfg, member, window, path, leaf.s1.shape[1]), len(leaves)))
    roots = [root for root, _, _ in trees]
    for criterion, mine in due.items():
        best = H.best_cuts([d[2] for d in mine], [d[4] for d in mine], criterion)
        added: dict[int, int] = {}
        for (t, path, leaf, weight, _, had), b in zip(mine, best):
            cfg = trees[t][1]
            if cfg.max_leaves is not None and had + added.get(t, 0) >= cfg.max_leaves:
                continue
            leaf.tried = weight
            new = H.split_at(leaf, b, criterion, cfg.confidence, cfg.tie)
            if new is leaf:
                continue
            added[t] = added.get(t, 0) + 1
            if not path:
                roots[t] = new
            elif path[-1] == "l":
                _at(roots[t], path[:-1]).left = new
            else:
                _at(roots[t], path[:-1]).right = new
    return roots


def _pick(cfg: Learner, member: int, window: int, path: str, k: int) -> np.ndarray:
    """The features a split may use."""
    return _pick_by(cfg, member, window, len(path), sum(ord(c) * (i + 1) for i, c in enumerate(path)), k)


def _pick_by(cfg: Learner, member: int, window: int, depth: int, code: int, k: int) -> np.ndarray:
    wanted = max(1, round(cfg.max_features * k))
    if wanted >= k:
        return np.arange(k)
    rng = np.random.default_rng([cfg.seed, member, window, depth, code])
    return np.sort(rng.permutation(k)[:wanted])


@lru_cache(maxsize=1 << 18)
def _usable(cfg: Learner, member: int, window: int, depth: int, code: int, k: int) -> list[bool]:
    """``_pick`` as one truth value per feature, from the length of the path and its code."""
    return np.isin(np.arange(k), _pick_by(cfg, member, window, depth, code, k)).tolist()


def _grow(root, counts: dict, cfg: Learner, member: int, window: int):
    """Add the window's counts to the leaves and split those the Hoeffding bound allows."""
    _absorb(root, counts)
    return _split_due([(root, cfg, member)], window)[0]


def _totals(counts: dict, prefix: str = "") -> tuple[float, float]:
    mine = [c for path, c in counts.items() if path.startswith(prefix)]
    return sum(c.rows for c in mine), sum(c.errors for c in mine)


def _subtree_drift(root, counts: dict, alternates: dict, cfg: Learner, member: int, window: int, classes: int, features: int, path: str = ""):
    """Watch the error of every subtree; start, swap in or drop its alternate."""
    if isinstance(root, H.Leaf):
        return root
    n, e = _totals(counts, path)
    if root.alternate is not None:
        mine = alternates.get(path, {})
        an, ae = _totals(mine)
        root.alternate = _grow(root.alternate, mine, cfg, member, window)
        # errors of both since the alternate began, so that windows of any size add up to enough rows
        rows, wrong, alternate_rows, alternate_wrong = root.race = root.race + np.array([n, e, an, ae])
        if alternate_rows > cfg.grace and rows:
            p, q = wrong / rows, alternate_wrong / alternate_rows
            eps = np.sqrt(2 * p * (1 - p) * np.log(2 / 0.05) * (1 / alternate_rows + 1 / rows))
            if p - q > eps:
                return root.alternate
            if q - p > eps:
                root.alternate = None
    if n:
        root.history.add(n, e)
    old = root.history.changed(cfg.delta)
    if old:
        root.history.forget(old)
        if root.alternate is None:
            root.alternate, root.race = H.Leaf(classes, features), np.zeros(4)
    root.left = _subtree_drift(root.left, counts, alternates, cfg, member, window, classes, features, path + "l")
    root.right = _subtree_drift(root.right, counts, alternates, cfg, member, window, classes, features, path + "r")
    return root


def _learn(members: Sequence[tuple], window: int, classes: int, features: int) -> list[H.Member]:
    """All (learner, member's state, counts, member) after the window; their splits are looked for together."""
    growing, totals = [], []
    for cfg, m, got, member in members:
        counts = got.get("main", {})
        n, e = _totals(counts)
        totals.append((n, e))
        m.ok, m.seen = m.ok + n - e, m.seen + n
        if cfg.drift == "subtree" and cfg.drift_detection:
            alternates = {k[4:]: v for k, v in got.items() if k.startswith("alt:")}
            counted = {p: _leaf_at(m.root, p) for p in counts}
            m.root = _subtree_drift(m.root, counts, alternates, cfg, member, window, classes, features)
            # a swapped-in alternate learned in this window already, so only leaves of the tree before it take their counts
            counts = {p: c for p, c in counts.items() if counted[p] is not None and _leaf_at(m.root, p) is counted[p]}
        elif m.background is not None:
            _absorb(m.background, got.get("background", {}))
            growing.append((m, "background", cfg, member))
        _absorb(m.root, counts)
        growing.append((m, "root", cfg, member))
    roots = _split_due([(getattr(m, part), cfg, member) for m, part, cfg, member in growing], window)
    for (m, part, _, _), root in zip(growing, roots):
        setattr(m, part, root)
    return [_member_drift(cfg, m, n, e, classes, features) for (cfg, m, _, _), (n, e) in zip(members, totals)]


def _member_drift(cfg: Learner, m: H.Member, n: float, e: float, classes: int, features: int) -> H.Member:
    """The member after its errors of the window, replaced if they rose."""
    if cfg.drift == "member" and cfg.drift_detection:
        if n:
            m.history.add(n, e)
        old = m.history.changed(cfg.delta)
        if old:
            fresh = m.background if cfg.background and m.background is not None else H.Leaf(classes, features)
            return H.Member(fresh, m.history.forget(old))
        if cfg.background and m.background is None and m.history.changed(cfg.warning_delta):
            m.background = H.Leaf(classes, features)
    return m


def _leaf_at(root, path: str):
    """The leaf a path ends in, or None."""
    node = root
    for step in path:
        if isinstance(node, H.Leaf):
            return None
        node = node.left if step == "l" else node.right
    return node if isinstance(node, H.Leaf) else None


def _vote_weight(cfg: Learner, m: H.Member) -> float:
    return m.ok / m.seen if cfg.weighted_vote and m.seen else 1.0


def _vote(cfg: Learner, members: Sequence[H.Member], x: np.ndarray, classes: int) -> np.ndarray:
    votes = np.zeros((len(x), classes))
    for m in members:
        votes[np.arange(len(x)), H.predict(m.root, x, cfg.leaf, cfg.nb_threshold)] += _vote_weight(cfg, m)
    return votes.argmax(axis=1).astype(np.int32)


def _classify_streams(df: DataFrame, features: Sequence[str], configured: dict[str, Learner], window_rows: int, classes: int, keys: Sequence[str],
                      seq: str, target: str, keep: Sequence[str]) -> DataFrame:
    """The keyed form: the trees of a stream learn window after window where its rows are."""
    features, k = list(features), len(features)
    carried = list(dict.fromkeys([*keys, seq, target, *keep]))
    rows = df.select(*carried, *[F.col(c).cast("double").alias(c) for c in features if c not in carried])

    def make(key) -> dict:
        return {(name, i): H.Member(H.Leaf(classes, k)) for name, cfg in configured.items() for i in range(cfg.members)}

    def advance(models: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        # plain arrays of the segment: a window's rows are few, a table of their own would cost more than the trees
        xs = np.column_stack([pdf[c].to_numpy(dtype=float) for c in features])
        ys, ats = pdf[target].to_numpy(dtype=np.int64), pdf[seq].to_numpy(dtype=np.int64)
        windows = ats // window_rows
        cuts = [0, *(np.nonzero(np.diff(windows))[0] + 1), len(ats)]
        preds = {name: np.empty(len(ats), dtype=np.int32) for name in configured}
        for begin, end in zip(cuts, cuts[1:]):
            x, y, at, w = xs[begin:end], ys[begin:end], ats[begin:end], int(windows[begin])
            every = np.arange(end - begin)
            # rows are routed once, to be predicted and counted, for the trees of all learners together
            members = {key: (configured[key[0]], m) for key, m in models.items()}
            got, own = _count_members(members, at, x, y, classes)
            votes = {name: np.zeros((end - begin, classes)) for name in configured}
            for (name, _), (cfg, m), pred in zip(members, members.values(), own):
                votes[name][every, pred] += _vote_weight(cfg, m)
            learned = _learn([(cfg, m, g, key[1]) for (key, (cfg, m)), g in zip(members.items(), got)], w, classes, k)
            models.update(zip(members, learned))
            for name, cfg in configured.items():
                preds[name][begin:end] = votes[name].argmax(axis=1)
                if cfg.drift == "member" and not cfg.background:
                    _replace_worst(models, name, classes, k)
        parts = [pd.DataFrame({**{c: pdf[c] for c in carried}, "learner": name, "pred": preds[name]}) for name in configured]
        return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]

    segment = max(1, SEGMENT_ROWS // window_rows) * window_rows
    schema = f"{_ddl(df, carried)}, learner string, pred int"
    trees = sum(cfg.members for cfg in configured.values())
    together = min(PACK_STREAMS, H.TOGETHER_VALUES // max(1, window_rows * trees * classes * k))
    if together < 2 or any(cfg.drift == "subtree" or cfg.max_leaves is not None for cfg in configured.values()):
        return keyed_scan(rows, keys, make, advance, schema, seq, segment).withColumnRenamed(target, "truth")

    def learn(pack: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd = []
        for pdf in pack:
            y = pdf[target].to_numpy(dtype=np.int64)
            odd.append(y.min() < 0 or y.max() >= classes or not np.isfinite(pdf[features].to_numpy(dtype=float)).all())
        for pdf, alone in zip(pack, odd):
            if alone:
                yield advance(make(None), pdf)
        pack = [pdf for pdf, alone in zip(pack, odd) if not alone]
        if pack:
            yield _learn_together(pack, features, configured, window_rows, classes, seq, target, carried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, size = [], 0
        for stream in _streams(batches, keys):
            parts = _in_sequence(_segments((pdf.drop(columns="_key") for pdf in stream), seq, segment), seq)
            first = next(parts)
            second = next(parts, None)
            if second is not None:  # a long stream: one state from segment to segment
                models = make(None)
                for pdf in chain([first, second], parts):
                    yield advance(models, pdf)
                continue
            pack.append(first)
            size += len(first)
            if len(pack) == together or size >= PACK_ROWS:
                yield from learn(pack)
                pack, size = [], 0
        if pack:
            yield from learn(pack)

    rows = spread_by(rows, keys).withColumn("_key", F.xxhash64(*keys)).sortWithinPartitions(*keys, F.col(seq).asc_nulls_last())
    return rows.mapInPandas(run, schema).withColumnRenamed(target, "truth")


def _streams(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[Iterator[pd.DataFrame]]:
    """The pieces of one stream after the other, of rows sorted by the keys."""
    def pieces():
        number, last = 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            other = np.zeros(len(pdf), dtype=bool)
            for c in [*keys, "_key"]:
                own = pdf[c]
                before = own.shift(1)
                other[1:] |= ((own != before) & ~(own.isna() & before.isna())).to_numpy(dtype=bool, na_value=True)[1:]
                if last is not None:
                    a, b = last[c], own.iloc[0]
                    other[0] |= not (pd.isna(a) and pd.isna(b) or (not pd.isna(a) and not pd.isna(b) and a == b))
            last = {c: pdf[c].iloc[-1] for c in [*keys, "_key"]}
            cuts = [0, *np.nonzero(other)[0].tolist(), len(pdf)]
            for at, (i, j) in enumerate(zip(cuts, cuts[1:])):
                number += at > 0
                if i < j:
                    yield number, pdf.iloc[i:j]

    for _, group in groupby(pieces(), key=lambda piece: piece[0]):
        yield (pdf for _, pdf in group)


def _in_sequence(parts: Iterator[pd.DataFrame], seq: str) -> Iterator[pd.DataFrame]:
    last = -np.inf
    for rows in parts:
        at = rows[seq].to_numpy(dtype=float, na_value=np.inf)
        if at[0] < last or (at[1:] < at[:-1]).any():
            raise AssertionError("rows of a stream came out of order")
        last = at[-1]
        yield rows


def _learn_together(pack: Sequence[pd.DataFrame], features: Sequence[str], configured: dict[str, Learner], window_rows: int, classes: int,
                    seq: str, target: str, carried: Sequence[str]) -> pd.DataFrame:
    """Predictions for whole streams that learn side by side, the first window of each, then the second of each that has one."""
    pdf = pd.concat(pack, ignore_index=True) if len(pack) > 1 else pack[0]
    x = np.column_stack([pdf[c].to_numpy(dtype=float) for c in features])
    y, at = pdf[target].to_numpy(dtype=np.int64), pdf[seq].to_numpy(dtype=np.int64)
    stream = np.repeat(np.arange(len(pack)), [len(p) for p in pack])
    windows = at // window_rows
    begins = np.concatenate([[0], np.nonzero((np.diff(windows) != 0) | (np.diff(stream) != 0))[0] + 1])
    sizes, owner = np.diff(np.append(begins, len(at))), stream[begins]
    turn = np.arange(len(begins)) - np.searchsorted(owner, owner)  # the window's place in its stream
    members = [(i, cfg, j) for i, cfg in enumerate(configured.values()) for j in range(cfg.members)]
    grove = Grove(len(pack), members, classes, len(features), _weights, _usable)
    preds = [np.empty(len(at), dtype=np.int32) for _ in configured]
    replaced = [[j for j, (l, _, _) in enumerate(members) if l == i] for i, cfg in enumerate(configured.values()) if cfg.drift == "member" and not cfg.background]
    order = np.argsort(turn, kind="stable")
    for chosen in np.split(order, np.nonzero(np.diff(turn[order]))[0] + 1):
        rows = np.concatenate([np.arange(b, b + n) for b, n in zip(begins[chosen].tolist(), sizes[chosen].tolist())])
        for pred, got in zip(preds, grove.window(owner[chosen], sizes[chosen], windows[begins[chosen]], x[rows], y[rows], at[rows])):
            pred[rows] = got
        for mine in replaced:
            trees = owner[chosen][:, None] * grove.m + np.array(mine)
            some = (grove.seen[trees] == 0).any(axis=1) & (grove.seen[trees] > 0).any(axis=1)
            for own in trees[some].tolist():
                grove.replace(own[_worst([(grove.ok[t], grove.seen[t]) for t in own])])
    parts = [pd.DataFrame({**{c: pdf[c] for c in carried}, "learner": name, "pred": pred}) for name, pred in zip(configured, preds)]
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]


def prequential_classify(df: DataFrame, features: Sequence[str], configured: dict[str, Learner], window_rows: int, classes: int,
                         seq: str = "seq", target: str = "class_idx", keep: Sequence[str] = (), block_rows: int = 65_536, keys=None) -> DataFrame:
    """Predictions of several learners: (keys, seq, truth, kept columns, learner, pred).

    Every row is predicted by trees that have seen the windows before its own only. With ``keys`` each stream has its
    own trees and its own ``seq``; without, the whole table is one stream. Plug-ins with a ``step`` (see
    ``flowstream.operators.steps``) predict and learn row by row, all in one pass.
    """
    stepping = {name: c for name, c in configured.items() if hasattr(c, "step")}
    if stepping:
        own = run_steps(df, stepping, keys, seq, [target, *keep], [*features, target], "learner").withColumnRenamed(target, "truth")
        trees = {name: c for name, c in configured.items() if name not in stepping}
        if not trees:
            return own
        return own.unionByName(prequential_classify(df, features, trees, window_rows, classes, seq, target, keep, block_rows, keys))
    if _keys(keys):
        return _classify_streams(df, features, configured, window_rows, classes, _keys(keys), seq, target, keep)
    spark = df.sparkSession
    features = list(features)
    k = len(features)
    carried = list(dict.fromkeys([seq, target, *keep]))
    path = fresh_path(spark, "windows")
    rows = df.select(*carried, *[F.col(c).cast("double").alias(c) for c in features if c not in carried])
    # range partitions keep a window's rows in few files; each job then reads its own folder only
    rows = rows.withColumn("_w", F.expr(f"cast(`{seq}` div {window_rows} as int)")).repartitionByRange(seq)
    rows.write.partitionBy("_w").parquet(path)
    data = spark.read.parquet(path)
    last = data.agg(F.max("_w")).first()[0]
    models = {(name, i): H.Member(H.Leaf(classes, k)) for name, cfg in configured.items() for i in range(cfg.members)}
    model_path, grown_path = fresh_path(spark, "models"), fresh_path(spark, "grown")
    model_type = _typed("learner string, member int, blob binary, ok double, seen double")
    count_type = _typed("learner string, member int, blob binary, first long")
    cores = spark.sparkContext.defaultParallelism

    def count(key, pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=count_type.names)
        pdf = pdf.sort_values(seq)
        members = {(n, int(i)): (configured[n], pickle.loads(b)) for n, i, b in zip(trees["learner"], trees["member"], trees["blob"])}
        at = pdf[seq].to_numpy(dtype=np.int64)
        got, _ = _count_members(members, at, pdf[features].to_numpy(dtype=float), pdf[target].to_numpy(dtype=np.int64), classes)
        return pd.DataFrame([{"learner": n, "member": i, "blob": pickle.dumps(g), "first": int(at[0])} for (n, i), g in zip(members, got)])

    def grow_in(w: int):
        def grow(key, pdf: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            name, i = tree["learner"].iloc[0], int(tree["member"].iloc[0])
            m = pickle.loads(tree["blob"].iloc[0])
            if len(pdf):
                # sums in a fixed order, so that a rerun grows the same tree
                parts = [pickle.loads(b) for b in pdf.sort_values("first")["blob"]]
                m = _learn([(configured[name], m, _merge(parts), i)], w, classes, k)[0]
            return pd.DataFrame([{"learner": name, "member": i, "blob": pickle.dumps(m), "ok": float(m.ok), "seen": float(m.seen)}])
        return grow

    # The trees before window w lie in part _w=w of the shared folder; the driver sees two numbers and the size of each.
    replaced = [name for name, cfg in configured.items() if cfg.drift == "member" and not cfg.background]
    fresh = bytearray(pickle.dumps(H.Member(H.Leaf(classes, k))))
    none_yet = [(name, i, fresh, 0.0, 0.0) for name, cfg in configured.items() for i in range(cfg.members)]
    spark.createDataFrame(none_yet, model_type).write.parquet(f"{model_path}/_w=0")
    # no more tasks than pieces or trees: what each task reports to the driver would be most of what it gets
    by, places = ["learner", "member"], min(len(none_yet), cores)
    pieces = max(min(cores, -(-window_rows // PIECE_ROWS)), -(-window_rows // CHUNK_ROWS))
    for w in range(last if last is not None else 0):
        trees = spark.read.schema(model_type).parquet(f"{model_path}/_w={w}").select("learner", "member", "blob")
        # pieces of consecutive rows, each of which meets all trees
        window = data.filter(F.col("_w") == w).select(seq, target, *features)
        window = window.withColumn("_piece", F.expr(f"cast((`{seq}` - {w * window_rows}L) * {pieces} div {window_rows} as int)"))
        everywhere = trees.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        counts = window.repartition(pieces, "_piece").groupBy("_piece").cogroup(everywhere.repartition(pieces, "_to").groupBy("_to")).applyInPandas(count, count_type)
        grown = counts.repartition(places, *by).groupBy(*by).cogroup(trees.repartition(places, *by).groupBy(*by)).applyInPandas(grow_in(w), model_type)
        path = f"{grown_path if replaced else model_path}/_w={w + 1}"
        grown.write.parquet(path)
        grown = spark.read.schema(model_type).parquet(path)
        state = sorted(grown.select("learner", "member", "ok", "seen", F.length("blob").alias("size")).collect())
        size = sum(r["size"] for r in state)
        if size > MAX_MODEL_BYTES:
            raise ValueError(f"trees of {size} bytes are too large to send to every task; lower members or max_leaves")
        if replaced:
            again = F.lit(False)
            for name in replaced:
                mine = [r for r in state if r["learner"] == name]
                worst = _worst([(r["ok"], r["seen"]) for r in mine])
                if worst is not None:
                    again |= (F.col("learner") == name) & (F.col("member") == mine[worst]["member"])
            grown.withColumn("blob", F.when(again, F.lit(fresh)).otherwise(F.col("blob"))).write.parquet(f"{model_path}/_w={w + 1}")

    def vote(key, pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        x = pdf[features].to_numpy(dtype=float)
        parts = []
        for name, cfg in configured.items():
            mine = trees.loc[trees["learner"] == name].sort_values("member")["blob"]
            parts.append(pdf[carried].assign(learner=name, pred=_vote(cfg, [pickle.loads(b) for b in mine], x, classes)))
        return pd.concat(parts, ignore_index=True)

    rows = data.withColumn("_blk", F.expr(f"`{seq}` div {block_rows}"))
    trees = spark.read.parquet(model_path).select(F.col("_w").alias("_mw"), "learner", "member", "blob")
    homes = rows.select("_w", "_blk").distinct().withColumnsRenamed({"_w": "_hw", "_blk": "_hblk"})
    trees = homes.join(trees, F.col("_hw") == F.col("_mw")).drop("_mw")
    left, right = spread_by(rows, ["_w", "_blk"]).groupBy("_w", "_blk"), spread_by(trees, ["_hw", "_hblk"]).groupBy("_hw", "_hblk")
    out = left.cogroup(right).applyInPandas(vote, f"{_ddl(df, carried)}, learner string, pred int")
    return out.withColumnRenamed(target, "truth")


def _worst(states: Sequence[tuple[float, float]]) -> int | None:
    """Leveraging bagging: when a member just restarted after drift, the member with the highest error restarts too.
    Its place among the (right rows, rows) of all members."""
    seen = [at for at, (_, n) in enumerate(states) if n > 0]
    return min(seen, key=lambda at: states[at][0] / states[at][1]) if 0 < len(seen) < len(states) else None


def _replace_worst(models: dict, name: str, classes: int, k: int) -> None:
    mine = [key for key in models if key[0] == name]
    worst = _worst([(models[key].ok, models[key].seen) for key in mine])
    if worst is not None:
        models[mine[worst]] = H.Member(H.Leaf(classes, k))


def classifier_sweep(df: DataFrame, features: Sequence[str], algorithm: str, grid: Sequence[dict], window_rows: int, classes: int,
                     target_class: int | None = 1, seq: str = "seq", target: str = "class_idx", keys=None) -> DataFrame:
    """One line per trial, with ``keys`` per stream and trial; all trials learn side by side in the same window jobs (no
    warm-up)."""
    from flowstream.functions.columns import collapse_prediction, encode_index
    from flowstream.operators.evaluation import binary_metrics

    configured = {str(i): next(iter(learners([algorithm], {algorithm: p}).values())) for i, p in enumerate(grid)}
    keys = _keys(keys)
    preds = prequential_classify(df, features, configured, window_rows, classes, seq, target, keys=keys)
    preds = preds.select(*keys, "learner", encode_index(F.col("truth")).alias("truth"), collapse_prediction(F.col("pred")).alias("pred"))
    names = F.create_map(*[x for i, p in enumerate(grid) for x in (F.lit(str(i)), F.lit(", ".join(f"{a}={b}" for a, b in p.items())))])
    out = binary_metrics(preds, target=target_class, by=[*keys, "learner"])
    return out.select(*keys, F.lit(algorithm).alias("algorithm"), F.col("learner").cast("int").alias("trial"), names[F.col("learner")].alias("params"),
                      "f1", "precision", "recall")
