"""Queries on anomaly scorers (events, embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SQL_SEQ, TRUTH_LEVEL, stream, table
from flowstream.operators import evaluation as E
from flowstream.operators import profile as P
from flowstream.operators import scoring as S
from flowstream.operators.ordering import with_seq
from flowstream.operators.sweeps import scorer_sweep
from flowstream.plans.experiments import anomaly_experiment, contamination_study

# Fixed values of these queries.
HST = {"window": 1000, "trees": 25, "depth": 6, "size_limit": 0.05, "seed": 1}
FEATURES = ["value", "user_id"]
FROZEN = 1000  # warm-up rows of the frozen run
GRID = [{"window": 500, "depth": 5, "trees": 10}, {"window": 1000, "depth": 8, "trees": 10}, {"window": 1000, "depth": 6, "trees": 20, "size_limit": 0.25}]
LEVELS = [0.3, 0.5, 0.7, 0.9]
HISTORY, CUT = 500, 0.7  # rows between sample points, and the threshold of the history


def _stream(spark, d):
    """Scaled features of the event stream with the planted truth."""
    s = stream(spark, d, "value", "user_id").withColumn("truth", (F.col("value") > TRUTH_LEVEL).cast("int"))
    return P.scale(s.withColumn("user_id", F.col("user_id").cast("double")), FEATURES, "MinMaxScaler")


def _auc(scored, skip):
    rows = scored.filter(F.col("seq") >= skip)
    return E.auc(rows, by="algorithm").withColumn("auc", F.round("auc", 6))


def half_space_trees(spark, d):
    out = S.window_scores(_stream(spark, d), FEATURES, S.HalfSpaceTrees(**HST))
    return out.select("seq", F.round("score", 6).alias("score"))


def isolation_forest(spark, d):
    return S.window_scores(_stream(spark, d), FEATURES, S.OnlineIsolationForest(trees=25, window=1024), keep=["truth"])


def random_cut_forest(spark, d):
    return S.window_scores(_stream(spark, d), FEATURES, S.RandomCutForest(trees=15, tree_size=512), keep=["truth"])


def adaptive_iforest(spark, d):
    return S.window_scores(_stream(spark, d), FEATURES, S.AdaptiveIsolationForest(trees=40, m_trees=12), keep=["truth"])


def autoencoder(spark, d):
    return S.freeze_after_warmup(_stream(spark, d), FEATURES, S.Autoencoder(hidden=1), 1000, keep=["truth"], block_rows=4096)


def autoencoder_wide(spark, d):
    """The 64 dimensions of the embeddings as features, scaled to [0, 1]."""
    e = table(spark, d, "embeddings")
    cols = [f"f{i}" for i in range(64)]
    wide = with_seq(e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), ["vec_id"])
    return S.freeze_after_warmup(P.scale(wide, cols, "MinMaxScaler"), cols, S.Autoencoder(), 250, keep=["vec_id"])


def frozen_trees(spark, d):
    out = S.freeze_after_warmup(_stream(spark, d), FEATURES, S.HalfSpaceTrees(**HST), FROZEN, keep=["truth"], block_rows=2048)
    return out.withColumn("score", F.round("score", 6))


def scorer_auc(spark, d):
    """ROC area of four scorers on the planted truth, rows of the first 1,000 left out."""
    algorithms = S.scorers(["HST", "OIF", "AIF", "AE"], {"HST": HST, "OIF": {"trees": 25, "window": 1024}, "AIF": {"trees": 40, "m_trees": 12},
                                                         "AE": {"hidden": 1}})
    return _auc(S.prequential_score(_stream(spark, d), FEATURES, algorithms, 1000, keep=["truth"]), 1000)


def scorer_grid(spark, d):
    out = scorer_sweep(_stream(spark, d), FEATURES, "HST", GRID, thresholds=LEVELS)
    return out.select("trial", "params", "threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


def anomaly_run(spark, d):
    """Prepare, score, alert by DSPOT, report: one line per algorithm."""
    s = _stream(spark, d).withColumnRenamed("truth", "class_idx")
    run = anomaly_experiment(s, FEATURES, S.scorers(["HST", "AIF"], {"HST": HST, "AIF": {"trees": 20, "m_trees": 7}}), window=2048, warmup=1000,
                             mode="dspot", dspot={"q": 0.01, "depth": 50, "t_quantile": 0.95})
    return run.report


def anomaly_history(spark, d):
    s = _stream(spark, d).withColumnRenamed("truth", "class_idx")
    run = anomaly_experiment(s, FEATURES, S.scorers(["HST"], {"HST": HST}), window=HISTORY, warmup=HST["window"], mode="fixed", threshold=CUT)
    return run.history.select("algorithm", "at_seq", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


def contamination_levels(spark, d):
    """Weekday streams stand for contamination levels; fixed threshold and DSPOT side by side."""
    s = _stream(spark, d).withColumnRenamed("truth", "class_idx").withColumn("stream_id", F.dayofweek("ts"))
    s = with_seq(s.drop("seq"), ["ts", "event_id"], by="stream_id")
    got = contamination_study(s, FEATURES, S.AdaptiveIsolationForest(window=256, trees=20, m_trees=7), threshold=0.6, warmup=300,
                              dspot={"q": 0.01, "depth": 50})
    return got.series


QUERIES = {f.__name__: f for f in [half_space_trees, isolation_forest, random_cut_forest, adaptive_iforest, autoencoder, autoencoder_wide, frozen_trees,
                                   scorer_auc, scorer_grid, anomaly_run, anomaly_history, contamination_levels]}


def _hash(seed, tree, node):
    first = f"(({seed} * 1299709::bigint + {tree} * 7919 + {node} * 104729 + 17) * 48271 % 2147483647)"
    return f"(({first} + {node} * 40503) * 69621 % 2147483647)"


def _hst_sql(frozen: int | None = None, **params):
    """(seq, truth, score) by the window before, or by the first ``frozen`` rows."""
    w, trees, depth, limit, seed = (({"size_limit": 0.05, "seed": 1} | (params or HST))[k] for k in ("window", "trees", "depth", "size_limit", "seed"))
    before, learned = ("0", f"seq < {frozen}") if frozen else ("k.win - 1", "true")
    w = "9223372036854775807" if frozen else w
    s = lambda f: f"({_hash(seed + 1, 't.tree', f'{f}::bigint')} / 2147483647.0::double)"
    return f"""with recursive
      e as (select {SQL_SEQ} as seq, (value - (select min(value) from events)) / (select max(value) - min(value) from events) as a,
        (user_id - (select min(user_id) from events))::double / (select max(user_id) - min(user_id) from events) as b, (value > {TRUTH_LEVEL})::integer as truth from events),
      t as (select unnest(range({trees}))::bigint as tree),
      r as (select tree, {s(0)} as s0, {s(1)} as s1 from t),
      walk as (
        select e.seq, e.seq // {w} as win, r.tree, 0 as level, 1::bigint as node, a, b,
          s0 - 2 * greatest(s0, 1 - s0) as lo0, s0 + 2 * greatest(s0, 1 - s0) as hi0,
          s1 - 2 * greatest(s1, 1 - s1) as lo1, s1 + 2 * greatest(s1, 1 - s1) as hi1 from e, r
        union all
        select seq, win, tree, level + 1, 2 * node + (up)::integer, a, b,
          case when f = 0 and up then (lo0 + hi0) / 2 else lo0 end, case when f = 0 and not up then (lo0 + hi0) / 2 else hi0 end,
          case when f = 1 and up then (lo1 + hi1) / 2 else lo1 end, case when f = 1 and not up then (lo1 + hi1) / 2 else hi1 end
        from (select *, case f when 0 then a >= (lo0 + hi0) / 2 else b >= (lo1 + hi1) / 2 end as up
          from (select *, {_hash(seed, 'tree', 'node')} % 2 as f from walk where level < {depth}))),
      mass as (select win, tree, node, count(*) as m from walk where {learned} group by all),
      size as (select seq // {w} as win, count(*) as n from e where {learned} group by 1),
      path as (select k.seq, k.win, k.tree, k.level, coalesce(m.m, 0) as m, s.n from walk k join size s on s.win = {before}
        left join mass m on m.win = {before} and m.tree = k.tree and m.node = k.node),
      stop as (select seq, tree, n, arg_min(m * 2.0 ** level, level) as v from path where m <= {limit} * n or level = {depth} group by all),
      z as (select seq, 1 / (1 + sum(v) / ({trees} * any_value(n))) as score from stop group by seq)
      select e.seq, e.truth, z.score from e left join z using (seq)"""


def _best_sql(i: int, params: dict) -> str:
    text = ", ".join(f"{k}={v}" for k, v in params.items())
    return f"""select {i} as trial, '{text}' as params, threshold, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall from (
      select *, row_number() over (order by f1 desc, threshold) as r from (
        select threshold, case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end * 100.0 as f1,
          case when tp + fp > 0 then 1.0 * tp / (tp + fp) else 0 end * 100.0 as precision, case when tp + fn > 0 then 1.0 * tp / (tp + fn) else 0 end * 100.0 as recall from (
          select threshold, count(*) filter (truth = 1 and pass) as tp, count(*) filter (truth = 0 and pass) as fp, count(*) filter (truth = 1 and not pass) as fn from (
            select threshold, truth, coalesce(score > threshold, false) as pass
            from (select *, max(seq) over () as last from ({_hst_sql(**params)})), (select unnest({LEVELS}::double[]) as threshold)
            where seq >= {params["window"]} or last < {params["window"]}) group by threshold))) where r = 1"""


def _macro_history_sql() -> str:
    run = ", ".join(f"sum((truth = {c} and pred = {c})::integer) over o as tp{c}, sum((truth <> {c} and pred = {c})::integer) over o as fp{c}, sum((truth = {c} and pred <> {c})::integer) over o as fn{c}" for c in (0, 1))
    share = lambda a, b: f"case when {b} > 0 then 1.0 * ({a}) / ({b}) else 0 end"
    mean = lambda a, b: " + ".join(share(a.replace("#", str(c)), b.replace("#", str(c))) for c in (0, 1))
    return f"""with p as (select seq, truth, coalesce(score > {CUT}, false)::integer as pred from ({_hst_sql()}) where seq >= {HST["window"]}),
      r as (select seq, {run} from p window o as (order by seq rows unbounded preceding))
      select 'HalfSpaceTrees' as algorithm, seq as at_seq, round(({mean("2 * tp#", "2 * tp# + fp# + fn#")}) * 50.0, 6) as f1,
        round(({mean("tp#", "tp# + fp#")}) * 50.0, 6) as precision, round(({mean("tp#", "tp# + fn#")}) * 50.0, 6) as recall
      from r where seq % {HISTORY} = 0"""



_SCORES = f"select seq, round(score, 6) as score from ({_hst_sql()})"
ORACLE = {
    "half_space_trees": _SCORES,
    "frozen_trees": f"select seq, truth, round(score, 6) as score from ({_hst_sql(FROZEN)})",
    "scorer_grid": " union all ".join(_best_sql(i, p) for i, p in enumerate(GRID)),
    "anomaly_history": _macro_history_sql(),
}
