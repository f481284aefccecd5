"""Alert thresholds on score streams: fixed, static extreme-value summary, and DSPOT."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowstream.functions.columns import discretize
from flowstream.functions.evt import Dspot, process_together
from flowstream.operators.evaluation import cumulative_report, metrics_from_confusion
from flowstream.operators.keyed import SEGMENT_ROWS, _ddl, keyed_scan
from flowstream.operators.ordering import _keys
from flowstream.operators.steps import run_steps


def fixed_threshold(scores: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    return scores.withColumn("pred", discretize(F.col(score), threshold)).withColumn("threshold", F.lit(float(threshold)))


@dataclass(frozen=True)
class DspotStep:
    """DSPOT as a plug-in of the step drivers."""

    q: float = 1e-3
    depth: int = 50
    t_quantile: float = 0.98
    warmup: int = 1000
    bracket: str = "wide"
    refit_every: int = 1
    max_peaks: int | None = None
    score: str = "score"
    outputs: str = "pred int, threshold double, trend double"

    def init(self, key):
        return Dspot(self.q, self.depth, self.t_quantile, self.warmup, self.bracket, self.refit_every, self.max_peaks)

    def step(self, state, rows):
        return state, dict(zip(("pred", "threshold", "trend"), state.process(rows[self.score].to_numpy())))

    @staticmethod
    def step_together(plugins, states, rows):
        """All over the same rows, their tails fitted together; plug-ins that read other columns step apart."""
        out = [None] * len(plugins)
        for score in dict.fromkeys(p.score for p in plugins):
            mine = [i for i, p in enumerate(plugins) if p.score == score]
            for i, got in zip(mine, process_together([states[i] for i in mine], rows[score].to_numpy())):
                out[i] = (states[i], dict(zip(("pred", "threshold", "trend"), got)))
        return out


def dspot(scores: DataFrame, keys: Sequence[str] = ("stream_id",), q: float = 1e-3, depth: int = 50, t_quantile: float = 0.98,
          warmup: int = 1000, bracket: str = "wide", refit_every: int = 1, keep: Sequence[str] = (), seq: str = "seq",
          score: str = "score", segment_rows: int = SEGMENT_ROWS, max_peaks: int | None = None) -> DataFrame:
    """DSPOT per stream: ``pred``, ``threshold`` and ``trend`` for every score; warm-up rows and rows without a score give zeros.

    ``max_peaks`` bounds the state on endless streams (see ``Dspot``).

    A grid of settings per stream comes from columns named q, depth, t_quantile (then part of the keys).
    """
    keys = _keys(keys)
    used = [k for k in ("q", "depth", "t_quantile") if k in keys]
    fixed = {"q": q, "depth": depth, "t_quantile": t_quantile}
    carried = list(dict.fromkeys([*keys, seq, score, *keep]))

    def make(key):
        own = {**fixed, **{k: v for k, v in zip(keys, key) if k in used}}
        return Dspot(float(own["q"]), int(own["depth"]), float(own["t_quantile"]), warmup, bracket, refit_every, max_peaks)

    def advance(state: Dspot, pdf: pd.DataFrame) -> pd.DataFrame:
        flag, threshold, trend = state.process(pdf[score].to_numpy())
        return pdf[carried].assign(pred=flag, threshold=threshold, trend=trend)

    schema = f"{_ddl(scores, carried)}, pred int, threshold double, trend double"
    return keyed_scan(scores.select(*carried), keys, make, advance, schema, seq, segment_rows)


def dspot_evaluation(scores: DataFrame, warmup: int = 1000, target: int | None = None, keys: Sequence[str] = ("stream_id", "algorithm"),
                     **settings) -> DataFrame:
    """DSPOT on every scored stream and algorithm, then f1, precision, recall after the warm-up for all of them."""
    alerts = dspot(scores, keys, warmup=warmup, keep=["truth"], **settings)
    return cumulative_report(alerts, warmup, target, by=list(keys))


def _trials(grid: Sequence[tuple[float, int, float]], warmup: int, settings: dict) -> dict[str, DspotStep]:
    return {str(i): DspotStep(float(q), int(d), float(t), warmup, **settings) for i, (q, d, t) in enumerate(grid)}


def dspot_trials(scores: DataFrame, grid: Sequence[tuple[float, int, float]], warmup: int = 1000, keys: Sequence[str] = ("stream_id",),
                 keep: Sequence[str] = (), **settings) -> DataFrame:
    """The alerts of every (q, depth, t_quantile): (keys, seq, kept columns, ``_trial``: its place in the grid, as text, pred, threshold, trend).
    All trials step side by side over a stream's rows, which are shuffled once."""
    return run_steps(scores, _trials(grid, warmup, settings), _keys(keys), keep=keep, reads=["score"], label="_trial")


def dspot_sweep(scores: DataFrame, grid: Sequence[tuple[float, int, float]], warmup: int = 1000, target: int | None = None,
                keys: Sequence[str] = ("stream_id",), **settings) -> DataFrame:
    """One line per stream and (q, depth, t_quantile): the report of ``dspot_trials``. Alerts are counted where they are made, so a
    stream is stepped once and only counts leave its task."""
    keys = _keys(keys)

    def counted(alerts: pd.DataFrame) -> pd.DataFrame:
        alerts = alerts.assign(_early=~(alerts["seq"] >= warmup).fillna(False).astype(bool))
        out = alerts.groupby(["_trial", "truth", "pred", "_early"], dropna=False, sort=False).agg(n=("pred", "size"), _last=("seq", "max")).reset_index()
        return out.assign(truth=out["truth"].astype(alerts["truth"].dtype), **{k: alerts[k].iloc[[0] * len(out)].array for k in keys})

    schema = f"{_ddl(scores, [*keys, 'truth'])}, _trial string, pred int, _early boolean, n long, _last {dict(scores.dtypes)['seq']}"
    counts = run_steps(scores, _trials(grid, warmup, settings), keys, keep=["truth"], reads=["score"], label="_trial", fold=(counted, schema))
    # the first rows are left out of streams that go beyond them, as in exclude_warmup
    longest = F.max("_last").over(Window.partitionBy(*keys, "_trial"))
    counts = counts.withColumn("_longest", longest).filter(~F.col("_early") | (F.col("_longest") < warmup))
    report = metrics_from_confusion(counts.groupBy(*keys, "_trial", "truth", "pred").agg(F.sum("n").alias("n")), target, [*keys, "_trial"])
    cells = scores.sparkSession.createDataFrame([(str(i), i, float(q), int(d), float(t)) for i, (q, d, t) in enumerate(grid)],
                                                "_trial string, trial int, q double, depth int, t_quantile double")
    out = report.join(F.broadcast(cells), "_trial")
    return out.select(*keys, "trial", "q", "depth", "t_quantile", "f1", "precision", "recall")


def contamination_evolution(scores: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("stream_id",), **settings) -> DataFrame:
    """Every contamination level (the stream key) in one table: score, fixed and DSPOT decision, threshold, trend.

    Both decisions stand on the same row, so no join is needed to compare them.
    """
    kept = [c for c in scores.columns if c not in (*_keys(keys), "seq", "score")]
    out = dspot(scores, keys, keep=kept, **settings).withColumnRenamed("pred", "pred_dspot")
    return out.withColumn("pred_fixed", discretize(F.col("score"), threshold))


def evt_excess_summary(scores: DataFrame, warmup: int, depth: int = 50, t_quantile: float = 0.98, keys: Sequence[str] = ("stream_id",),
                       seq: str = "seq", score: str = "score") -> DataFrame:
    """DSPOT's first level per stream as plain aggregation: t, peaks above it (count, mean, variance), rows used.

    Only the warm-up rows take part, so a stream of any length adds at most ``warmup`` rows to a group.
    """
    keys = _keys(keys)
    rows = scores.filter(F.col(seq) < warmup).select(*keys, seq, F.col(score).alias("x"))
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-depth, -1)
    shift = F.col("x") - F.avg("x").over(before) if warmup > depth else F.col("x")
    rows = rows.withColumn("xp", shift).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = rows.filter(F.col("_n") == warmup)
    if warmup > depth:
        rows = rows.filter(F.col(seq) >= depth)
    level = F.percentile("xp", F.lit(t_quantile)).over(Window.partitionBy(*keys))
    rows = rows.withColumn("t", level)
    peak = F.when(F.col("xp") > F.col("t"), F.col("xp") - F.col("t"))
    return rows.groupBy(*keys).agg(F.max("t").alias("t"), F.count(peak).alias("n_peaks"), F.avg(peak).alias("mean_excess"),
                                   F.var_pop(peak).alias("var_excess"), F.count(F.lit(1)).alias("k"))
