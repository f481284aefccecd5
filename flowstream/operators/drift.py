"""Drift detection over prediction errors."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowstream.functions.drift import CHANGE, DDM_CHANGE_LEVEL, DDM_MIN_ROWS, Adwin, Ddm
from flowstream.operators.keyed import SEGMENT_ROWS, _ddl, keyed_scan
from flowstream.operators.ordering import BLOCK_ROWS, _keys, running_sums

STATES = ["normal", "warning", "change"]


@dataclass(frozen=True)
class DdmStep:
    """DDM as a plug-in of the step drivers."""

    warning: float = 2.0
    error: str = "error"
    outputs: str = "state string"

    def init(self, key):
        return Ddm(self.warning)

    def step(self, state, rows):
        return state, [STATES[c] for c in state.process(rows[self.error].to_numpy())]


@dataclass(frozen=True)
class AdwinStep:
    """ADWIN as a plug-in of the step drivers; its buckets are the state."""

    delta: float = 0.002
    error: str = "error"
    outputs: str = "state string"

    def init(self, key):
        return Adwin(self.delta)

    def step(self, state, rows):
        return state, [STATES[c] for c in state.process(rows[self.error].to_numpy())]


def _detect(errors: DataFrame, make, keys, seq, error, segment_rows) -> DataFrame:
    keys = _keys(keys)
    carried = [*keys, seq, error]

    def advance(state, pdf: pd.DataFrame) -> pd.DataFrame:
        codes = state.process(pdf[error].to_numpy())
        return pdf[carried].assign(state=[STATES[c] for c in codes])

    return keyed_scan(errors.select(*carried), keys, make, advance, f"{_ddl(errors, carried)}, state string", seq, segment_rows)


def ddm(errors: DataFrame, keys=("stream_id",), warning: float = 2.0, seq: str = "seq", error: str = "error",
        segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """DDM state of every row: normal, warning or change (reset after a change)."""
    return _detect(errors, lambda key: Ddm(warning), keys, seq, error, segment_rows)


def adwin(errors: DataFrame, keys=("stream_id",), delta: float = 0.002, seq: str = "seq", error: str = "error",
          segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """ADWIN state of every row: normal or change."""
    return _detect(errors, lambda key: Adwin(delta), keys, seq, error, segment_rows)


def drift_monitor(predictions: DataFrame, keys=("stream_id",), seq: str = "seq", truth: str = "truth", pred: str = "pred",
                  warning: float = 2.0, delta: float = 0.002) -> DataFrame:
    """Detections of both detectors over one prediction stream: (keys, detector, seq)."""
    errors = predictions.withColumn("error", (F.col(truth) != F.coalesce(F.col(pred), F.lit(0))).cast("double"))
    found = [f(errors, keys).filter(F.col("state") == STATES[CHANGE]).select(*_keys(keys), F.lit(n).alias("detector"), seq)
             for n, f in (("DDM", lambda e, k: ddm(e, k, warning)), ("ADWIN", lambda e, k: adwin(e, k, delta)))]
    return found[0].unionByName(found[1])


def ddm_first(errors: DataFrame, by=None, change: float = DDM_CHANGE_LEVEL, min_rows: int = DDM_MIN_ROWS, seq: str = "seq",
              error: str = "error", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Position of each stream's first DDM change, by running sums and running minima in blocks.

    Unlike the row-by-row form this needs no serial pass, so one endless stream is spread over all tasks.
    """
    by = _keys(by)
    run = running_sums(errors.select(*by, seq, error), {"_e": F.col(error)}, by, seq, block_rows)
    n = F.col(seq) + 1
    run = run.withColumn("p", F.col("_e") / n).withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / n))
    live = F.when(n + 1 >= min_rows, F.struct((F.col("p") + F.col("s")).alias("ps"), (-F.col(seq)).alias("at"), "p", "s"))
    run = run.withColumn("_m", live).withColumn("_blk", F.expr(f"`{seq}` div {block_rows}"))
    lows = run.groupBy(*by, "_blk").agg(F.min("_m").alias("_low"))
    earlier = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(*by, "_blk", F.min("_low").over(earlier).alias("_low"))
    inside = Window.partitionBy(*by, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*by, "_blk"]
    lows = lows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_low")
    run = run.join(lows, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]).withColumn("_m", F.least(F.min("_m").over(inside), F.col("_low")))
    hit = (n + 1 > min_rows) & (F.col("p") + F.col("s") > F.col("_m.p") + change * F.col("_m.s"))
    return run.filter(hit).groupBy(*by).agg(F.min(seq).alias("first_change"))
