"""Step plug-ins on live data: the same objects as in ``flowstream.operators.steps``, with their state in Spark's state store.

Rows of a stream wait in the state until the watermark has passed them; a timer then hands them over in order of time and ``seq``.
So the results don't depend on how the input falls into micro-batches, and equal the batch form over the rows
that were in time. Rows later than the delay are dropped by Spark and counted in the query's progress. A null key is a
stream like any other. A row without ``seq`` only tells the time: it moves the watermark and gives no output, and neither does a row without a time.

State per key: the pickled plug-in states, the waiting rows as a list of chunks (an arriving chunk is appended, nothing is read), and
the time of the next timer. The state store must be RocksDB, which ``steps_stream`` sets where the session still has
Spark's default.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pandas.api.extensions import ExtensionDtype
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowstream.operators.drift import STATES, AdwinStep, DdmStep
from flowstream.operators.keyed import _ddl
from flowstream.operators.ordering import _keys
from flowstream.operators.steps import Step, advance, output_names, start

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK_ROWS = 50_000  # waiting rows in one value of the state


def with_rocksdb(spark: SparkSession) -> None:
    """Use RocksDB for state, unless the session names a provider of its own."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy(dtype="datetime64[us]").astype(np.int64)


def _packed(rows: pd.DataFrame) -> bytes:
    """The columns as arrays: a table of its own would cost more than the few rows that a stream often has in a micro-batch."""
    return pickle.dumps({c: rows[c].array if isinstance(rows[c].dtype, ExtensionDtype) else rows[c].to_numpy() for c in rows.columns}, pickle.HIGHEST_PROTOCOL)


def _unpacked(blobs: Iterable[bytes]) -> pd.DataFrame | None:
    chunks = [pd.DataFrame(pickle.loads(blob), copy=False) for blob in blobs]
    if not chunks:
        return None
    return chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)


def _in_order(rows: pd.DataFrame, ts: str, seq: str) -> pd.DataFrame:
    if not pd.api.types.is_numeric_dtype(rows[seq].dtype) or isinstance(rows[seq].dtype, ExtensionDtype):
        return rows.sort_values([ts, seq], kind="stable", ignore_index=True)
    order = np.lexsort((rows[seq].to_numpy(), _micros(rows[ts])))
    return rows if (order[1:] > order[:-1]).all() else rows.iloc[order].reset_index(drop=True)


class _Stepper(StatefulProcessor):
    def __init__(self, plugins: dict[str, Step], inputs: list[str], ts: str, seq: str, carried: list[str], label: str, names: list[str]):
        self.plugins, self.inputs, self.ts, self.seq, self.carried, self.label, self.names = plugins, inputs, ts, seq, carried, label, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "blob binary")
        self.waiting = handle.getListState("waiting", "blob binary")
        self.wake = handle.getValueState("wake", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = False
        earliest = None
        for pdf in rows:
            pdf = pdf.set_axis(self.inputs, axis=1)  # Spark renames columns that begin with an underscore
            real = pdf[self.seq].notna().to_numpy() & pdf[self.ts].notna().to_numpy()
            if not real.all():
                pdf = pdf[real]
            if not len(pdf):
                continue
            first = int(_micros(pdf[self.ts]).min())
            earliest = first if earliest is None else min(earliest, first)
            due = due or first <= passed * 1000
            for at in range(0, len(pdf), CHUNK_ROWS):
                self.waiting.appendValue((_packed(pdf.iloc[at:at + CHUNK_ROWS]),))
        if due:
            yield from self._hand_over(key, passed)
        elif earliest is not None:
            self._wake_at(-(-earliest // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._hand_over(key, timerValues.getCurrentWatermarkInMs())

    def _wake_at(self, millis: int) -> None:
        planned = self.wake.get()
        if planned is None or millis < planned[0]:
            self.wake.update((millis,))
            self.handle.registerTimer(millis)

    def _hand_over(self, key, passed: int) -> Iterator[pd.DataFrame]:
        rows = _unpacked(blob for (blob,) in self.waiting.get())
        if rows is None:
            return
        ready = _micros(rows[self.ts]) <= passed * 1000
        self.waiting.clear()
        if ready.all():
            self.wake.clear()
        else:
            later = rows[~ready]
            self.waiting.put([(_packed(later.iloc[at:at + CHUNK_ROWS]),) for at in range(0, len(later), CHUNK_ROWS)])
            millis = -(-int(_micros(later[self.ts]).min()) // 1000)
            self.wake.update((millis,))
            self.handle.registerTimer(millis)
            rows = rows[ready]
        if len(rows):
            now = _in_order(rows.reset_index(drop=True), self.ts, self.seq)
            known = self.states.get()
            states = start(self.plugins, tuple(key)) if known is None else pickle.loads(known[0])
            out = advance(self.plugins, states, now, self.carried, self.label, self.names)
            self.states.update((cloudpickle.dumps(states),))
            wanted = [*self.carried, self.label, *self.names]
            yield out if out.columns.tolist() == wanted else out[wanted]

    def close(self) -> None:
        pass


def steps_stream(stream: DataFrame, plugins: dict[str, Step], keys=("stream_id",), ts: str = "ts", delay: str = "10 seconds", seq: str = "seq",
                 keep: Sequence[str] = (), reads: Sequence[str] = (), label: str = "algorithm") -> DataFrame:
    """All plug-ins over each live stream: (keys, seq, kept columns, ``label``, outputs), each row once its time has passed."""
    keys = _keys(keys)
    if not keys:
        raise ValueError("a live run needs stream keys; a constant column makes the whole input one stream")
    with_rocksdb(stream.sparkSession)
    names = output_names(plugins)
    carried = list(dict.fromkeys([*keys, seq, *keep]))
    rows = stream.select(*dict.fromkeys([*carried, *reads, ts])).withWatermark(ts, delay)
    schema = f"{_ddl(stream, carried)}, `{label}` string, {next(iter(plugins.values())).outputs}"
    stepper = _Stepper(plugins, rows.columns, ts, seq, carried, label, names)
    return rows.groupBy(*keys).transformWithStateInPandas(stepper, schema, "append", "EventTime")


def ddm_stream(errors: DataFrame, keys=("stream_id",), warning: float = 2.0, ts: str = "ts", delay: str = "10 seconds", seq: str = "seq",
               error: str = "error") -> DataFrame:
    """Live form of ``ddm``: the state of every row."""
    return steps_stream(errors, {"DDM": DdmStep(warning, error)}, keys, ts, delay, seq, [error], label="detector").drop("detector")


def adwin_stream(errors: DataFrame, keys=("stream_id",), delta: float = 0.002, ts: str = "ts", delay: str = "10 seconds", seq: str = "seq",
                 error: str = "error") -> DataFrame:
    """Live form of ``adwin``: the state of every row."""
    return steps_stream(errors, {"ADWIN": AdwinStep(delta, error)}, keys, ts, delay, seq, [error], label="detector").drop("detector")


def drift_monitor_stream(predictions: DataFrame, keys=("stream_id",), ts: str = "ts", delay: str = "10 seconds", seq: str = "seq", truth: str = "truth",
                         pred: str = "pred", warning: float = 2.0, delta: float = 0.002) -> DataFrame:
    """Live form of ``drift_monitor``: detections of both detectors, in one pass over the rows."""
    errors = predictions.withColumn("error", (F.col(truth) != F.coalesce(F.col(pred), F.lit(0))).cast("double"))
    found = steps_stream(errors, {"DDM": DdmStep(warning), "ADWIN": AdwinStep(delta)}, keys, ts, delay, seq, reads=["error"], label="detector")
    return found.filter(F.col("state") == STATES[-1]).select(*_keys(keys), "detector", seq)


class _GapFiller(StatefulProcessor):
    """Keeps the last window it has handed on; the windows missing before a new one come out with it."""

    def __init__(self, step: int, names: list[str], empty: dict):
        self.step, self.names, self.empty = step, names, empty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in rows if len(pdf)]
        if not parts:
            return
        closed = pd.concat(parts, ignore_index=True).sort_values("at").set_index("at")
        first = self.last.get()[0] + self.step if self.last.exists() else int(closed.index[0])
        self.last.update((int(closed.index[-1]),))
        whole = np.arange(first, int(closed.index[-1]) + 1, self.step)
        for at in range(0, len(whole), CHUNK_ROWS):
            part = whole[at:at + CHUNK_ROWS]
            known = closed.loc[part[0]:part[-1]]
            columns = {c: known[c].reindex(part, fill_value=v).to_numpy() for c, v in self.empty.items()}  # whole numbers stay whole
            yield pd.DataFrame({"at": part, **columns})[self.names]

    def close(self) -> None:
        pass


def filled_stream(summary: DataFrame, ts: str, freq: str, label: str = "Label") -> DataFrame:
    """Windows of a live summary with the missing ones between them: label BENIGN, everything else 0.

    One small row per window goes through one stateful task; the rows of a micro-batch are the windows that closed in it.
    """
    spark = summary.sparkSession
    with_rocksdb(spark)
    micros = spark.sql(f"select unix_micros(timestamp_seconds(0) + interval {freq}) as m").first().m
    others = [c for c in summary.columns if c != ts]
    rows = summary.select(F.lit(0).alias("one"), F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("at"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    kinds = dict(rows.dtypes)
    names = ["at", *[f"c{i}" for i in range(len(others))]]
    empty = {f"c{i}": "BENIGN" if c == label else "" if kinds[f"c{i}"] == "string" else 0 for i, c in enumerate(others)}
    filler = _GapFiller(micros, names, empty)
    out = rows.groupBy("one").transformWithStateInPandas(filler, ", ".join(f"{n} {kinds[n]}" for n in names), "append", "None")
    return out.select(F.timestamp_micros("at").cast(dict(summary.dtypes)[ts]).alias(ts), *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)])
