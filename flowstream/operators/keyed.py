"""Serial operators per stream: run a step object over each key's rows in order, in bounded pieces.

One job sorts the rows by stream and position; a stream's rows then pass through its task as they are read, in segments of
at most ``segment_rows`` positions, and only its state and one segment are held. So the length of a stream costs
neither memory nor further jobs, and the result equals one uninterrupted run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.session import spread_by

SEGMENT_ROWS = 100_000


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in cols)


def _segments(batches: Iterator[pd.DataFrame], seq: str, segment_rows: int) -> Iterator[pd.DataFrame]:
    """The batches of one stream, in order, as whole segments. Streams are often short, so nothing is copied for one batch."""
    held, current = [], None

    def whole() -> pd.DataFrame:
        return held[0].reset_index(drop=True) if len(held) == 1 else pd.concat(held, ignore_index=True)

    for pdf in batches:
        at = pdf[seq].to_numpy(dtype=float, na_value=np.inf) // segment_rows if pdf[seq].hasnans else pdf[seq].to_numpy() // segment_rows
        cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1), len(pdf)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and at[i] != current:
                yield whole()
                held = []
            held.append(pdf if j - i == len(pdf) else pdf.iloc[i:j])
            current = at[i]
    if held:
        yield whole()


def keyed_scan(df: DataFrame, keys: Sequence[str], make: Callable[[tuple], object], advance: Callable[[object, pd.DataFrame], pd.DataFrame],
               schema: str, seq: str = "seq", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``make(key)`` starts a state, ``advance(state, rows)`` consumes rows sorted by ``seq`` and returns output rows
    of ``schema`` (which includes the keys)."""
    keys = list(keys)

    def run(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = make(key), -np.inf
        for rows in _segments(batches, seq, segment_rows):
            at = rows[seq].to_numpy(dtype=float, na_value=np.inf)
            if at[0] < last or (at[1:] < at[:-1]).any():
                raise AssertionError("rows of a stream came out of order")
            last = at[-1]
            yield advance(state, rows)

    rows = spread_by(df, keys).sortWithinPartitions(*keys, F.col(seq).asc_nulls_last())
    return rows.groupBy(*keys).applyInPandas(run, schema)
