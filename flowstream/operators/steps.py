"""Plug-ins that step through a stream row after row, in batch here and live in ``flowstream.streaming.steps``.

A plug-in is any object with ``init`` and ``step`` (see ``Step``). Several of them run over the same rows in one pass: one shuffle,
one state per stream and plug-in. How the rows are cut into calls is up to the driver, so a step must not depend on it:
stepping rows a and then rows b equals stepping a and b at once.

``RowScorer`` and ``RowClassifier`` make plug-ins of objects that take one row at a time (``score_instance`` or
``predict``, and ``train``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstream.operators.keyed import SEGMENT_ROWS, _ddl, keyed_scan
from flowstream.operators.ordering import _keys


class Step(Protocol):
    """What a plug-in offers. ``outputs`` names the columns it adds, as DDL.

    A class may also offer ``step_together(plugins, states, rows)``: ``step`` for several of its plug-ins over the same rows, a list of pairs.
    """

    outputs: str

    def init(self, key: tuple) -> Any:
        """The state of a stream before its first row. Live, it is pickled between micro-batches."""

    def step(self, state: Any, rows: pd.DataFrame) -> tuple[Any, Any]:
        """The state after ``rows`` (in order), and one value per row: an array, or a dict of arrays by output column."""


def _matrix(rows: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows[c].to_numpy(dtype=float) for c in features])


@dataclass(frozen=True)
class RowScorer:
    """Test-then-train over single rows: ``make(key)`` gives an object with ``score_instance(x)`` and ``train(x)``.

    ``x`` is an array of the features. No score (None) is null; a row that ``train`` refuses with ValueError is passed over.
    """

    make: Callable[[tuple], Any]
    features: tuple[str, ...]
    outputs: str = "score double"

    def init(self, key):
        return self.make(key)

    def step(self, state, rows):
        scores = np.full(len(rows), np.nan)
        for i, x in enumerate(_matrix(rows, self.features)):
            score = state.score_instance(x)
            scores[i] = np.nan if score is None else score
            try:
                state.train(x)
            except ValueError:
                pass
        return state, scores


@dataclass(frozen=True)
class RowClassifier:
    """Test-then-train over single rows: ``make(key)`` gives an object with ``predict(x)`` and ``train(x, y)``.

    No prediction (None) is class 0. Rows without a class are predicted, not learned.
    """

    make: Callable[[tuple], Any]
    features: tuple[str, ...]
    target: str = "class_idx"
    outputs: str = "pred int"

    def init(self, key):
        return self.make(key)

    def step(self, state, rows):
        found = np.zeros(len(rows), dtype=np.int32)
        classes = rows[self.target].to_numpy(dtype=float, na_value=np.nan)
        for i, (x, y) in enumerate(zip(_matrix(rows, self.features), classes)):
            pred = state.predict(x)
            found[i] = 0 if pred is None else pred
            if not np.isnan(y):
                state.train(x, int(y))
        return state, found


def output_names(plugins: dict[str, Step]) -> list[str]:
    """Column names that all plug-ins add; they must agree."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = {_parse_datatype_string(p.outputs).simpleString() for p in plugins.values()}
    if len(kinds) != 1:
        raise ValueError(f"plug-ins of one run add the same columns, not {sorted(kinds)}")
    return _parse_datatype_string(next(iter(plugins.values())).outputs).fieldNames()


def start(plugins: dict[str, Step], key: tuple) -> dict[str, Any]:
    return {name: p.init(key) for name, p in plugins.items()}


def advance(plugins: dict[str, Step], states: dict[str, Any], rows: pd.DataFrame, carried: Sequence[str], label: str, names: Sequence[str]) -> pd.DataFrame:
    """Steps every plug-in over the rows, in place in ``states``: carried columns, plug-in's name, its outputs."""
    stepped = {}
    for kind in dict.fromkeys(type(p) for p in plugins.values()):
        mine = [name for name, p in plugins.items() if type(p) is kind]
        if len(mine) > 1 and hasattr(kind, "step_together"):
            stepped |= zip(mine, kind.step_together([plugins[name] for name in mine], [states[name] for name in mine], rows))
        else:
            stepped |= {name: plugins[name].step(states[name], rows) for name in mine}
    parts = []
    for name in plugins:
        states[name], got = stepped[name]
        values = got if isinstance(got, dict) else {names[0]: got}
        parts.append(pd.DataFrame({**{c: rows[c] for c in carried}, label: name, **{c: values[c] for c in names}}, index=rows.index))
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]


def run_steps(df: DataFrame, plugins: dict[str, Step], keys=(), seq: str = "seq", keep: Sequence[str] = (), reads: Sequence[str] = (),
              label: str = "algorithm", segment_rows: int = SEGMENT_ROWS, fold: tuple[Callable[[pd.DataFrame], pd.DataFrame], str] | None = None) -> DataFrame:
    """All plug-ins over each stream in order of ``seq``: (keys, seq, kept columns, ``label``, outputs).

    ``reads`` are the columns the plug-ins look at. Without keys the whole table is one stream, which is serial by definition.
    ``fold`` (with its columns as DDL) turns the output rows of a stream's segment into others where they are, such as counts.
    """
    keys = _keys(keys)
    names = output_names(plugins)
    carried = list(dict.fromkeys([*keys, seq, *keep]))
    rows = df.select(*dict.fromkeys([*carried, *reads]))
    by = keys or ["_one"]
    if not keys:
        rows = rows.withColumn("_one", F.lit(0))
    passed = [*([] if keys else ["_one"]), *carried]
    schema = f"{_ddl(rows, passed)}, `{label}` string, {next(iter(plugins.values())).outputs}"

    def begin(key):
        return start(plugins, tuple(key) if keys else ())

    def go(states, pdf: pd.DataFrame) -> pd.DataFrame:
        out = advance(plugins, states, pdf, passed, label, names)
        return fold[0](out) if fold else out

    out = keyed_scan(rows, by, begin, go, fold[1] if fold else schema, seq, segment_rows)
    return out if fold else out.select(*carried, label, *names)
