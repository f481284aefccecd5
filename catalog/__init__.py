"""Registered queries by topic. Each module holds QUERIES (Spark) and ORACLE (DuckDB SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ordered", "prepared", "evaluated", "stateful", "scored", "learned", "live", "stepped", "facts", "jobs"]


def _merged(part: str) -> dict:
    out = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"catalog.{name}"), part).items():
            if key in out:
                raise KeyError(f"query {key} is registered twice")
            out[key] = value
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
