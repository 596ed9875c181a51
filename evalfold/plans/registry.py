"""Where queries register themselves with their DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name; `oracle` is the same in DuckDB's SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put
