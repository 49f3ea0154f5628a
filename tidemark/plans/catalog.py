"""Named queries: each pairs a Spark plan with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function under a name, with its oracle."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# the modules below register themselves
from tidemark.plans import backtests, cohort, features, landed, market, more, rows, studies  # noqa: E402, F401
