"""Every query of the library with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_views

MODULES = ("q_seeds", "q_build", "q_labels", "q_layout", "q_rest")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if SQL can say it; fixture views are put in front."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
