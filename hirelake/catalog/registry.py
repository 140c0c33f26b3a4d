"""Where each catalog module registers its queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.standins import Stage, with_views

_QUERIES: dict[str, Callable[[Stage], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(stage)`` under ``name``; ``oracle`` is the equal SQL over tables and views."""

    def keep(fn: Callable[[Stage], DataFrame]):
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return keep


def _bind(fn: Callable[[Stage], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Stage(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
