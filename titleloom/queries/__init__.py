"""Registered queries: every operator on the provided tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found.update(module.ORACLES)
    return found


def _modules():
    from titleloom.queries import coverage, embedding, inference, matching, routines, sources, spelling, streams, text
    from titleloom.queries import vocabulary

    return [sources, text, vocabulary, matching, embedding, spelling, inference, routines, coverage, streams]
