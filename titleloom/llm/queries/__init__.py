"""Registered queries of the corpus operators, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def llm_queries() -> dict[str, Query]:
    from titleloom.llm import pipeline
    from titleloom.llm.queries import operators

    return {**operators.QUERIES, "pipeline": pipeline.run}


def llm_oracles() -> dict[str, str]:
    from titleloom.llm import pipeline
    from titleloom.llm.queries import operators

    sql = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
    return {**operators.ORACLES, **sql}
