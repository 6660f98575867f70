"""Read and write plain tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant_table(spark: SparkSession, schema: str, rows: Iterable[tuple]) -> DataFrame:
    """A small table written into the plan itself. ``schema`` as in ``name type, name type``."""
    names = [column.split()[0] for column in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    fields = ",".join(f"{n}:{c.split(None, 1)[1].strip()}" for n, c in zip(names, schema.split(",")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def read_table(spark: SparkSession, path: str, file_format: str = "parquet", **options: str) -> DataFrame:
    """A table from files (parquet, orc, csv, json, ...)."""
    return spark.read.format(file_format).options(**options).load(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A database table. With a numeric column and its bounds, partitions read side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def write_table(table: DataFrame, path: str, file_format: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a table to a new path. Operators never rewrite what they read."""
    writer = table.write.mode("errorifexists").format(file_format)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
