"""Known roles and the id lists attached to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_LISTS = "struct<areap_ids:array<int>,nivelh_ids:array<int>,perfil_ids:array<int>>"


def _valid_roles(table: DataFrame, source: str) -> DataFrame:
    return table.filter((F.col("cargo_id") > 0) & (F.col("titulo") != "")).select(
        F.col("cargo_id").alias("role_id"), F.col("titulo").alias("title"), F.lit(source).alias("source")
    )


def read_main_roles(table: DataFrame) -> DataFrame:
    """``role_id, title, source`` of the main titles; ids must be positive and titles not empty.

    Rows are not sorted: operators that pick a first role order by ``role_id`` themselves.
    """
    return _valid_roles(table, "main")


def read_similar_roles(table: DataFrame) -> DataFrame:
    """As ``read_main_roles``, for the alternate titles."""
    return _valid_roles(table, "similar")


def id_mapping_of(documents: DataFrame) -> DataFrame:
    """``id, areap_ids, nivelh_ids, perfil_ids`` from JSON texts (column ``value``) keyed by id."""
    parsed = documents.select(F.from_json("value", f"map<string,{ID_LISTS}>").alias("ids"))
    return parsed.select(F.explode("ids").alias("id", "lists")).select(F.col("id").cast("int").alias("id"), "lists.*")


def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    return id_mapping_of(spark.read.text(path, wholetext=True))
