"""The catalogue of known roles under their normalized titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.operators.normalize import CATALOGUE_STEPS, normalize_title
from titleloom.sources.gazetteers import Gazetteer

ID_COLUMNS = ("areap_ids", "nivelh_ids", "perfil_ids")
ROLE_COLUMNS = ("role_id", "title", "source", "seniorities", "hierarchies", *ID_COLUMNS)


def normalize_catalogue(
    roles: DataFrame, lists: Gazetteer, id_mapping: DataFrame | None = None, verbs: DataFrame | None = None
) -> DataFrame:
    """Roles (``role_id, title, source``) with ``processed_title``, seniorities, hierarchies and id lists."""
    done = normalize_title(roles, lists, CATALOGUE_STEPS, verbs=verbs).withColumnRenamed("norm_title", "processed_title")
    nothing = F.array().cast("array<int>")
    if id_mapping is None:
        return done.select("*", *[nothing.alias(c) for c in ID_COLUMNS])
    ids = id_mapping.select(F.col("id").alias("role_id"), *ID_COLUMNS)
    joined = done.join(ids, "role_id", "left")
    return joined.select(*done.columns, *[F.coalesce(c, nothing).alias(c) for c in ID_COLUMNS])


def _first_role(roles: DataFrame) -> DataFrame:
    """One role per normalized title: the lowest id, then the first title."""
    role = F.struct(*ROLE_COLUMNS)
    picked = roles.groupBy("processed_title").agg(F.min_by(role, F.struct("role_id", "title")).alias("role"))
    return picked.select("processed_title", "role.*")


def dedupe_main(roles: DataFrame) -> DataFrame:
    return _first_role(roles.filter(F.col("source") == "main"))


def dedupe_similar(roles: DataFrame, main: DataFrame) -> DataFrame:
    """Alternate titles that no main role has."""
    return _first_role(roles.filter(F.col("source") == "similar")).join(main, "processed_title", "left_anti")


def build_catalogue(
    roles: DataFrame, lists: Gazetteer, id_mapping: DataFrame | None = None, verbs: DataFrame | None = None
) -> DataFrame:
    """One role per normalized title, main roles before alternate titles. An empty title names no role.

    A main row wins over any alternate one, so both picks are one grouping.
    """
    done = normalize_catalogue(roles, lists, id_mapping, verbs).filter(F.col("processed_title") != "")
    order = F.struct(F.when(F.col("source") == "main", 0).otherwise(1), "role_id", "title")
    picked = done.groupBy("processed_title").agg(F.min_by(F.struct(*ROLE_COLUMNS), order).alias("role"))
    return picked.select("processed_title", "role.*")
