"""Keyed tables laid out by bucket, of which a change rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.operators.writeback import update_existing, upsert_flags, write_roles
from titleloom.session import new_shared_path

# Buckets of a new table: the least part of it that a change rewrites.
BUCKETS = 256
_BUCKET = "key_bucket"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def write_keyed_table(table: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a table, one folder per bucket of its keys; buckets that the path has already are replaced.

    Its columns are kept in a folder beside it, so that a table without rows can be read and changed.
    """
    table.limit(0).withColumn(_BUCKET, F.lit(0)).write.mode("overwrite").parquet(_columns(path))
    _replace(table.withColumn(_BUCKET, _bucket(keys, buckets)), path)


def _columns(path: str) -> str:
    return f"{path.rstrip('/')}.columns"


def _replace(placed: DataFrame, path: str) -> None:
    (
        placed.repartition(_BUCKET).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
    )


def read_keyed_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table of a path; with a ``schema`` also one that was never written."""
    if schema:
        return spark.read.schema(f"{schema}, {_BUCKET} int").parquet(path).drop(_BUCKET)
    return _placed(spark, path).drop(_BUCKET)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(_columns(path)).schema).parquet(path)


def _fingerprints(rows: DataFrame) -> DataFrame:
    """Per bucket the number of rows and the sum of their hashes: equal contents have equal ones, in any order."""
    columns = sorted(c for c in rows.columns if c != _BUCKET)
    # Two hashes: the second also tells apart rows that the first takes for each other.
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    return rows.groupBy(_BUCKET).agg(F.count("*").alias("n"), *sums)


def rewrite_touched(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    keys: Sequence[str],
    merged: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> list[int]:
    """Apply ``merged(part of the table, changes)`` to the buckets that hold keys of ``changes``; the buckets rewritten.

    ``merged`` returns the new rows of that part and may only add rows with keys of ``changes``. The new part is written
    beside the table first and then replaces the buckets whose contents differ. After a stop in between the same call may
    be made again: buckets replaced already come out as they are. ``buckets`` is that of ``write_keyed_table``.
    """
    staged = new_shared_path(spark, "changes")
    changes.withColumn(_BUCKET, _bucket(keys, buckets)).write.parquet(staged)
    listed = spark.read.parquet(staged)
    touched = sorted(r[_BUCKET] for r in listed.select(_BUCKET).distinct().collect())
    if not touched:
        return []
    # At most one number per bucket; the filter is on the folder's name, so that no other folder is read.
    part = _placed(spark, path).filter(F.col(_BUCKET).isin(touched))
    after = merged(part.drop(_BUCKET), listed.drop(_BUCKET)).withColumn(_BUCKET, _bucket(keys, buckets))
    beside = new_shared_path(spark, "touched")
    after.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(beside)
    new = spark.read.schema(part.schema).parquet(beside)
    old_sums, new_sums = _fingerprints(part), _fingerprints(new)
    changed = sorted(r[_BUCKET] for r in new_sums.join(old_sums, new_sums.columns, "left_anti").select(_BUCKET).collect())
    if changed:
        _replace(new.filter(F.col(_BUCKET).isin(changed)), path)
    return changed


def update_existing_at(
    spark: SparkSession, path: str, updates: DataFrame, key: str, position: str | None = None, buckets: int = BUCKETS
) -> list[int]:
    """``update_existing`` on a table of ``write_keyed_table``."""
    return rewrite_touched(spark, path, updates, [key], lambda t, u: update_existing(t, u, key, position), buckets)


def write_roles_at(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    key: str,
    parent: DataFrame | None = None,
    position: str | None = None,
    buckets: int = BUCKETS,
) -> list[int]:
    """``write_roles`` on a table of ``write_keyed_table``."""
    return rewrite_touched(spark, path, updates, [key], lambda t, u: write_roles(t, u, key, parent, position), buckets)


def upsert_flags_at(
    spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], now, position: str | None = None, buckets: int = BUCKETS
) -> list[int]:
    """``upsert_flags`` on a table of ``write_keyed_table``. Missing ids become 0 before they are placed."""
    zeroed = updates.withColumns({k: F.coalesce(k, F.lit(0)) for k in keys})
    return rewrite_touched(spark, path, zeroed, keys, lambda t, u: upsert_flags(t, u, keys, now, position), buckets)
