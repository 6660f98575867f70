"""Keyed writes: new rows, changed rows, audit flags, index messages and their rollback.

Every function returns the new table; the caller writes it to a new path. Updates carry one role per key:
where a batch lists a key twice, the first by ``position`` (or the lowest role id) counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators.skew import join_hot
from titleloom.session import written_once


def one_per_key(updates: DataFrame, keys: Sequence[str], position: str | None = None) -> DataFrame:
    """``keys, cargo_id``: the first listed role of each key."""
    order = F.struct(position, "cargo_id") if position else F.col("cargo_id")
    return updates.groupBy(*keys).agg(F.min_by("cargo_id", order).alias("cargo_id"))


def values_union(*batches: DataFrame) -> DataFrame:
    """All rows of several batches, repeats kept."""
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch)
    return result


def new_rows(target: DataFrame, updates: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """Update rows whose key the target does not have."""
    return one_per_key(updates, [key], position).join(target.select(key).distinct(), key, "left_anti")


def insert_missing(target: DataFrame, updates: DataFrame, key: str, position: str | None = None) -> DataFrame:
    return target.unionByName(new_rows(target, updates, key, position), allowMissingColumns=True)


def insert_missing_with_parent(
    target: DataFrame, updates: DataFrame, parent: DataFrame, key: str, position: str | None = None
) -> DataFrame:
    """As ``insert_missing``, only for keys that the parent table has."""
    added = new_rows(target, updates, key, position).join(parent.select(key).distinct(), key, "left_semi")
    return target.unionByName(added, allowMissingColumns=True)


def update_existing(target: DataFrame, updates: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """The target with the role of every listed key set."""
    changes = one_per_key(updates, [key], position).select(key, F.col("cargo_id").alias("__new"))
    joined = join_hot(target, changes, [key])
    return joined.withColumn("cargo_id", F.coalesce("__new", "cargo_id")).select(*target.columns)


def write_roles(
    target: DataFrame, updates: DataFrame, key: str, parent: DataFrame | None = None, position: str | None = None
) -> DataFrame:
    """The target after inserting the new keys (with a parent, if one is named) and updating the others."""
    changed = update_existing(target, updates, key, position)
    added = new_rows(target, updates, key, position)
    if parent is not None:
        added = added.join(parent.select(key).distinct(), key, "left_semi")
    return changed.unionByName(added, allowMissingColumns=True)


def upsert_flags(
    flags: DataFrame, updates: DataFrame, keys: Sequence[str], now, position: str | None = None
) -> DataFrame:
    """The audit table with one row per key: listed keys get the new role and time. Missing ids become 0."""
    zeroed = updates.select(
        *[F.coalesce(k, F.lit(0)).alias(k) for k in keys],
        F.coalesce("cargo_id", F.lit(0)).alias("cargo_id"),
        *([position] if position else []),
    )
    moment = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    fresh = one_per_key(zeroed, keys, position).withColumn("data_atualizacao", moment)
    kept = flags.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*flags.columns))


def _batches(ids: DataFrame, id_column: str) -> DataFrame:
    """Distinct ids with ``batch``: in order, 100 ids per batch, only the last may hold fewer.

    The ids are cut into ranges and written, so that a repeated task numbers the same rows. A task numbers the ids of
    one range; what lies before a range comes from one count per range. Rows without an id are left out.
    """
    spark = ids.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written_once(
        ids.select(id_column).filter(F.col(id_column).isNotNull()).distinct()
        .repartitionByRange(ranges, id_column).withColumn("range", F.spark_partition_id()),
        "ids",
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: no more than there are shuffle partitions.
    starts = cut.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("range").orderBy(id_column)) - 1
    return cut.withColumn("place", place).join(F.broadcast(starts), "range").select(
        id_column, F.floor((F.col("before") + F.col("place")) / fv.MESSAGE_BATCH).alias("batch")
    )


def job_index_messages(jobs: DataFrame, id_column: str = "vag_id") -> DataFrame:
    """``batch, message``: jobs to index again, 100 per message."""
    event = F.struct(F.col(id_column).alias("vag_id"), F.lit(fv.ACTIVE_STATUS).alias("new_status"))
    grouped = _batches(jobs, id_column).groupBy("batch").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return grouped.select("batch", F.to_json(F.struct("events")).alias("message"))


def user_index_messages(users: DataFrame, id_column: str = "usr_id") -> DataFrame:
    """``batch, message``: users to index again, 100 per message."""
    grouped = _batches(users, id_column).groupBy("batch").agg(
        F.array_sort(F.collect_list(id_column)).alias("usr_ids")
    )
    return grouped.select("batch", F.to_json(F.struct("usr_ids")).alias("message"))


def _flagged(flags: DataFrame, first_day: str | None, last_day: str | None) -> DataFrame:
    """Audit rows of a range of days, both included; without a range all of them."""
    if not (first_day and last_day):
        return flags
    at = F.col("data_atualizacao")
    return flags.filter(
        (at >= F.lit(first_day).cast("timestamp")) & (at < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp"))
    )


def _rolled_back(roles: DataFrame, flagged: DataFrame, key: str, dry_run: bool) -> DataFrame:
    marked = flagged.select(key).distinct().withColumn("__back", F.lit(True))
    joined = join_hot(roles, marked, [key]).withColumn("rolled_back", F.coalesce("__back", F.lit(False)))
    if not dry_run:
        joined = joined.withColumn("cargo_id", F.when(F.col("rolled_back"), 0).otherwise(F.col("cargo_id")))
    return joined.select(*roles.columns, "rolled_back")


def rollback_users(
    flags: DataFrame,
    cv_roles: DataFrame,
    work_exp_roles: DataFrame,
    first_day: str | None = None,
    last_day: str | None = None,
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """CV roles and work experience roles with the roles that the routine set in a range of days back at 0.

    Flags without a work experience stand for CVs. ``rolled_back`` marks the rows; a dry run only marks them.
    """
    chosen = _flagged(flags, first_day, last_day)
    return (
        _rolled_back(cv_roles, chosen.filter(F.col("curexpprof_id") == 0), "cur_id", dry_run),
        _rolled_back(work_exp_roles, chosen.filter(F.col("curexpprof_id") != 0), "curexpprof_id", dry_run),
    )


def rollback_jobs(
    flags: DataFrame,
    job_roles: DataFrame,
    first_day: str | None = None,
    last_day: str | None = None,
    dry_run: bool = False,
) -> DataFrame:
    return _rolled_back(job_roles, _flagged(flags, first_day, last_day), "vag_id", dry_run)
