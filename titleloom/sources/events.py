"""Applies, contacts and the roles of jobs and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators.skew import first_per_key, keep_hot


def read_applies(
    applies: DataFrame,
    id_column: str,
    ids: DataFrame | None = None,
    limit: int = fv.LAST_APPLIES,
    days: int = 0,
    as_of=None,
) -> DataFrame:
    """The newest ``limit`` applies of each user or job, with their ``rank`` from 1.

    ``applies`` has ``user_id, job_id, ts, event_id``; equal times are ordered by the higher event id.
    With ``days`` only applies of that many days before ``as_of``.
    """
    if ids is not None:
        applies = keep_hot(applies, ids, [id_column])
    if days > 0:
        if as_of is None:
            raise ValueError("days needs as_of")
        applies = applies.filter(F.col("ts") > F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    return first_per_key(applies, [id_column], limit, [F.desc("ts"), F.desc("event_id")])


def read_contacts(contacts: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Contacts (``vag_id, usr_id`` and their order columns) of the given jobs."""
    return keep_hot(contacts, job_ids.select(F.col("job_id").alias("vag_id")), ["vag_id"])


def job_roles(jobs: DataFrame, roles: DataFrame, order: str | None = None) -> DataFrame:
    """``job_id, role_id``: the last role row of each job by ``order``, null where a job has none.

    Without an order column the highest role id is the last.
    """
    last = roles.groupBy("vag_id").agg(F.max_by("cargo_id", F.struct(order or "cargo_id", "cargo_id")).alias("role_id"))
    return (
        jobs.select("vag_id").distinct()
        .join(last, "vag_id", "left")
        .select(F.col("vag_id").alias("job_id"), "role_id")
    )


def user_roles(cvs: DataFrame, roles: DataFrame, order: str | None = None) -> DataFrame:
    """``user_id, role_id``: the role of the last CV row of each user, null where that has none.

    Rows are ordered by CV id, then by ``order`` of the role rows.
    """
    last = roles.groupBy("cur_id").agg(F.max_by("cargo_id", F.struct(order or "cargo_id", "cargo_id")).alias("role_id"))
    return (
        cvs.select("usr_id", "cur_id").distinct()
        .join(last, "cur_id", "left")
        .groupBy(F.col("usr_id").alias("user_id"))
        .agg(F.max_by("role_id", "cur_id").alias("role_id"))
    )
