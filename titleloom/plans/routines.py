"""The batch routine: pending rows in; roles, audit flags, messages and counts out.

Five outputs read the matched rows, so these are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.operators.matching import ab_group_filter, first_match, match_pieces
from titleloom.operators.normalize import Steps
from titleloom.operators.skew import join_hot
from titleloom.operators.windows import user_windows, weekly_windows
from titleloom.operators.writeback import job_index_messages, upsert_flags, user_index_messages, write_roles
from titleloom.session import written_once
from titleloom.sources.gazetteers import Gazetteer
from titleloom.sources.pending import pending_cvs, pending_jobs, pending_work_exp


@dataclass(frozen=True)
class RoutineResult:
    """Tables of one run. ``counts`` has one row: total, eligible, normalized, written."""

    normalized: DataFrame
    roles: DataFrame
    flags: DataFrame
    messages: DataFrame
    counts: DataFrame


def with_first_role(
    rows: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    how: str = "left",
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Rows with a ``title``, plus the ``role_id`` of its first matched piece."""
    roles = first_match(match_pieces(rows, catalogue, lists, steps, vocabulary, verbs=verbs, dictionary=dictionary))
    return join_hot(rows, roles, ["title"], how)


def routine_counts(rows: DataFrame, key: str, parent: DataFrame | None = None) -> DataFrame:
    """``total, eligible, normalized, written`` of rows with ``eligible`` and ``role_id``.

    Normalized rows are written unless a parent is named that does not hold their key.
    """
    done = F.col("eligible") & F.col("role_id").isNotNull()
    if parent is None:
        marked = rows.withColumn("__held", F.lit(True))
    else:
        marked = join_hot(rows, parent.select(key).distinct().withColumn("__held", F.lit(True)), [key])
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(done).alias("normalized"),
        F.count_if(done & F.col("__held")).alias("written"),
    )


def pending_with_roles(
    pending: DataFrame,
    id_column: str,
    catalogue: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    assignments: DataFrame | None = None,
    group: str = "b",
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Pending rows with ``eligible`` (by test group, if assignments are given) and the ``role_id`` found."""
    if assignments is None:
        rows = pending.withColumn("eligible", F.lit(True))
    else:
        members = ab_group_filter(pending.select(id_column).distinct(), assignments, id_column, group)
        rows = join_hot(pending, members.withColumn("__in", F.lit(True)), [id_column]).withColumn(
            "eligible", F.coalesce("__in", F.lit(False))
        ).drop("__in")
    return with_first_role(rows, catalogue, lists, steps, vocabulary, verbs=verbs, dictionary=dictionary)


def normalize_pending_jobs(
    pending: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    job_roles: DataFrame,
    flags: DataFrame,
    now,
    **options,
) -> RoutineResult:
    """Run the job routine on ``pending_jobs`` rows. Options as in ``pending_with_roles``."""
    rows = written_once(pending_with_roles(pending, "job_id", catalogue, lists, **options), "pending-jobs")
    rows = rows.withColumnRenamed("job_id", "vag_id")
    return _result(rows, "vag_id", ["vag_id"], job_roles, None, flags, now, job_index_messages)


def normalize_pending_cvs(
    pending: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    cv_roles: DataFrame,
    flags: DataFrame,
    now,
    **options,
) -> RoutineResult:
    """Run the CV routine on ``pending_cvs`` rows; flags carry 0 as work experience."""
    rows = written_once(pending_with_roles(pending, "user_id", catalogue, lists, **options), "pending-cvs")
    rows = rows.withColumnsRenamed({"user_id": "usr_id", "cv_id": "cur_id"}).withColumn("curexpprof_id", F.lit(0))
    return _result(
        rows, "cur_id", ["usr_id", "cur_id", "curexpprof_id"], cv_roles, None, flags, now, user_index_messages
    )


def normalize_pending_work_exp(
    pending: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    work_exp_roles: DataFrame,
    work_exp: DataFrame,
    flags: DataFrame,
    now,
    **options,
) -> RoutineResult:
    """Run the work experience routine; rows are only inserted for work experiences that exist."""
    rows = written_once(pending_with_roles(pending, "user_id", catalogue, lists, **options), "pending-work-exp")
    rows = rows.withColumnsRenamed({"user_id": "usr_id", "cv_id": "cur_id", "work_exp_id": "curexpprof_id"})
    keys = ["usr_id", "cur_id", "curexpprof_id"]
    return _result(rows, "curexpprof_id", keys, work_exp_roles, work_exp, flags, now, user_index_messages)


def run_jobs_routine(
    jobs: DataFrame,
    job_display: DataFrame,
    role_rows: DataFrame,
    as_of,
    catalogue: DataFrame,
    lists: Gazetteer,
    target: DataFrame,
    flags: DataFrame,
    **options,
) -> RoutineResult:
    """The job routine on the jobs of the last 24 weeks that ``role_rows`` show as open."""
    recent = weekly_windows(jobs, "data_entrada", as_of).drop("window")
    pending = pending_jobs(recent, job_display, role_rows, as_of)
    return normalize_pending_jobs(pending, catalogue, lists, target, flags, as_of, **options)


def run_cvs_routine(
    users: DataFrame,
    cvs: DataFrame,
    role_rows: DataFrame,
    as_of,
    catalogue: DataFrame,
    lists: Gazetteer,
    target: DataFrame,
    flags: DataFrame,
    **options,
) -> RoutineResult:
    """The CV routine on the CVs changed within the 31 windows."""
    recent = user_windows(cvs, "data_alteracao", as_of).drop("window")
    pending = pending_cvs(users, recent, role_rows)
    return normalize_pending_cvs(pending, catalogue, lists, target, flags, as_of, **options)


def run_work_exp_routine(
    users: DataFrame,
    cvs: DataFrame,
    work_exp: DataFrame,
    role_rows: DataFrame,
    as_of,
    catalogue: DataFrame,
    lists: Gazetteer,
    target: DataFrame,
    flags: DataFrame,
    **options,
) -> RoutineResult:
    """The work experience routine on those of CVs changed within the 31 windows."""
    recent = user_windows(cvs, "data_alteracao", as_of).drop("window")
    pending = pending_work_exp(users, recent, work_exp, role_rows)
    return normalize_pending_work_exp(pending, catalogue, lists, target, work_exp, flags, as_of, **options)


def _result(
    rows: DataFrame,
    key: str,
    flag_keys: Sequence[str],
    target: DataFrame,
    parent: DataFrame | None,
    flags: DataFrame,
    now,
    messages,
) -> RoutineResult:
    done = rows.filter(F.col("eligible") & F.col("role_id").isNotNull()).withColumnRenamed("role_id", "cargo_id")
    return RoutineResult(
        normalized=done,
        roles=write_roles(target, done.select(key, "cargo_id"), key, parent),
        flags=upsert_flags(flags, done.select(*flag_keys, "cargo_id"), flag_keys, now),
        messages=messages(done),
        counts=routine_counts(rows, key, parent),
    )
