"""Rows that still have no role: jobs, CVs and work experiences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators.skew import join_hot, keep_hot
from titleloom.operators.windows import recent_jobs_filter


def _without_role(rows: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """Rows with no role row at all, or with one that holds null or 0.

    Role rows are brought to one per key before the join.
    """
    state = roles.groupBy(key).agg(F.bool_or(F.coalesce("cargo_id", F.lit(0)) == 0).alias("__open"))
    return rows.join(state, key, "left").filter(F.coalesce("__open", F.lit(True))).drop("__open")


def _of_organisation(table: DataFrame) -> DataFrame:
    return table.filter(F.col("organizacao_id") == fv.OWN_ORGANISATION)


def pending_jobs(jobs: DataFrame, job_display: DataFrame, job_roles: DataFrame, as_of=None) -> DataFrame:
    """Distinct ``job_id, title`` of active jobs of the own organisation without a role.

    With ``as_of`` only jobs of the months that the routine looks back on. To work on date windows, pass jobs
    that went through ``weekly_windows``.
    """
    open_jobs = jobs.filter((F.col("status") == fv.ACTIVE_STATUS) & (F.col("titulo") != ""))
    if as_of is not None:
        open_jobs = recent_jobs_filter(open_jobs, "data_entrada", as_of)
    shown = _of_organisation(job_display).select("vag_id").distinct()
    return (
        _without_role(open_jobs.join(shown, "vag_id", "left_semi"), job_roles, "vag_id")
        .select(F.col("vag_id").alias("job_id"), F.col("titulo").alias("title"))
        .distinct()
    )


def _active_users(users: DataFrame) -> DataFrame:
    return _of_organisation(users.filter(F.col("status") == fv.ACTIVE_STATUS)).select("usr_id").distinct()


def pending_cvs(users: DataFrame, cvs: DataFrame, cv_roles: DataFrame) -> DataFrame:
    """Distinct ``user_id, cv_id, title`` of active users' CVs without a role."""
    with_text = keep_hot(cvs.filter(F.col("objetivo") != ""), _active_users(users), ["usr_id"])
    return (
        _without_role(with_text, cv_roles, "cur_id")
        .select(
            F.col("usr_id").alias("user_id"), F.col("cur_id").alias("cv_id"),
            F.col("objetivo").alias("title"),
        )
        .distinct()
    )


def pending_work_exp(users: DataFrame, cvs: DataFrame, work_exp: DataFrame, work_exp_roles: DataFrame) -> DataFrame:
    """Distinct ``user_id, cv_id, work_exp_id, title`` of work experiences without a role."""
    active = keep_hot(cvs.select("usr_id", "cur_id").distinct(), _active_users(users), ["usr_id"])
    with_text = join_hot(work_exp.filter(F.col("cargo") != ""), active, ["cur_id"], "inner")
    return (
        _without_role(with_text, work_exp_roles, "curexpprof_id")
        .select(
            F.col("usr_id").alias("user_id"), F.col("cur_id").alias("cv_id"),
            F.col("curexpprof_id").alias("work_exp_id"), F.col("cargo").alias("title"),
        )
        .distinct()
    )
