"""Infer a role for users and jobs from what they applied to and who was contacted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators.skew import join_hot
from titleloom.session import written_once
from titleloom.sources.events import read_applies, read_contacts


def _weighted_mode(votes: DataFrame, id_column: str) -> DataFrame:
    """``id, role_id``: the role with most votes per id from rows ``role_id, times, first``.

    Null and 0 are no votes; of equally frequent roles the one seen first counts; an id without a vote gets 0.
    Votes are added up per role before roles are compared, so a busy id costs one row per role.
    """
    is_vote = F.coalesce("role_id", F.lit(0)) != 0
    counted = votes.groupBy(id_column, F.when(is_vote, F.col("role_id")).alias("role_id")).agg(
        F.sum("times").alias("votes"), F.min("first").alias("first")
    )
    # Most votes, then the earliest: the smallest of (-votes, first).
    rank = F.when(F.col("role_id").isNotNull(), F.struct(-F.col("votes"), F.col("first")))
    return counted.groupBy(id_column).agg(F.coalesce(F.min_by("role_id", rank), F.lit(0)).alias("role_id"))


def most_frequent_role(votes: DataFrame, id_column: str, order: str) -> DataFrame:
    """``id, role_id``: the most frequent ``role_id`` per id, of equal ones the first seen by ``order``."""
    single = votes.select(id_column, "role_id", F.lit(1).alias("times"), F.col(order).alias("first"))
    return _weighted_mode(single, id_column)


def _votes(events: DataFrame, roles: DataFrame, id_column: str, other_column: str, first: Column) -> DataFrame:
    """Votes of an id: the roles at the other end of its events. Ends that are unknown do not vote.

    Repeated events of the same pair are brought to one row before the join, with their number.
    """
    pairs = events.groupBy(id_column, other_column).agg(F.count("*").alias("times"), F.min(first).alias("first"))
    return join_hot(pairs, roles, [other_column], "inner", spread=[id_column])


def infer_user_roles(
    user_ids: DataFrame,
    applies: DataFrame,
    job_roles: DataFrame,
    limit: int = fv.LAST_APPLIES,
    days: int = 0,
    as_of=None,
) -> DataFrame:
    """``user_id, role_id`` of every requested user: the usual role of the last 200 jobs applied to, else 0.

    ``limit``, ``days`` and ``as_of`` say which applies count, as in ``read_applies``.
    """
    ids = user_ids.select("user_id").distinct()
    last = read_applies(applies, "user_id", ids, limit, days, as_of)
    inferred = _weighted_mode(_votes(last, job_roles, "user_id", "job_id", F.col("rank")), "user_id")
    return ids.join(inferred, "user_id", "left").select("user_id", F.coalesce("role_id", F.lit(0)).alias("role_id"))


def infer_job_roles_by_contact(job_ids: DataFrame, contacts: DataFrame, user_roles: DataFrame) -> DataFrame:
    """``job_id, role_id`` for jobs with contacted users of known role rows; 0 where those hold no role.

    ``contacts`` has ``vag_id, usr_id, ts, event_id``; the first contact is the earliest.
    """
    rows = read_contacts(contacts, job_ids).select(
        F.col("vag_id").alias("job_id"), F.col("usr_id").alias("user_id"), "ts", "event_id"
    )
    return _weighted_mode(_votes(rows, user_roles, "job_id", "user_id", F.struct("ts", "event_id")), "job_id")


def infer_job_roles_by_apply(
    job_ids: DataFrame,
    applies: DataFrame,
    user_roles: DataFrame,
    limit: int = fv.LAST_APPLIES,
    days: int = 0,
    as_of=None,
) -> DataFrame:
    """``job_id, role_id`` for jobs with applicants of known role rows, from the last 200 applies.

    ``limit``, ``days`` and ``as_of`` say which applies count, as in ``read_applies``.
    """
    last = read_applies(applies, "job_id", job_ids.select("job_id"), limit, days, as_of)
    return _weighted_mode(_votes(last, user_roles, "job_id", "user_id", F.col("rank")), "job_id")


def infer_job_roles(
    job_ids: DataFrame,
    contacts: DataFrame,
    applies: DataFrame,
    user_roles: DataFrame,
    use_contacts: bool = True,
    limit: int = fv.LAST_APPLIES,
    days: int = 0,
    as_of=None,
) -> DataFrame:
    """``job_id, role_id`` of every requested job: contacts first, applies where they say nothing, else 0.

    A job whose contacts all lack a role keeps 0 and is not looked up by applies. ``limit``, ``days`` and ``as_of`` say
    which applies count, as in ``read_applies``; all contacts count.
    """
    ids = job_ids.select("job_id").distinct()
    if not use_contacts:
        found = infer_job_roles_by_apply(ids, applies, user_roles, limit, days, as_of)
    else:
        # Read by the join below and to leave out the jobs that need no applies.
        by_contact = written_once(infer_job_roles_by_contact(ids, contacts, user_roles), "by-contact")
        silent = ids.join(by_contact, "job_id", "left_anti")
        found = by_contact.unionByName(infer_job_roles_by_apply(silent, applies, user_roles, limit, days, as_of))
    return ids.join(found, "job_id", "left").select("job_id", F.coalesce("role_id", F.lit(0)).alias("role_id"))


def inference_response(answers: DataFrame, id_column: str, order: str | None = None) -> DataFrame:
    """``id, response``: one JSON answer per id; of several the last by ``order`` counts."""
    last = answers.groupBy(id_column).agg(F.max_by("role_id", F.struct(order or "role_id", "role_id")).alias("role_id"))
    answer = F.struct(F.lit("").alias("role_title"), F.col("role_id"))
    return last.select(F.col(id_column).cast("string").alias("id"), F.to_json(answer).alias("response"))
