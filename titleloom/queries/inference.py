"""Roles of users and jobs from events: parts stand for jobs, customers for users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.operators import inference as inf
from titleloom.queries.standins import table, view, with_views
from titleloom.sources import events

# A setting far below the usual one.
FEW = 5


def job_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "event_job_rows")
    return events.job_roles(rows.select("vag_id"), rows)


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.user_roles(view(spark, sf_dir, "event_cvs"), view(spark, sf_dir, "event_cv_rows"))


def _user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def _job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"))


def most_frequent_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual part size per supplier, of all its lines; sizes that 5 divides are no votes."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    votes = lines.select(
        "l_suppkey", F.expr("CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 20 END").alias("role_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"),
    )
    return inf.most_frequent_role(votes, "l_suppkey", "at")


def infer_user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.infer_user_roles(_user_ids(spark, sf_dir), view(spark, sf_dir, "applies"), job_roles(spark, sf_dir))


def infer_user_roles_few_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question by the last five applies."""
    ids, roles = _user_ids(spark, sf_dir), job_roles(spark, sf_dir)
    return inf.infer_user_roles(ids, view(spark, sf_dir, "applies"), roles, limit=FEW)


def infer_job_roles_by_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.infer_job_roles_by_contact(
        _job_ids(spark, sf_dir), view(spark, sf_dir, "contacts"), user_roles(spark, sf_dir)
    )


def infer_job_roles_by_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.infer_job_roles_by_apply(
        _job_ids(spark, sf_dir), view(spark, sf_dir, "applies"), user_roles(spark, sf_dir)
    )


def _job_answers(spark: SparkSession, sf_dir: str, use_contacts: bool) -> DataFrame:
    return inf.infer_job_roles(
        _job_ids(spark, sf_dir), view(spark, sf_dir, "contacts"), view(spark, sf_dir, "applies"), user_roles(spark, sf_dir), use_contacts,
    )


def infer_job_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_answers(spark, sf_dir, True)


def infer_job_roles_without_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_answers(spark, sf_dir, False)


def inference_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.inference_response(infer_user_roles(spark, sf_dir), "user_id")


QUERIES = {
    "most_frequent_role": most_frequent_role,
    "infer_user_roles": infer_user_roles,
    "infer_user_roles_few_applies": infer_user_roles_few_applies,
    "infer_job_roles_by_contact": infer_job_roles_by_contact,
    "infer_job_roles_by_apply": infer_job_roles_by_apply,
    "infer_job_roles": infer_job_roles,
    "infer_job_roles_without_contacts": infer_job_roles_without_contacts,
    "inference_response": inference_response,
}

_USER_ROLES = (
    "user_roles AS (SELECT usr_id AS user_id, cargo_id AS role_id FROM event_cvs JOIN event_cv_rows USING (cur_id))"
)


def _mode(name: str, rows: str, key: str) -> str:
    """CTE with the first of the most frequent roles per key of rows ``key, role_id, seen``."""
    return (
        f"{name}_n AS (SELECT {key}, role_id, count(*) AS n, min(seen) AS first FROM ({rows}) "
        f"WHERE role_id IS NOT NULL AND role_id <> 0 GROUP BY {key}, role_id), "
        f"{name} AS (SELECT k.{key}, coalesce(m.role_id, 0) AS role_id FROM (SELECT DISTINCT {key} FROM ({rows})) k "
        f"LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS rn FROM {name}_n) m "
        f"ON m.{key} = k.{key} AND m.rn = 1)"
    )


def _last(column: str) -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY ts DESC, event_id DESC) AS seen "
        "FROM applies) WHERE seen <= 200)"
    )


_BY_USER = _mode(
    "by_user", f"SELECT a.user_id, r.cargo_id AS role_id, a.seen FROM {_last('user_id')} a "
    "JOIN event_job_rows r ON r.vag_id = a.job_id", "user_id"
)
_BY_APPLY = _mode(
    "by_apply", f"SELECT a.job_id, r.role_id, a.seen FROM {_last('job_id')} a JOIN user_roles r USING (user_id)", "job_id"
)


def _by_contact(contacts: str) -> str:
    return _mode(
        "by_contact", f"SELECT c.vag_id AS job_id, r.role_id, (c.ts, c.event_id) AS seen FROM {contacts} c "
        "JOIN user_roles r ON r.user_id = c.usr_id", "job_id"
    )


_USERS_SQL = (
    f", {_BY_USER} SELECT c_custkey AS user_id, coalesce(role_id, 0) AS role_id FROM customer "
    "LEFT JOIN by_user ON user_id = c_custkey"
)
_VIEWS = ["applies", "contacts", "event_job_rows", "event_cvs", "event_cv_rows"]
_OF_PARTS = "WHERE job_id IN (SELECT p_partkey FROM part)"

ORACLES = {
    "most_frequent_role": "WITH " + _mode(
        "modes", "SELECT l_suppkey, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 20 END "
        "AS role_id, (l_orderkey, l_linenumber, l_partkey) AS seen FROM lineitem JOIN part ON l_partkey = p_partkey", "l_suppkey"
    ) + " SELECT * FROM modes",
    "infer_user_roles": with_views(_VIEWS, _USERS_SQL),
    "infer_user_roles_few_applies": with_views(_VIEWS, _USERS_SQL.replace("seen <= 200", f"seen <= {FEW}")),
    "infer_job_roles_by_contact": with_views(
        _VIEWS, f", {_USER_ROLES}, {_by_contact('contacts')} SELECT * FROM by_contact {_OF_PARTS}"
    ),
    "infer_job_roles_by_apply": with_views(_VIEWS, f", {_USER_ROLES}, {_BY_APPLY} SELECT * FROM by_apply {_OF_PARTS}"),
    "infer_job_roles": with_views(
        _VIEWS,
        f", {_USER_ROLES}, {_BY_APPLY}, {_by_contact('contacts')} "
        "SELECT p_partkey AS job_id, coalesce(c.role_id, a.role_id, 0) AS role_id FROM part "
        "LEFT JOIN by_contact c ON c.job_id = p_partkey LEFT JOIN by_apply a ON a.job_id = p_partkey",
    ),
    "infer_job_roles_without_contacts": with_views(
        _VIEWS,
        f", {_USER_ROLES}, {_BY_APPLY} SELECT p_partkey AS job_id, coalesce(a.role_id, 0) AS role_id FROM part "
        "LEFT JOIN by_apply a ON a.job_id = p_partkey",
    ),
}
ORACLES["inference_response"] = with_views(
    _VIEWS,
    f", {_BY_USER} SELECT CAST(c_custkey AS VARCHAR) AS id, "
    "'{\"role_title\":\"\",\"role_id\":' || coalesce(role_id, 0) || '}' AS response "
    "FROM customer LEFT JOIN by_user ON user_id = c_custkey",
)
