"""Readers on tables and rule lines made from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.queries import sql
from titleloom.queries.standins import AS_OF, table, view, with_views
from titleloom.session import new_shared_path
from titleloom.sources import catalogue, events, gazetteers, logs, pending


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.read_main_roles(view(spark, sf_dir, "main_table"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.read_similar_roles(view(spark, sf_dir, "similar_table"))


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def read_id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per part, keyed by its id."""
    texts = table(spark, sf_dir, "part").selectExpr(
        """concat('{"', p_partkey, '": {"areap_ids": [', p_size, ', ', p_size % 7, '], "nivelh_ids": [], """
        """"perfil_ids": [', p_size % 4, ']}}') AS value"""
    )
    return catalogue.id_mapping_of(texts).select("id", _joined("areap_ids"), _joined("nivelh_ids"), _joined("perfil_ids"))


def read_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteers.stopwords_of(view(spark, sf_dir, "text_lines"))


def read_phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = gazetteers.phrase_rules_of(view(spark, sf_dir, "text_lines"))
    return rules.select("line", "base", F.array_join("variations", ",").alias("variations"))


def read_conjugation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteers.conjugation_of(view(spark, sf_dir, "text_lines"))


def read_plural_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteers.plural_rules_of(view(spark, sf_dir, "text_lines"))


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.pending_jobs(*_views(spark, sf_dir, "jobs", "job_display", "job_role_rows"), as_of=AS_OF)


def pending_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.pending_cvs(*_views(spark, sf_dir, "users", "cvs", "cv_role_rows"))


def pending_work_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending.pending_work_exp(*_views(spark, sf_dir, "users", "cvs", "work_experiences", "work_exp_role_rows"))


def read_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last applies of every user, newest first."""
    return events.read_applies(view(spark, sf_dir, "applies"), "user_id").select("user_id", "rank", "event_id", "job_id")


def read_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "event_job_rows").filter(F.col("cargo_id").isNotNull())
    ids = jobs.select(F.col("vag_id").alias("job_id"))
    return events.read_contacts(view(spark, sf_dir, "contacts"), ids).select("vag_id", "usr_id", "event_id")


def job_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.job_roles(*_views(spark, sf_dir, "jobs", "job_role_rows"), order="pos")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.user_roles(*_views(spark, sf_dir, "cvs", "cv_role_rows"), order="pos")


def read_access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = logs.select_access_logs(view(spark, sf_dir, "access_log"), "titles", "2024-01-05", "2024-01-20")
    return chosen.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "request_log").selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS log_datetime",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('/v1/titles?perfil_ids=', event_id % 5) END AS api_uri",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE request END AS api_request",
        "CASE WHEN answer = '{}' THEN NULL ELSE answer END AS api_response",
    )


REPLAY_SQL = """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS log_datetime,
  '/v1/titles?perfil_ids=' || (event_id % 5) AS api_uri, request AS api_request, answer AS api_response
FROM request_log WHERE event_id % 9 <> 0 AND event_id % 13 <> 0"""


def read_replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged requests written as CSV files and read back."""
    path = new_shared_path(spark, "replay-log")
    replay_rows(spark, sf_dir).write.csv(path, header=True, escape='"')
    return logs.read_replay_log(spark, path)


QUERIES = {
    "read_main_roles": _main,
    "read_similar_roles": _similar,
    "read_id_mapping": read_id_mapping,
    "read_stopwords": read_stopwords,
    "read_phrase_rules": read_phrase_rules,
    "read_conjugation_rules": read_conjugation_rules,
    "read_plural_rules": read_plural_rules,
    "pending_jobs": pending_jobs,
    "pending_cvs": pending_cvs,
    "pending_work_exp": pending_work_exp,
    "read_applies": read_applies,
    "read_contacts": read_contacts,
    "job_roles": job_roles,
    "user_roles": user_roles,
    "read_access_logs": read_access_logs,
    "read_replay_log": read_replay_log,
}

_TOKENS = f"""tokens AS (
  SELECT line, list_transform(string_split(lower(text), ','), lambda t: {sql.strip('t')}) AS t
  FROM text_lines WHERE text NOT LIKE '#%')"""



def _open(roles: str, key: str, owner: str) -> str:
    """Without any role row, or with one that holds no role."""
    rows = f"FROM {roles} WHERE {roles}.{key} = {owner}.{key}"
    return f"(NOT EXISTS (SELECT 1 {rows}) OR EXISTS (SELECT 1 {rows} AND coalesce(cargo_id, 0) = 0))"


_ACTIVE_USERS = "(SELECT usr_id FROM users WHERE status = 'A' AND organizacao_id = 1)"
PENDING_JOBS_SQL = f"""
SELECT DISTINCT vag_id AS job_id, titulo AS title FROM jobs
WHERE status = 'A' AND length(titulo) > 0 AND data_entrada > date_trunc('month', TIMESTAMP '{AS_OF}') - INTERVAL 6 MONTH
  AND vag_id IN (SELECT vag_id FROM job_display WHERE organizacao_id = 1) AND {_open('job_role_rows', 'vag_id', 'jobs')}"""
PENDING_CVS_SQL = f"""
SELECT DISTINCT usr_id AS user_id, cur_id AS cv_id, objetivo AS title FROM cvs
WHERE length(objetivo) > 0 AND usr_id IN {_ACTIVE_USERS} AND {_open('cv_role_rows', 'cur_id', 'cvs')}"""
PENDING_WORK_EXP_SQL = f"""
SELECT DISTINCT usr_id AS user_id, cur_id AS cv_id, curexpprof_id AS work_exp_id, cargo AS title
FROM work_experiences JOIN cvs USING (cur_id)
WHERE length(cargo) > 0 AND usr_id IN {_ACTIVE_USERS} AND {_open('work_exp_role_rows', 'curexpprof_id', 'work_experiences')}"""

ORACLES = {
    "read_main_roles": with_views(
        ["main_table"],
        "SELECT cargo_id AS role_id, titulo AS title, 'main' AS source FROM main_table "
        "WHERE cargo_id IS NOT NULL AND cargo_id > 0 AND titulo IS NOT NULL AND titulo <> ''",
    ),
    "read_similar_roles": with_views(
        ["similar_table"],
        "SELECT cargo_id AS role_id, titulo AS title, 'similar' AS source FROM similar_table "
        "WHERE cargo_id IS NOT NULL AND cargo_id > 0 AND titulo IS NOT NULL AND titulo <> ''",
    ),
    "read_id_mapping": "SELECT CAST(p_partkey AS INT) AS id, p_size || ',' || (p_size % 7) AS areap_ids, "
    "'' AS nivelh_ids, CAST(p_size % 4 AS VARCHAR) AS perfil_ids FROM part",
    "read_stopwords": with_views(
        ["text_lines"],
        f"SELECT DISTINCT word FROM (SELECT {sql.strip('text')} AS word FROM text_lines WHERE text NOT LIKE '#%' "
        f"UNION ALL SELECT unnest({sql.listed(fv.STOPWORDS_ADDED)})) WHERE word <> '' "
        f"AND NOT list_contains({sql.listed(fv.STOPWORDS_KEPT)}, word)",
    ),
    "pending_jobs": with_views(["jobs", "job_display", "job_role_rows"], PENDING_JOBS_SQL),
    "pending_cvs": with_views(["users", "cvs", "cv_role_rows"], PENDING_CVS_SQL),
    "pending_work_exp": with_views(["users", "cvs", "work_experiences", "work_exp_role_rows"], PENDING_WORK_EXP_SQL),
    "read_applies": with_views(
        ["applies"],
        "SELECT user_id, CAST(rank AS INT) AS rank, event_id, job_id FROM (SELECT *, row_number() OVER "
        "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM applies) WHERE rank <= 200",
    ),
    "read_contacts": with_views(
        ["contacts", "event_job_rows"],
        "SELECT vag_id, usr_id, event_id FROM contacts WHERE vag_id IN "
        "(SELECT vag_id FROM event_job_rows WHERE cargo_id IS NOT NULL)",
    ),
    "job_roles": with_views(
        ["jobs", "job_role_rows"],
        "SELECT job_id, role_id FROM (SELECT v.vag_id AS job_id, r.cargo_id AS role_id, row_number() OVER "
        "(PARTITION BY v.vag_id ORDER BY r.pos DESC, r.cargo_id DESC) AS rn "
        "FROM jobs v LEFT JOIN job_role_rows r ON v.vag_id = r.vag_id) WHERE rn = 1",
    ),
    "user_roles": with_views(
        ["cvs", "cv_role_rows"],
        "SELECT user_id, role_id FROM (SELECT c.usr_id AS user_id, r.cargo_id AS role_id, row_number() OVER "
        "(PARTITION BY c.usr_id ORDER BY c.cur_id DESC, r.pos DESC, r.cargo_id DESC) AS rn "
        "FROM cvs c LEFT JOIN cv_role_rows r ON c.cur_id = r.cur_id) WHERE rn = 1",
    ),
    "read_access_logs": with_views(
        ["access_log"],
        "SELECT year, month, day, request_body, response_body_custom AS response_body, "
        "strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM access_log WHERE engine = 'titles' "
        "AND year || '-' || month || '-' || day BETWEEN '2024-01-05' AND '2024-01-20' "
        "AND (status = '200' OR status = '204') AND request_method = 'POST'",
    ),
    "read_replay_log": with_views(["request_log"], REPLAY_SQL),
}


def _rules_sql(query: str) -> str:
    """A query over the comma-separated tokens of the rule lines."""
    return f"{with_views(['text_lines'], '').rstrip()}, {_TOKENS} {query}"


ORACLES["read_phrase_rules"] = _rules_sql(
    "SELECT min(line) AS line, base, array_to_string(list_transform(list_sort(list_transform("
    f"list_distinct(arg_max(t[2:], line)), lambda v: {{'n': -len({sql.words('v')}), 'v': v}})), lambda s: s.v), ',') "
    "AS variations FROM (SELECT line, t, t[1] AS base FROM tokens WHERE len(t) >= 2) GROUP BY base"
)
ORACLES["read_conjugation_rules"] = _rules_sql(
    "SELECT variation, arg_max(base, line * 100000 + pos) AS base FROM (SELECT line, t[1] AS base, t[pos] AS variation, "
    "pos FROM (SELECT *, unnest(range(2, len(t) + 1)) AS pos FROM tokens WHERE len(t) >= 2)) GROUP BY variation"
)
ORACLES["read_plural_rules"] = _rules_sql(
    "SELECT line, t[1] AS suffix, t[2] AS replacement FROM tokens WHERE len(t) = 2"
)
