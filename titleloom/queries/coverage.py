"""Log analytics on requests made from events, and checks of rule lines made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.operators import coverage as cov
from titleloom.operators import lint
from titleloom.queries.matching import STEPS, with_pieces
from titleloom.queries.sources import REPLAY_SQL, replay_rows
from titleloom.queries.standins import gazetteer, table, view, with_views
from titleloom.queries.vocabulary import built_catalogue
from titleloom.session import new_shared_path
from titleloom.sources import gazetteers, logs

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-12-31"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = logs.select_access_logs(view(spark, sf_dir, "access_log"), "titles", FIRST_DAY, LAST_DAY)
    return cov.dedupe_log_requests(chosen)


def logs_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one folder: the second brings only the days that the first did not have."""
    path = new_shared_path(spark, "logs-by-date")
    requests = _requests(spark, sf_dir)
    cov.write_logs_by_date(requests.filter("day < '2024-01-11'"), path)
    cov.write_logs_by_date(requests, path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


def sorted_log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted logs written as compressed CSV and read back."""
    path = new_shared_path(spark, "sorted-log")
    cov.write_sorted_log(_requests(spark, sf_dir), path)
    return logs.read_replay_log(spark, path).select("log_datetime", "api_request", "api_response")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay_rows(spark, sf_dir).filter("api_uri IS NOT NULL AND api_request IS NOT NULL")
    return rows.withColumn("api_response", F.coalesce("api_response", F.lit("{}")))


def parse_request_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.parse_request_response(_log(spark, sf_dir))


def count_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.count_invalid(_log(spark, sf_dir))


def non_normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.non_normalized_titles(parse_request_response(spark, sf_dir))


def sample_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "request_log").select("event_id", "request")
    return cov.sample_requests(events, 500, 42, F.col("event_id"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over titles of line items: parts decide the role, flags whether a run found it."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    seq = "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq"
    title = "concat(p_type, ' ', p_name, ' ', p_size) AS title"
    remote = lines.filter("l_linestatus = 'O'").selectExpr(
        title, "p_name AS normalized_role", "CASE WHEN l_returnflag = 'N' THEN 0 ELSE p_size END AS role_id", seq
    )
    local = lines.filter("l_returnflag <> 'R'").selectExpr(
        title, "CASE WHEN p_size % 2 = 0 THEN p_name END AS normalized_role",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_tax > 0.06 THEN p_size + 1 ELSE p_size END AS role_id", seq,
    )
    return remote, local


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.compare_runs(*_runs(spark, sf_dir))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.coverage_report(compare_runs(spark, sf_dir)).withColumn("share", F.round("share", 6))


def rule_order_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.rule_order_lint(view(spark, sf_dir, "part_lines"))


def rule_ambiguity_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.rule_ambiguity_lint(
        view(spark, sf_dir, "part_lines"), built_catalogue(spark, sf_dir), gazetteer(spark), STEPS
    )
    return found.select("line", F.array_join(F.col("role_ids").cast("array<string>"), ",").alias("role_ids"))


def repeated_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "text_lines").filter("text LIKE '%,%' AND text NOT LIKE '#%'")
    return lint.repeated_bases(lines.select("line", gazetteers.strip(F.lower(F.split("text", ",")[0])).alias("base")))


QUERIES = {
    "dedupe_log_requests": _requests,
    "logs_by_date": logs_by_date,
    "sorted_log_export": sorted_log_export,
    "parse_request_response": parse_request_response,
    "count_invalid": count_invalid,
    "non_normalized_titles": non_normalized_titles,
    "sample_requests": sample_requests,
    "compare_runs": compare_runs,
    "coverage_report": coverage_report,
    "rule_order_lint": rule_order_lint,
    "rule_ambiguity_lint": rule_ambiguity_lint,
    "repeated_bases": repeated_bases,
}


def _deduped(columns: str) -> str:
    return with_views(
        ["access_log"],
        f"SELECT {columns} FROM (SELECT year || '-' || month || '-' || day AS day, "
        "strftime(min(moment) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS log_datetime, request_body AS api_request, "
        "response_body_custom AS api_response FROM access_log WHERE engine = 'titles' AND status IN ('200', '204') "
        "AND request_method = 'POST' GROUP BY year, month, day, request_body, response_body_custom)",
    )


_PARSED = with_views(
    ["request_log"],
    f", log AS ({REPLAY_SQL}), asked AS (SELECT api_uri, api_response, unnest(CAST(json_extract(api_request, '$.titles') "
    "AS VARCHAR[])) AS title FROM log), answered AS (SELECT api_uri, title, json_extract(api_response, '$.\"' || title || '\"[0]') "
    "AS first FROM asked), parsed AS (SELECT api_uri, title, json_extract_string(first, '$.normalized_role') AS normalized_role, "
    "CAST(json_extract_string(first, '$.role_id') AS BIGINT) AS role_id, first IS NULL OR "
    "(json_extract_string(first, '$.normalized_role') <> '' AND json_extract_string(first, '$.role_id') <> '0') AS valid FROM answered) ",
)
_TITLE = "p_type || ' ' || p_name || ' ' || p_size"
_SEQ = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)"
_COMPARED = f"""
WITH remote AS (SELECT {_TITLE} AS title, arg_max({{'name': p_name, 'id': CASE WHEN l_returnflag = 'N' THEN 0 ELSE p_size END}},
    {_SEQ}) AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1),
local AS (SELECT {_TITLE} AS title, arg_max({{'name': CASE WHEN p_size % 2 = 0 THEN p_name END, 'id': CASE WHEN l_linenumber % 3 = 0
    THEN NULL WHEN l_tax > 0.06 THEN p_size + 1 ELSE p_size END}}, {_SEQ}) AS r FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag <> 'R' GROUP BY 1),
both_runs AS (SELECT coalesce(a.title, b.title) AS title, nullif(a.r.id, 0) AS x, a.r.name AS xn, nullif(b.r.id, 0) AS y, b.r.name AS yn
  FROM remote a FULL OUTER JOIN local b ON a.title = b.title),
compared AS (SELECT title, CASE WHEN x IS NULL THEN '-' ELSE x || ': ' || coalesce(xn, '-') END AS remote,
  CASE WHEN y IS NULL THEN '-' ELSE y || ': ' || coalesce(yn, '-') END AS local,
  CASE WHEN x IS NULL AND y IS NULL THEN 'match_none' WHEN x IS NULL THEN 'improvement' WHEN y IS NULL THEN 'regression'
    WHEN x = y THEN 'match_norm' ELSE 'differ' END AS class FROM both_runs)
"""
_TERMS = "terms AS (SELECT DISTINCT line, unnest(string_split(text, ',')[2:]) AS term FROM part_lines)"

ORACLES = {
    "dedupe_log_requests": _deduped("*"),
    "logs_by_date": _deduped("*"),
    "sorted_log_export": _deduped("log_datetime, api_request, api_response"),
    "parse_request_response": f"{_PARSED} SELECT api_uri, title, normalized_role, role_id FROM parsed WHERE valid",
    "count_invalid": f"{_PARSED} SELECT count(*) FILTER (NOT valid) AS invalid FROM parsed",
    "non_normalized_titles": f"{_PARSED} SELECT title FROM parsed WHERE valid AND role_id IS NULL",
    "sample_requests": with_views(
        ["request_log"], "SELECT event_id, request FROM request_log ORDER BY md5('42/' || event_id) LIMIT 500"
    ),
    "compare_runs": f"{_COMPARED} SELECT * FROM compared",
    "coverage_report": f"{_COMPARED} SELECT c.class, count(compared.class) AS titles, round(count(compared.class) / "
    "(SELECT count(*) FROM compared), 6) AS share FROM (SELECT unnest(['match_none', 'match_norm', 'differ', 'regression', "
    "'improvement']) AS class) c LEFT JOIN compared ON compared.class = c.class GROUP BY c.class",
    "rule_order_lint": with_views(
        ["part_lines"],
        f", {_TERMS}, spaced AS (SELECT line, ' ' || replace(text, ',', ' , ') || ' ' AS t FROM part_lines) "
        "SELECT a.line, term, count(*) AS later_lines, min(b.line) AS next_line FROM terms a JOIN spaced b "
        "ON b.line > a.line AND contains(b.t, ' ' || term || ' ') GROUP BY a.line, term",
    ),
    "rule_ambiguity_lint": with_pieces(
        "(SELECT unnest(string_split(text, ',')) AS title FROM part_lines)",
        ", line_terms AS (SELECT line, t[pos] AS title, pos FROM (SELECT line, t, unnest(range(1, len(t) + 1)) AS pos "
        "FROM (SELECT line, string_split(text, ',') AS t FROM part_lines))), "
        "roles AS (SELECT title, arg_min(role_id, pos) AS role_id FROM found GROUP BY title), "
        "firsts AS (SELECT line, role_id, min(pos) AS pos FROM line_terms JOIN roles USING (title) GROUP BY line, role_id) "
        "SELECT line, string_agg(CAST(role_id AS VARCHAR), ',' ORDER BY pos) AS role_ids FROM firsts GROUP BY line HAVING count(*) > 1",
        "part_lines",
    ),
    "repeated_bases": with_views(
        ["text_lines"],
        "SELECT base, count(*) AS lines FROM (SELECT trim(lower(string_split(text, ',')[1])) AS base FROM text_lines "
        "WHERE text LIKE '%,%' AND text NOT LIKE '#%') GROUP BY base HAVING count(*) > 1",
    ),
}
