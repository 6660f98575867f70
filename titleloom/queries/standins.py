"""Role tables made from the provided tables, in Spark and as SQL common table expressions.

The provided tables hold no job titles: parts stand for roles, orders for jobs and CVs, line items for work
experiences and role rows, customers for users, events for applies and contacts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.sources.gazetteers import Gazetteer, sample_gazetteer
from titleloom.sources.tables import read_table

AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


_GAZETTEERS: dict[str, Gazetteer] = {}


def gazetteer(spark: SparkSession) -> Gazetteer:
    """The sample lists, read once per application."""
    application = spark.sparkContext.applicationId
    if application not in _GAZETTEERS:
        _GAZETTEERS[application] = sample_gazetteer(spark)
    return _GAZETTEERS[application]


_PART_TITLE = "concat(p_type, ' / ', p_name, ' de ', p_brand)"

# Each view: its Spark SQL over the provided tables, and the DuckDB text where that differs.
_VIEWS: dict[str, str] = {
    "main_table": "SELECT CAST(p_partkey AS INT) AS cargo_id, p_name AS titulo FROM part",
    "similar_table": "SELECT CAST(p_partkey AS INT) AS cargo_id, concat(p_type, ' ', p_name) AS titulo FROM part",
    "part_titles": f"SELECT p_partkey AS id, {_PART_TITLE} AS title FROM part",
    "staff_titles": "SELECT 1000000000 + o_orderkey AS id, concat(CASE o_custkey % 5 WHEN 0 THEN 'Trainee' WHEN 1 THEN "
    "'Coordenadora' WHEN 2 THEN 'GERENTE' ELSE 'Enfermeiras' END, CASE WHEN o_orderstatus = 'O' THEN ' Sr' WHEN "
    "o_orderstatus = 'P' THEN ' jr.' ELSE ', líder' END, ' ', o_orderpriority) AS title FROM orders",
    "long_titles": "SELECT concat(l_returnflag, ' vaga, ', p_name, ' ', p_type, ' com ', p_brand, '; ', lower(p_name), ' ou ', "
    "p_brand, ' ', p_size) AS title FROM lineitem JOIN part ON l_partkey = p_partkey",
    "order_part": "SELECT l_orderkey, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS l_partkey "
    "FROM lineitem GROUP BY l_orderkey",
    "order_titles": f"SELECT o.*, {_PART_TITLE} AS titulo FROM orders o "
    "LEFT JOIN order_part l ON o.o_orderkey = l.l_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey",
    "jobs": "SELECT o_orderkey AS vag_id, titulo, CASE WHEN o_orderstatus = 'O' THEN 'A' ELSE o_orderstatus END "
    "AS status, o_orderdate AS data_entrada FROM order_titles",
    "job_display": "SELECT o_orderkey AS vag_id, CAST(o_custkey % 2 AS INT) AS organizacao_id FROM orders",
    "job_role_rows": "SELECT l_orderkey AS vag_id, CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_partkey END AS INT) "
    "AS cargo_id, l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'A'",
    "users": "SELECT c_custkey AS usr_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'I' ELSE 'A' END AS status, "
    "c_nationkey % 2 AS organizacao_id FROM customer",
    "cvs": "SELECT o_orderkey AS cur_id, o_custkey AS usr_id, titulo AS objetivo, o_orderdate AS data_alteracao "
    "FROM order_titles",
    "cv_role_rows": "SELECT l_orderkey AS cur_id, CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_partkey END AS INT) "
    "AS cargo_id, l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'R'",
    "work_experiences": "SELECT l_orderkey * 10 + l_linenumber AS curexpprof_id, l_orderkey AS cur_id, "
    "p_name AS cargo FROM lineitem JOIN part ON l_partkey = p_partkey",
    "work_exp_role_rows": "SELECT l_orderkey * 10 + l_linenumber AS curexpprof_id, "
    "CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_partkey END AS INT) AS cargo_id "
    "FROM lineitem WHERE l_returnflag = 'R'",
    "event_jobs": "SELECT event_id, ts, user_id, event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS job_id "
    "FROM events",
    "applies": "SELECT user_id, job_id, ts, event_id FROM event_jobs",
    "contacts": "SELECT job_id AS vag_id, user_id AS usr_id, ts, event_id FROM event_jobs WHERE event_type = 'purchase'",
    "event_job_rows": "SELECT p_partkey AS vag_id, CAST(CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 7 = 0 THEN NULL "
    "ELSE p_size % 10 END AS INT) AS cargo_id FROM part",
    "event_cvs": "SELECT c_custkey AS usr_id, c_custkey AS cur_id FROM customer",
    "event_cv_rows": "SELECT c_custkey AS cur_id, CAST(CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey % 6 END "
    "AS INT) AS cargo_id FROM customer",
    "job_flags": "SELECT l_orderkey AS vag_id, max(CAST(l_partkey AS INT)) AS cargo_id, max(l_shipdate) AS "
    "data_atualizacao FROM lineitem GROUP BY l_orderkey",
    "user_flags": "SELECT o_custkey AS usr_id, o_orderkey AS cur_id, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE "
    "l_orderkey * 10 + l_linenumber END AS curexpprof_id, max(CAST(l_partkey AS INT)) AS cargo_id, "
    "max(l_shipdate) AS data_atualizacao FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "GROUP BY o_custkey, o_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_orderkey * 10 + l_linenumber END",
    "text_lines": "SELECT doc_id * 1000000 + pos AS line, text FROM (SELECT doc_id, posexplode(split(text, '\\n')) "
    "AS (pos, text) FROM documents)",
    "part_lines": "SELECT p_partkey + 1 AS line, concat(p_brand, ',', p_type, ',', p_name, CASE WHEN p_size % 3 = 0 THEN "
    "concat(',', p_type, ' ', p_name) ELSE '' END) AS text FROM part",
    "request_log": "SELECT event_id, ts, user_id, job_id, event_type, "
    """concat('{"titles": ["', p_name, '", "', p_type, '"]}') AS request, """
    """CASE WHEN p_size % 4 = 0 THEN '{}' WHEN p_size % 4 = 1 THEN concat('{"', p_name, '": [{"normalized_role": "', """
    """p_name, '", "role_id": ', p_size, '}], "', p_type, '": []}') """
    """WHEN p_size % 4 = 2 THEN concat('{"', p_name, '": [{"normalized_role": "", "role_id": ', p_size, '}]}') """
    """ELSE concat('{"', p_type, '": [{"normalized_role": "', p_type, '", "role_id": ', p_size, """
    """'}, {"normalized_role": "other", "role_id": 9}]}') END AS answer """
    "FROM event_jobs JOIN part ON job_id = p_partkey",
    "access_log": "SELECT date_format(ts, 'yyyy') AS year, date_format(ts, 'MM') AS month, date_format(ts, 'dd') AS day, "
    "CASE WHEN event_type IN ('click', 'view') THEN 'titles' ELSE 'other' END AS engine, "
    "CASE WHEN event_id % 7 = 0 THEN '500' WHEN event_id % 7 = 1 THEN '204' ELSE '200' END AS status, "
    "CASE WHEN event_id % 11 = 0 THEN 'GET' ELSE 'POST' END AS request_method, request AS request_body, "
    "answer AS response_body_custom, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS `@timestamp` "
    "FROM request_log",
}

_DUCKDB: dict[str, str] = {
    "event_jobs": "SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id "
    "FROM events",
    "text_lines": "SELECT doc_id * 1000000 + pos - 1 AS line, parts[pos] AS text FROM (SELECT doc_id, parts, "
    "unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))",
    "access_log": "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, "
    "CASE WHEN event_type IN ('click', 'view') THEN 'titles' ELSE 'other' END AS engine, "
    "CASE WHEN event_id % 7 = 0 THEN '500' WHEN event_id % 7 = 1 THEN '204' ELSE '200' END AS status, "
    "CASE WHEN event_id % 11 = 0 THEN 'GET' ELSE 'POST' END AS request_method, request AS request_body, "
    "answer AS response_body_custom, ts AS moment FROM request_log",
}

# concat() of a null is null in Spark and skips it in DuckDB.
_DUCKDB["order_titles"] = _VIEWS["order_titles"].replace(_PART_TITLE, "p_type || ' / ' || p_name || ' de ' || p_brand")

_NEEDS = {
    "order_titles": ["order_part"],
    "jobs": ["order_titles"],
    "cvs": ["order_titles"],
    "applies": ["event_jobs"],
    "contacts": ["event_jobs"],
    "request_log": ["event_jobs"],
    "access_log": ["request_log"],
}
_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "benchmark")


def _with_needs(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return ordered


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stand-in tables."""
    needed = _with_needs([name])
    texts = " ".join(_VIEWS[n] for n in needed)
    sources = {t: table(spark, sf_dir, t) for t in _TABLES if t in texts}
    done: dict[str, DataFrame] = {}
    for step in needed:
        inputs = {k: v for k, v in {**sources, **done}.items() if f" {k}" in _VIEWS[step]}
        text = _VIEWS[step].replace("{", "{{").replace("}", "}}")
        for key in sorted(inputs, key=len, reverse=True):
            text = _named_inputs(text, key)
        done[step] = spark.sql(text, **inputs)
    return done[name]


def _named_inputs(text: str, name: str) -> str:
    return re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


def with_views(names: list[str], query: str) -> str:
    """A DuckDB query with some stand-in tables as common table expressions."""
    parts = [f"{n} AS ({_DUCKDB.get(n, _VIEWS[n])})" for n in _with_needs(names)]
    return "WITH " + ", ".join(parts) + " " + query
