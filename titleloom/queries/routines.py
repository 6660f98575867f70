"""Date windows, keyed writes, messages, rollback and the whole routine, on orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators import keyed_tables as kt
from titleloom.operators import windows as win
from titleloom.operators import writeback as wb
from titleloom.plans import ledger
from titleloom.plans import routines as plan
from titleloom.queries.matching import STEPS, with_pieces
from titleloom.queries.sources import PENDING_CVS_SQL, PENDING_JOBS_SQL, PENDING_WORK_EXP_SQL
from titleloom.queries.sources import pending_cvs, pending_jobs, pending_work_exp
from titleloom.queries.standins import AS_OF, gazetteer, table, view, with_views
from titleloom.queries.vocabulary import built_catalogue
from titleloom.session import new_shared_path, written_once

NOW = "2001-08-02 10:00:00"
# Few, as the tables are small.
KEY_BUCKETS = 16
FIRST_DAY, LAST_DAY = "1999-03-01", "2000-05-31"


def _windowed(function):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        return function(orders, "o_orderdate", AS_OF).drop("o_orderdate")

    return query


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One role row per order with a returned line item."""
    rows = view(spark, sf_dir, "job_role_rows")
    return rows.groupBy("vag_id").agg(F.max("cargo_id").alias("cargo_id"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role updates from line items, several per order."""
    return table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").selectExpr(
        "l_orderkey AS vag_id", "CAST(l_partkey + 1 AS INT) AS cargo_id", "l_linenumber * 1000000 + l_partkey AS pos"
    )


_TARGET = "target AS (SELECT vag_id, max(cargo_id) AS cargo_id FROM job_role_rows GROUP BY vag_id)"
_UPDATES = (
    "updates AS (SELECT l_orderkey AS vag_id, arg_min(CAST(l_partkey + 1 AS INT), l_linenumber * 1000000 + l_partkey) "
    "AS cargo_id FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)"
)
_PARENT = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"


def _parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("vag_id"))


def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.insert_missing(_target(spark, sf_dir), _updates(spark, sf_dir), "vag_id", "pos")


def insert_missing_with_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.insert_missing_with_parent(
        _target(spark, sf_dir), _updates(spark, sf_dir), _parent(spark, sf_dir), "vag_id", "pos"
    )


def update_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.update_existing(_target(spark, sf_dir), _updates(spark, sf_dir), "vag_id", "pos")


def write_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.write_roles(_target(spark, sf_dir), _updates(spark, sf_dir), "vag_id", _parent(spark, sf_dir), "pos")


def values_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _updates(spark, sf_dir).select("vag_id", "cargo_id")
    return wb.values_union(updates, _target(spark, sf_dir), updates)


def _stamped(frame: DataFrame) -> DataFrame:
    return frame.withColumn("data_atualizacao", F.date_format("data_atualizacao", "yyyy-MM-dd HH:mm:ss"))


def _old_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that earlier runs left behind."""
    return view(spark, sf_dir, "job_flags").filter(F.col("data_atualizacao") < F.lit(LAST_DAY).cast("timestamp"))


def upsert_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _old_flags(spark, sf_dir)
    return _stamped(wb.upsert_flags(flags, _updates(spark, sf_dir), ["vag_id"], NOW, "pos"))


def update_existing_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same update, in place, on a table laid out by key."""
    path = new_shared_path(spark, "roles")
    kt.write_keyed_table(_target(spark, sf_dir), path, ["vag_id"], KEY_BUCKETS)
    kt.update_existing_at(spark, path, _updates(spark, sf_dir), "vag_id", "pos", KEY_BUCKETS)
    return kt.read_keyed_table(spark, path)


def write_roles_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "roles")
    kt.write_keyed_table(_target(spark, sf_dir), path, ["vag_id"], KEY_BUCKETS)
    kt.write_roles_at(spark, path, _updates(spark, sf_dir), "vag_id", _parent(spark, sf_dir), "pos", KEY_BUCKETS)
    return kt.read_keyed_table(spark, path)


def upsert_flags_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "flags")
    kt.write_keyed_table(_old_flags(spark, sf_dir), path, ["vag_id"], KEY_BUCKETS)
    kt.upsert_flags_at(spark, path, _updates(spark, sf_dir), ["vag_id"], NOW, "pos", KEY_BUCKETS)
    return _stamped(kt.read_keyed_table(spark, path))


def job_index_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.job_index_messages(_updates(spark, sf_dir))


def job_index_messages_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids far apart still fill their messages."""
    far = F.col("vag_id") * F.lit(10007)
    return wb.job_index_messages(_updates(spark, sf_dir).select(far.alias("vag_id")))


def user_index_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.user_index_messages(view(spark, sf_dir, "cvs"))


def _roles_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return view(spark, sf_dir, name).select(key, "cargo_id")


def rollback_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvs, work = wb.rollback_users(
        view(spark, sf_dir, "user_flags"), _roles_of(spark, sf_dir, "cv_role_rows", "cur_id"),
        _roles_of(spark, sf_dir, "work_exp_role_rows", "curexpprof_id"), FIRST_DAY, LAST_DAY,
    )
    shown = [
        f.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "cargo_id", "rolled_back")
        for f, kind, key in ((cvs, "cv", "cur_id"), (work, "work", "curexpprof_id"))
    ]
    return shown[0].unionByName(shown[1])


def rollback_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wb.rollback_jobs(view(spark, sf_dir, "job_flags"), _target(spark, sf_dir), FIRST_DAY, LAST_DAY)


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS ab_test_group"
    )


def _jobs_run(spark: SparkSession, sf_dir: str) -> plan.RoutineResult:
    return plan.normalize_pending_jobs(
        pending_jobs(spark, sf_dir), built_catalogue(spark, sf_dir), gazetteer(spark), _target(spark, sf_dir),
        _old_flags(spark, sf_dir), NOW, steps=STEPS,
        assignments=_assignments(spark, sf_dir),
    )


def normalize_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job routine: the role found for every eligible pending job."""
    return _jobs_run(spark, sf_dir).normalized.select("vag_id", "title", "cargo_id")


def normalize_pending_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(_jobs_run(spark, sf_dir).flags)


def normalize_pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs_run(spark, sf_dir).counts


def normalize_pending_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs_run(spark, sf_dir).roles


def normalize_pending_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs_run(spark, sf_dir).messages


def normalize_pending_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job routine on the last 24 weeks."""
    run = plan.run_jobs_routine(
        *[view(spark, sf_dir, name) for name in ("jobs", "job_display", "job_role_rows")], AS_OF,
        built_catalogue(spark, sf_dir), gazetteer(spark), _target(spark, sf_dir), _old_flags(spark, sf_dir), steps=STEPS,
    )
    return run.normalized.select("vag_id", "title", "cargo_id")


def normalize_pending_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role table after the job routine on the last 24 weeks, stopped after one step and started again."""
    root = new_shared_path(spark, "resumed")
    out = ledger.Outputs(*[f"{root}/{n}" for n in ("roles", "flags", "messages", "counts", "ledger")], KEY_BUCKETS)
    kt.write_keyed_table(_target(spark, sf_dir), out.roles, ["vag_id"], KEY_BUCKETS)
    kt.write_keyed_table(_old_flags(spark, sf_dir), out.flags, ["vag_id"], KEY_BUCKETS)
    jobs, display, role_rows = (view(spark, sf_dir, name) for name in ("jobs", "job_display", "job_role_rows"))
    catalogue = written_once(built_catalogue(spark, sf_dir), "catalogue")
    for steps in (1, None):
        ledger.resume_jobs_routine(
            jobs, display, role_rows, AS_OF, catalogue, gazetteer(spark), out, together=12, at_most=steps, steps=STEPS
        )
    return kt.read_keyed_table(spark, out.roles)


def normalize_pending_cvs_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CV routine on the 31 windows."""
    run = plan.run_cvs_routine(
        *[view(spark, sf_dir, name) for name in ("users", "cvs", "cv_role_rows")], AS_OF,
        built_catalogue(spark, sf_dir), gazetteer(spark), _roles_of(spark, sf_dir, "cv_role_rows", "cur_id"),
        view(spark, sf_dir, "user_flags"), steps=STEPS,
    )
    return run.normalized.select("cur_id", "title", "cargo_id")


def normalize_pending_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = plan.normalize_pending_cvs(
        pending_cvs(spark, sf_dir), built_catalogue(spark, sf_dir), gazetteer(spark),
        _roles_of(spark, sf_dir, "cv_role_rows", "cur_id"), view(spark, sf_dir, "user_flags"), NOW, steps=STEPS,
    )
    return run.roles


def normalize_pending_work_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = plan.normalize_pending_work_exp(
        pending_work_exp(spark, sf_dir), built_catalogue(spark, sf_dir), gazetteer(spark),
        _roles_of(spark, sf_dir, "work_exp_role_rows", "curexpprof_id"),
        view(spark, sf_dir, "work_experiences"),
        view(spark, sf_dir, "user_flags"), NOW, steps=STEPS,
    )
    return run.roles


def recent_jobs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return win.recent_jobs_filter(orders, "o_orderdate", AS_OF).select("o_orderkey")


QUERIES = {
    "weekly_windows": _windowed(win.weekly_windows),
    "user_windows": _windowed(win.user_windows),
    "recent_jobs_filter": recent_jobs_filter,
    "insert_missing": insert_missing,
    "insert_missing_with_parent": insert_missing_with_parent,
    "update_existing": update_existing,
    "write_roles": write_roles,
    "values_union": values_union,
    "upsert_flags": upsert_flags,
    "update_existing_in_buckets": update_existing_in_buckets,
    "write_roles_in_buckets": write_roles_in_buckets,
    "upsert_flags_in_buckets": upsert_flags_in_buckets,
    "job_index_messages": job_index_messages,
    "job_index_messages_sparse": job_index_messages_sparse,
    "user_index_messages": user_index_messages,
    "rollback_users": rollback_users,
    "rollback_jobs": rollback_jobs,
    "normalize_pending": normalize_pending,
    "normalize_pending_flags": normalize_pending_flags,
    "normalize_pending_counts": normalize_pending_counts,
    "normalize_pending_roles": normalize_pending_roles,
    "normalize_pending_messages": normalize_pending_messages,
    "normalize_pending_windowed": normalize_pending_windowed,
    "normalize_pending_resumed": normalize_pending_resumed,
    "normalize_pending_cvs_windowed": normalize_pending_cvs_windowed,
    "normalize_pending_cvs": normalize_pending_cvs,
    "normalize_pending_work_exp": normalize_pending_work_exp,
}

# Windows as the list of bounds that the routine loops over, newest first.
_NOW_SQL = f"TIMESTAMP '{AS_OF}'"
_WEEKS = [(f"{_NOW_SQL} - INTERVAL {7 * (w + 1)} DAY", f"{_NOW_SQL} - INTERVAL {7 * w} DAY") for w in range(24)]
_MONTHS = [(f"{_NOW_SQL} - INTERVAL {m + 1} MONTH", f"{_NOW_SQL} - INTERVAL {m} MONTH") for m in range(6, 12)]
_LEFT = [(f"{_NOW_SQL} - INTERVAL 6 MONTH", f"{_NOW_SQL} - INTERVAL {7 * 24} DAY")]


def _windows_sql(bounds) -> str:
    rows = ", ".join(f"({i}, {after}, {to})" for i, (after, to) in enumerate(bounds))
    return (
        f"WITH bounds(w, after, upto) AS (VALUES {rows}) SELECT o_orderkey, CAST(w AS INT) AS window FROM orders "
        "JOIN bounds ON o_orderdate > after AND o_orderdate <= upto"
    )


_FLAGGED = (
    f"data_atualizacao >= TIMESTAMP '{FIRST_DAY} 00:00:00' AND data_atualizacao <= TIMESTAMP '{LAST_DAY} 23:59:59'"
)


def _messages(ids: str, column: str, item: str, start: str) -> str:
    return (
        f"SELECT batch, '{start}' || string_agg({item}, ',' ORDER BY id) || ']}}' AS message FROM ("
        f"SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch "
        f"FROM (SELECT DISTINCT {column} AS id FROM {ids})) GROUP BY batch"
    )


_JOB_ITEM, _JOB_START = "'{\"vag_id\":' || id || ',\"new_status\":\"A\"}'", "{\"events\":["
_BACK = "SELECT '{kind}' AS kind, r.{key} AS id, CASE WHEN f.{key} IS NOT NULL THEN 0 ELSE cargo_id END AS cargo_id, " \
    "f.{key} IS NOT NULL AS rolled_back FROM {table} r LEFT JOIN (SELECT DISTINCT {key} FROM user_flags " \
    "WHERE curexpprof_id {which} 0 AND " + _FLAGGED + ") f ON f.{key} = r.{key}"

_TITLED = {
    "jobs": (PENDING_JOBS_SQL, ["jobs", "job_display", "job_role_rows", "job_flags"]),
    "cvs": (PENDING_CVS_SQL, ["users", "cvs", "cv_role_rows"]),
    "work": (PENDING_WORK_EXP_SQL, ["users", "cvs", "work_experiences", "work_exp_role_rows"]),
}


def _run_sql(kind: str, query: str) -> str:
    """A query over ``pending`` rows and ``roles_found`` (title, role_id)."""
    pending, views = _TITLED[kind]
    text = with_pieces("pending", ", roles_found AS (SELECT title, arg_min(role_id, pos) AS role_id FROM found GROUP BY title) "
                       + query, *views)
    return text.replace(", roles_done AS", f", pending AS ({pending}), roles_done AS", 1)


_ELIGIBLE = "(SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0)"
_DONE = (
    "SELECT p.job_id AS vag_id, p.title, f.role_id AS cargo_id FROM pending p JOIN roles_found f USING (title) "
    f"WHERE p.job_id IN {_ELIGIBLE}"
)

ORACLES = {
    "weekly_windows": _windows_sql(_WEEKS),
    "user_windows": _windows_sql(_WEEKS + _LEFT + _MONTHS),
    "recent_jobs_filter": f"SELECT o_orderkey FROM orders WHERE o_orderdate > date_trunc('month', {_NOW_SQL}) - INTERVAL 6 MONTH",
    "insert_missing": with_views(
        ["job_role_rows"],
        f", {_TARGET}, {_UPDATES} SELECT * FROM target UNION ALL SELECT * FROM updates u "
        "WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.vag_id = u.vag_id)",
    ),
    "insert_missing_with_parent": with_views(
        ["job_role_rows"],
        f", {_TARGET}, {_UPDATES} SELECT * FROM target UNION ALL SELECT * FROM updates u "
        f"WHERE vag_id IN {_PARENT} AND NOT EXISTS (SELECT 1 FROM target t WHERE t.vag_id = u.vag_id)",
    ),
    "update_existing": with_views(
        ["job_role_rows"],
        f", {_TARGET}, {_UPDATES} SELECT t.vag_id, coalesce(u.cargo_id, t.cargo_id) AS cargo_id FROM target t "
        "LEFT JOIN updates u USING (vag_id)",
    ),
    "write_roles": with_views(
        ["job_role_rows"],
        f", {_TARGET}, {_UPDATES} SELECT t.vag_id, coalesce(u.cargo_id, t.cargo_id) AS cargo_id FROM target t "
        f"LEFT JOIN updates u USING (vag_id) UNION ALL SELECT * FROM updates u WHERE vag_id IN {_PARENT} "
        "AND NOT EXISTS (SELECT 1 FROM target t WHERE t.vag_id = u.vag_id)",
    ),
    "values_union": with_views(
        ["job_role_rows"],
        f", {_TARGET}, u AS (SELECT l_orderkey AS vag_id, CAST(l_partkey + 1 AS INT) AS cargo_id FROM lineitem "
        "WHERE l_returnflag <> 'R') SELECT * FROM u UNION ALL SELECT * FROM target UNION ALL SELECT * FROM u",
    ),
    "upsert_flags": with_views(
        ["job_flags"],
        f", {_UPDATES} SELECT vag_id, cargo_id, strftime(data_atualizacao, '%Y-%m-%d %H:%M:%S') AS data_atualizacao "
        f"FROM job_flags WHERE data_atualizacao < TIMESTAMP '{LAST_DAY}' AND vag_id NOT IN (SELECT vag_id FROM updates) "
        f"UNION ALL SELECT vag_id, cargo_id, '{NOW}' FROM updates",
    ),
    "job_index_messages": _messages(
        "(SELECT l_orderkey AS vag_id FROM lineitem WHERE l_returnflag <> 'R')", "vag_id",
        _JOB_ITEM, _JOB_START
    ),
    "job_index_messages_sparse": _messages(
        "(SELECT l_orderkey * 10007 AS vag_id FROM lineitem WHERE l_returnflag <> 'R')", "vag_id", _JOB_ITEM, _JOB_START
    ),
    "user_index_messages": _messages("(SELECT o_custkey AS usr_id FROM orders)", "usr_id", "CAST(id AS VARCHAR)", "{\"usr_ids\":["),
    "rollback_users": with_views(
        ["user_flags", "cv_role_rows", "work_exp_role_rows"],
        _BACK.format(kind="cv", key="cur_id", table="cv_role_rows", which="=") + " UNION ALL "
        + _BACK.format(kind="work", key="curexpprof_id", table="work_exp_role_rows", which="<>"),
    ),
    "rollback_jobs": with_views(
        ["job_flags", "job_role_rows"],
        f", {_TARGET} SELECT t.vag_id, CASE WHEN f.vag_id IS NULL THEN t.cargo_id ELSE 0 END AS cargo_id, "
        "f.vag_id IS NOT NULL AS rolled_back FROM target t LEFT JOIN (SELECT DISTINCT vag_id FROM job_flags "
        f"WHERE {_FLAGGED}) f ON f.vag_id = t.vag_id",
    ),
    "normalize_pending": _run_sql("jobs", _DONE),
    "normalize_pending_flags": _run_sql(
        "jobs",
        f", done AS ({_DONE}) SELECT vag_id, cargo_id, strftime(data_atualizacao, '%Y-%m-%d %H:%M:%S') AS data_atualizacao "
        f"FROM job_flags WHERE data_atualizacao < TIMESTAMP '{LAST_DAY}' AND vag_id NOT IN (SELECT vag_id FROM done) "
        f"UNION ALL SELECT vag_id, min(cargo_id), '{NOW}' FROM done GROUP BY vag_id",
    ),
    "normalize_pending_counts": _run_sql(
        "jobs",
        f"SELECT count(*) AS total, count(*) FILTER (job_id IN {_ELIGIBLE}) AS eligible, "
        f"count(*) FILTER (job_id IN {_ELIGIBLE} AND role_id IS NOT NULL) AS normalized, "
        f"count(*) FILTER (job_id IN {_ELIGIBLE} AND role_id IS NOT NULL) AS written "
        "FROM pending LEFT JOIN roles_found USING (title)",
    ),
    "normalize_pending_roles": _run_sql(
        "jobs",
        f", done AS ({_DONE}), new AS (SELECT vag_id, min(cargo_id) AS new FROM done GROUP BY vag_id), {_TARGET} "
        "SELECT vag_id, coalesce(new, cargo_id) AS cargo_id FROM target LEFT JOIN new USING (vag_id) "
        "UNION ALL SELECT vag_id, new FROM new WHERE vag_id NOT IN (SELECT vag_id FROM target)",
    ),
    "normalize_pending_messages": _run_sql(
        "jobs", f", done AS ({_DONE}) " + _messages("done", "vag_id", _JOB_ITEM, _JOB_START)
    ),
    "normalize_pending_windowed": _run_sql(
        "jobs",
        "SELECT p.job_id AS vag_id, p.title, f.role_id AS cargo_id FROM pending p JOIN roles_found f USING (title) "
        f"WHERE p.job_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate > {_NOW_SQL} - INTERVAL 168 DAY "
        f"AND o_orderdate <= {_NOW_SQL})",
    ),
    "normalize_pending_resumed": _run_sql(
        "jobs",
        ", done AS (SELECT p.job_id AS vag_id, min(f.role_id) AS new FROM pending p JOIN roles_found f USING (title) "
        f"WHERE p.job_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate > {_NOW_SQL} - INTERVAL 168 DAY "
        f"AND o_orderdate <= {_NOW_SQL}) GROUP BY p.job_id), {_TARGET} "
        "SELECT vag_id, coalesce(new, cargo_id) AS cargo_id FROM target LEFT JOIN done USING (vag_id) "
        "UNION ALL SELECT vag_id, new FROM done WHERE vag_id NOT IN (SELECT vag_id FROM target)",
    ),
    "normalize_pending_cvs_windowed": _run_sql(
        "cvs",
        "SELECT p.cv_id AS cur_id, p.title, f.role_id AS cargo_id FROM pending p JOIN roles_found f USING (title) "
        f"WHERE p.cv_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate > {_NOW_SQL} - INTERVAL 12 MONTH "
        f"AND o_orderdate <= {_NOW_SQL})",
    ),
    "normalize_pending_cvs": _run_sql(
        "cvs",
        ", done AS (SELECT cv_id AS cur_id, min(role_id) AS new FROM pending JOIN roles_found USING (title) GROUP BY cv_id) "
        "SELECT r.cur_id, coalesce(new, cargo_id) AS cargo_id FROM cv_role_rows r LEFT JOIN done USING (cur_id) "
        "UNION ALL SELECT cur_id, new FROM done WHERE cur_id NOT IN (SELECT cur_id FROM cv_role_rows)",
    ),
    "normalize_pending_work_exp": _run_sql(
        "work",
        ", done AS (SELECT work_exp_id AS curexpprof_id, min(role_id) AS new FROM pending JOIN roles_found USING (title) "
        "GROUP BY work_exp_id) SELECT r.curexpprof_id, coalesce(new, cargo_id) AS cargo_id FROM work_exp_role_rows r "
        "LEFT JOIN done USING (curexpprof_id) UNION ALL SELECT curexpprof_id, new FROM done "
        "WHERE curexpprof_id IN (SELECT curexpprof_id FROM work_experiences) "
        "AND curexpprof_id NOT IN (SELECT curexpprof_id FROM work_exp_role_rows)",
    ),
}

# In place or as a new table, the rows are the same.
for _name in ("update_existing", "write_roles", "upsert_flags"):
    ORACLES[f"{_name}_in_buckets"] = ORACLES[_name]
