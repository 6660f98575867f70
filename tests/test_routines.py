"""Pending rows, windows, keyed writes, messages, rollback and the whole routine."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom.operators import windows as win
from titleloom.operators import writeback as wb
from titleloom.operators.catalogue import build_catalogue
from titleloom.operators.normalize import Steps
from titleloom.plans import routines
from titleloom.sources import pending

AS_OF = "2024-05-31 12:00:00"
STEPS = Steps(correct_typos=False)


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def moments(spark, *texts):
    return table(spark, "t string", *[(t,) for t in texts]).select(F.to_timestamp("t").alias("at"))


def test_windows_touch_and_do_not_overlap(spark):
    now = datetime.fromisoformat(AS_OF)
    edges = [now - timedelta(weeks=w) for w in range(26)]
    rows = moments(spark, *[str(e + timedelta(seconds=s)) for e in edges for s in (-1, 0, 1)])
    for function, last in ((win.weekly_windows, 23), (win.user_windows, 30)):
        found = {r.at: r.window for r in function(rows, "at", AS_OF).collect()}
        for week in range(24):
            assert found[edges[week]] == week
            assert found[edges[week + 1] + timedelta(seconds=1)] == week
        assert now + timedelta(seconds=1) not in found and max(found.values()) <= last
    weekly = {r.at for r in win.weekly_windows(rows, "at", AS_OF).collect()}
    assert edges[24] not in weekly and edges[24] + timedelta(seconds=1) in weekly


def test_month_windows(spark):
    rows = moments(spark, "2023-12-10 00:00:00", "2023-11-30 12:00:01", "2023-11-30 12:00:00", "2023-06-01 00:00:00", "2023-05-31 12:00:00")
    found = {str(r.at): r.window for r in win.user_windows(rows, "at", AS_OF).collect()}
    assert found == {"2023-12-10 00:00:00": 24, "2023-11-30 12:00:01": 24, "2023-11-30 12:00:00": 25, "2023-06-01 00:00:00": 30}


def test_recent_jobs_start_on_the_first_of_the_month(spark):
    rows = moments(spark, "2023-11-01 00:00:00", "2023-11-01 00:00:01")
    assert [str(r.at) for r in win.recent_jobs_filter(rows, "at", AS_OF).collect()] == ["2023-11-01 00:00:01"]


def test_pending_jobs(spark):
    jobs = table(
        spark, "vag_id long, titulo string, status string, data_entrada string",
        *[(i, "t", "A", "2024-05-01") for i in range(1, 8)], (8, "", "A", "2024-05-01"), (9, None, "A", "2024-05-01"),
        (10, "t", "I", "2024-05-01"), (11, "t", "A", "2020-01-01"), (1, "t", "A", "2024-05-01"),
    ).withColumn("data_entrada", F.to_timestamp("data_entrada"))
    display = table(spark, "vag_id long, organizacao_id int", *[(i, 1) for i in range(1, 12) if i != 2], (1, 1), (2, 3))
    roles = table(spark, "vag_id long, cargo_id int", (3, 5), (4, 0), (5, None), (6, 5), (6, 0))
    found = pending.pending_jobs(jobs, display, roles, AS_OF).collect()
    assert sorted(tuple(r) for r in found) == [(1, "t"), (4, "t"), (5, "t"), (6, "t"), (7, "t")]


def test_pending_users(spark):
    users = table(spark, "usr_id long, status string, organizacao_id int", (1, "A", 1), (2, "I", 1), (3, "A", 2), (4, "A", None))
    cvs = table(spark, "cur_id long, usr_id long, objetivo string", (10, 1, "x"), (11, 1, ""), (12, 1, "y"), (20, 2, "x"), (30, 3, "x"))
    roles = table(spark, "cur_id long, cargo_id int", (12, 3))
    assert [tuple(r) for r in pending.pending_cvs(users, cvs, roles).collect()] == [(1, 10, "x")]
    work = table(spark, "curexpprof_id long, cur_id long, cargo string", (100, 10, "a"), (101, 11, "b"), (102, 20, "c"), (103, 10, None))
    work_roles = table(spark, "curexpprof_id long, cargo_id int", (100, 0))
    found = pending.pending_work_exp(users, cvs, work, work_roles).collect()
    assert sorted(tuple(r) for r in found) == [(1, 10, 100, "a"), (1, 11, 101, "b")]


@pytest.fixture(scope="module")
def target(spark):
    return table(spark, "vag_id long, cargo_id int", (1, 5), (2, None), (3, 7), (3, 7))


@pytest.fixture(scope="module")
def updates(spark):
    return table(spark, "vag_id long, cargo_id int, pos int", (2, 20, 1), (2, 10, 2), (4, 40, 3), (5, 50, 4), (4, 39, 5))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_keyed_writes(spark, target, updates):
    old = [(1, 5), (2, None), (3, 7), (3, 7)]
    assert rows(wb.insert_missing(target, updates, "vag_id", "pos")) == sorted([*old, (4, 40), (5, 50)], key=str)
    parent = table(spark, "vag_id long", (5,), (5,), (2,))
    assert rows(wb.insert_missing_with_parent(target, updates, parent, "vag_id", "pos")) == sorted([*old, (5, 50)], key=str)
    assert rows(wb.update_existing(target, updates, "vag_id", "pos")) == [(1, 5), (2, 20), (3, 7), (3, 7)]
    assert rows(wb.write_roles(target, updates, "vag_id", parent, "pos")) == [(1, 5), (2, 20), (3, 7), (3, 7), (5, 50)]


def test_flags(spark):
    flags = table(spark, "usr_id int, cur_id int, curexpprof_id int, cargo_id int", (1, 1, 0, 5), (1, 2, 0, 6)).withColumn(
        "data_atualizacao", F.lit("2024-01-01").cast("timestamp")
    )
    fresh = table(spark, "usr_id int, cur_id int, curexpprof_id int, cargo_id int", (1, 1, None, 9), (2, 5, 7, None))
    done = wb.upsert_flags(flags, fresh, ["usr_id", "cur_id", "curexpprof_id"], AS_OF)
    assert rows(done.withColumn("data_atualizacao", F.year("data_atualizacao") * 100 + F.month("data_atualizacao"))) == [
        (1, 1, 0, 9, 202405), (1, 2, 0, 6, 202401), (2, 5, 7, 0, 202405)
    ]


def sent_ids():
    return sorted({i * 17 % 9001 for i in range(1234)} | {0, 1, 2})


def test_ids_far_apart_fill_their_messages(spark):
    ids = spark.range(1000).selectExpr("id * 10007 AS usr_id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS usr_id"))
    found = sorted((r.batch, json.loads(r.message)["usr_ids"]) for r in wb.user_index_messages(ids).collect())
    assert found == [(b, [i * 10007 for i in range(100 * b, 100 * b + 100)]) for b in range(10)]
    assert wb.user_index_messages(ids.filter("usr_id < 0")).collect() == []


def test_messages_hold_up_to_a_hundred_distinct_ids(spark):
    ids = spark.range(1234).selectExpr("id * 17 % 9001 AS vag_id").unionByName(spark.range(3).selectExpr("id AS vag_id"))
    messages = [json.loads(r.message)["events"] for r in wb.job_index_messages(ids).collect()]
    assert sorted(len(m) for m in messages) == sorted([len(sent_ids()) % 100] + [100] * (len(sent_ids()) // 100))
    assert all(m[0]["new_status"] == "A" for m in messages)
    sent = [e["vag_id"] for m in messages for e in m]
    assert sorted(sent) == sent_ids()
    users = wb.user_index_messages(ids.withColumnRenamed("vag_id", "usr_id")).first()
    assert list(json.loads(users.message)) == ["usr_ids"]


def test_rollback(spark):
    flags = table(
        spark, "usr_id int, cur_id int, curexpprof_id int, t string",
        (1, 1, 0, "2024-01-01 00:00:00"), (1, 2, 0, "2024-01-02 23:59:59"), (1, 3, 0, "2024-01-03 00:00:00"), (1, 1, 8, "2024-01-01 05:00:00"),
    ).withColumn("data_atualizacao", F.to_timestamp("t"))
    cvs = table(spark, "cur_id int, cargo_id int", (1, 10), (2, 11), (3, 12), (8, 13))
    work = table(spark, "curexpprof_id int, cargo_id int", (8, 20), (1, 21))
    back = wb.rollback_users(flags, cvs, work, "2024-01-01", "2024-01-02")
    assert rows(back[0]) == [(1, 0, True), (2, 0, True), (3, 12, False), (8, 13, False)]
    assert rows(back[1]) == [(1, 21, False), (8, 0, True)]
    dry = wb.rollback_users(flags, cvs, work, "2024-01-01", "2024-01-02", dry_run=True)
    assert rows(dry[0]) == [(1, 10, True), (2, 11, True), (3, 12, False), (8, 13, False)]
    everything = wb.rollback_jobs(flags.withColumnRenamed("cur_id", "vag_id"), cvs.withColumnRenamed("cur_id", "vag_id"))
    assert rows(everything) == [(1, 0, True), (2, 0, True), (3, 0, True), (8, 13, False)]


def test_the_job_routine(spark, lists):
    roles = table(spark, "role_id int, title string, source string", (2, "Advogado", "main"), (3, "Médico", "main"))
    catalogue = build_catalogue(roles, lists)
    waiting = table(spark, "job_id long, title string", (1, "Advogada"), (2, "medico/advogado"), (3, "nada"), (4, "advogado"), (5, "x"))
    groups = table(spark, "id long, ab_test_group string", (1, "b"), (2, "b"), (3, "b"), (4, "a"))
    target = table(spark, "vag_id long, cargo_id int", (1, 0), (9, 9))
    flags = table(spark, "vag_id long, cargo_id int", (2, 1)).withColumn("data_atualizacao", F.lit("2020-01-01").cast("timestamp"))
    run = routines.normalize_pending_jobs(waiting, catalogue, lists, target, flags, AS_OF, steps=STEPS, assignments=groups)
    assert rows(run.normalized.select("vag_id", "cargo_id")) == [(1, 2), (2, 3)]
    assert rows(run.roles) == [(1, 2), (2, 3), (9, 9)]
    assert rows(run.flags.select("vag_id", "cargo_id")) == [(1, 2), (2, 3)]
    assert tuple(run.counts.first()) == (5, 3, 2, 2)
    assert [json.loads(r.message)["events"] for r in run.messages.collect()] == [
        [{"vag_id": 1, "new_status": "A"}, {"vag_id": 2, "new_status": "A"}]
    ]
    everyone = routines.normalize_pending_jobs(waiting, catalogue, lists, target, flags, AS_OF, steps=STEPS)
    assert tuple(everyone.counts.first()) == (5, 5, 3, 3)


def test_the_user_routines(spark, lists):
    catalogue = build_catalogue(table(spark, "role_id int, title string, source string", (2, "Advogado", "main")), lists)
    flags = spark.createDataFrame(
        [], "usr_id long, cur_id long, curexpprof_id long, cargo_id int, data_atualizacao timestamp"
    )
    cvs = table(spark, "user_id long, cv_id long, title string", (1, 10, "advogada"), (1, 11, "x"))
    none = spark.createDataFrame([], "cur_id long, cargo_id int")
    run = routines.normalize_pending_cvs(cvs, catalogue, lists, none, flags, AS_OF, steps=STEPS)
    assert rows(run.roles) == [(10, 2)]
    assert rows(run.flags.drop("data_atualizacao")) == [(1, 10, 0, 2)]
    work = table(spark, "user_id long, cv_id long, work_exp_id long, title string", (1, 10, 7, "advogada"), (1, 10, 8, "advogado"))
    parent = table(spark, "curexpprof_id long", (7,))
    roles = spark.createDataFrame([], "curexpprof_id long, cargo_id int")
    run = routines.normalize_pending_work_exp(work, catalogue, lists, roles, parent, flags, AS_OF, steps=STEPS)
    assert rows(run.roles) == [(7, 2)]
    assert tuple(run.counts.first()) == (2, 2, 2, 1)
    assert [json.loads(r.message) for r in run.messages.collect()] == [{"usr_ids": [1]}]
