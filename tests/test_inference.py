"""Role inference against the loops it stands for."""

from __future__ import annotations

import random

import pytest

from titleloom.operators import inference as inf
from titleloom.sources.events import job_roles, read_applies, read_contacts, user_roles


def mode(roles):
    roles = [r for r in roles if r]
    return max(roles, key=lambda r: (roles.count(r), -roles.index(r))) if roles else 0


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(9)
    applies = [(rng.choice([1, 1, 1, 1, 2, 3, 4]), rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8]), 1000 + rng.randint(0, 400), i) for i in range(3000)]
    contacts = [(rng.randint(0, 5), rng.randint(1, 6), rng.randint(0, 50), i) for i in range(60)]
    jobs = {j: rng.choice([None, 0, 11, 12, 13]) for j in range(8)}
    users = {1: 21, 2: None, 3: 22, 4: 22, 6: None}
    frames = {
        "applies": spark.createDataFrame(applies, "user_id long, job_id long, t long, event_id long").selectExpr(
            "user_id", "job_id", "timestamp_seconds(t) AS ts", "event_id"
        ),
        "contacts": spark.createDataFrame(contacts, "vag_id long, usr_id long, t long, event_id long").selectExpr(
            "vag_id", "usr_id", "timestamp_seconds(t) AS ts", "event_id"
        ),
        "job_roles": spark.createDataFrame(list(jobs.items()), "job_id long, role_id int"),
        "user_roles": spark.createDataFrame(list(users.items()), "user_id long, role_id int"),
    }
    return applies, contacts, jobs, users, frames


def newest(applies, column, key, limit=200):
    mine = [a for a in applies if a[column] == key]
    return sorted(mine, key=lambda a: (a[2], a[3]), reverse=True)[:limit]


def test_users(spark, world):
    applies, _, jobs, _, frames = world
    ids = spark.createDataFrame([(u,) for u in (1, 2, 3, 4, 5, 5)], "user_id long")
    found = {r.user_id: r.role_id for r in inf.infer_user_roles(ids, frames["applies"], frames["job_roles"]).collect()}
    assert found == {u: mode([jobs[a[1]] for a in newest(applies, 0, u) if a[1] in jobs]) for u in range(1, 6)}


def test_which_applies_count_is_a_setting(spark, world):
    applies, _, jobs, users, frames = world
    ids = spark.createDataFrame([(u,) for u in range(1, 6)], "user_id long")
    recent = [a for a in applies if a[2] > 1200]
    setting = {"limit": 4, "days": 1, "as_of": "1970-01-02 00:20:00"}
    found = inf.infer_user_roles(ids, frames["applies"], frames["job_roles"], **setting).collect()
    expected = {u: mode([jobs[a[1]] for a in newest(recent, 0, u, 4) if a[1] in jobs]) for u in range(1, 6)}
    assert {r.user_id: r.role_id for r in found} == expected
    ids = spark.createDataFrame([(j,) for j in range(9)], "job_id long")
    nobody = frames["contacts"].filter("1 = 0")
    found = inf.infer_job_roles(ids, nobody, frames["applies"], frames["user_roles"], **setting).collect()
    expected = {j: mode([users[a[0]] for a in newest(recent, 1, j, 4) if a[0] in users]) for j in range(9)}
    assert {r.job_id: r.role_id for r in found} == expected


def by_apply(applies, users, job):
    return [users[a[0]] for a in newest(applies, 1, job) if a[0] in users]


def by_contact(contacts, users, job):
    return [users[c[1]] for c in sorted(contacts, key=lambda c: (c[2], c[3])) if c[0] == job and c[1] in users]


@pytest.mark.parametrize("use_contacts", [True, False])
def test_jobs(spark, world, use_contacts):
    applies, contacts, _, users, frames = world
    ids = spark.createDataFrame([(j,) for j in range(12)], "job_id long")
    found = inf.infer_job_roles(ids, frames["contacts"], frames["applies"], frames["user_roles"], use_contacts).collect()
    expected = {}
    for job in range(12):
        first = by_contact(contacts, users, job) if use_contacts else []
        expected[job] = mode(first or by_apply(applies, users, job))
    assert {r.job_id: r.role_id for r in found} == expected and len(found) == 12


def test_contacts_without_roles_end_the_search(spark):
    contacts = spark.sql("SELECT 1L AS vag_id, 2L AS usr_id, timestamp'2024-01-01' AS ts, 1L AS event_id")
    applies = spark.sql("SELECT 3L AS user_id, 1L AS job_id, timestamp'2024-01-01' AS ts, 1L AS event_id")
    roles = spark.createDataFrame([(2, None), (3, 7)], "user_id long, role_id int")
    ids = spark.createDataFrame([(1,)], "job_id long")
    assert inf.infer_job_roles(ids, contacts, applies, roles).first().role_id == 0
    assert inf.infer_job_roles(ids, contacts, applies, roles, use_contacts=False).first().role_id == 7


def test_mode_ties_go_to_the_first_seen(spark):
    votes = spark.createDataFrame(
        [(1, 5, 0), (1, 6, 1), (1, 6, 2), (1, 5, 3), (2, 0, 0), (2, None, 1), (3, 0, 0), (3, 0, 1), (3, 4, 2)], "id int, role_id int, at int"
    )
    assert {r.id: r.role_id for r in inf.most_frequent_role(votes, "id", "at").collect()} == {1: 5, 2: 0, 3: 4}


def test_no_ids_and_no_applies(spark, world):
    frames = world[4]
    nobody = spark.createDataFrame([], "user_id long")
    assert inf.infer_user_roles(nobody, frames["applies"], frames["job_roles"]).count() == 0
    ids = spark.createDataFrame([(1,)], "user_id long")
    assert inf.infer_user_roles(ids, frames["applies"].filter("1 = 0"), frames["job_roles"]).first().role_id == 0


def test_days_limit_and_contacts(spark, world):
    applies, contacts, _, _, frames = world
    recent = read_applies(frames["applies"], "user_id", limit=3, days=1, as_of="1970-01-02 00:20:00")
    assert {r.ts.timestamp() > 1200 for r in recent.collect()} == {True}
    with pytest.raises(ValueError):
        read_applies(frames["applies"], "user_id", days=1)
    ids = spark.createDataFrame([(2,), (2,)], "job_id long")
    assert read_contacts(frames["contacts"], ids).count() == sum(c[0] == 2 for c in contacts)


def test_last_role_row_wins(spark):
    jobs = spark.createDataFrame([(1,), (2,), (1,)], "vag_id long")
    rows = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (3, 5, 1)], "vag_id long, cargo_id int, pos int")
    assert {r.job_id: r.role_id for r in job_roles(jobs, rows, "pos").collect()} == {1: 4, 2: None}
    cvs = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "usr_id long, cur_id long")
    roles = spark.createDataFrame([(1, 9), (3, 0)], "cur_id long, cargo_id int")
    assert {r.user_id: r.role_id for r in user_roles(cvs, roles).collect()} == {7: None, 8: 0}


def test_response(spark):
    answers = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "job_id long, role_id int, at int")
    assert [tuple(r) for r in inf.inference_response(answers, "job_id", "at").collect()] == [
        ("1", '{"role_title":"","role_id":6}')
    ]
