"""Routines that go on where they were stopped; word frequencies that take each load once."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from titleloom.operators import keyed_tables as kt
from titleloom.operators import windows as win
from titleloom.operators import word_loads as wl
from titleloom.operators.catalogue import build_catalogue
from titleloom.operators.normalize import Steps
from titleloom.plans import ledger, routines

AS_OF = "2024-05-31 12:00:00"
STEPS = Steps(correct_typos=False)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def table(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def outputs(spark, folder, flag_schema):
    out = ledger.Outputs(*[f"{folder}/{n}" for n in ("roles", "flags", "messages", "counts", "ledger")], 4)
    kt.write_keyed_table(table(spark, "vag_id long, cargo_id int", (2, 0), (999, 9)), out.roles, ["vag_id"], 4)
    kt.write_keyed_table(spark.createDataFrame([], flag_schema), out.flags, ["vag_id"], 4)
    return out


@pytest.fixture(scope="module")
def waiting(spark):
    now = datetime.fromisoformat(AS_OF)
    jobs = [(i, ("Advogada", "medico", "nada")[i % 3], "A", now - timedelta(days=5 * i)) for i in range(1, 45)]
    frame = table(spark, "vag_id long, titulo string, status string, data_entrada timestamp", *jobs)
    display = frame.selectExpr("vag_id", "1 AS organizacao_id")
    none = table(spark, "vag_id long, cargo_id int", (3, 5))
    return frame, display, none


@pytest.fixture(scope="module")
def catalogue(spark, lists):
    roles = table(spark, "role_id int, title string, source string", (2, "Advogado", "main"), (3, "Médico", "main"))
    return build_catalogue(roles, lists)


FLAGS = "vag_id long, cargo_id int, data_atualizacao timestamp"


def state(spark, out):
    sent = [e["vag_id"] for r in spark.read.parquet(out.messages).collect() for e in json.loads(r.message)["events"]]
    counts = spark.read.parquet(out.counts).agg(*[F.sum(c) for c in ("total", "eligible", "normalized", "written")])
    return rows(kt.read_keyed_table(spark, out.roles)), rows(kt.read_keyed_table(spark, out.flags)), sorted(sent), rows(counts)


def test_a_stopped_routine_ends_like_one_that_ran_through(spark, lists, waiting, catalogue, tmp_path, monkeypatch):
    whole, parts = (outputs(spark, tmp_path / n, FLAGS) for n in ("whole", "parts"))
    run = lambda out, **o: ledger.resume_jobs_routine(*waiting, AS_OF, catalogue, lists, out, steps=STEPS, together=8, **o)
    assert run(whole) == list(range(24))
    assert run(parts, at_most=1) == list(range(8))

    # Stopped between the outputs of a step: the flags of windows 8 to 15 are not written.
    real, asked = ledger.upsert_flags_at, []

    def stop(*_, **__):
        raise RuntimeError("stopped")

    monkeypatch.setattr(ledger, "upsert_flags_at", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        run(parts)
    monkeypatch.setattr(ledger, "upsert_flags_at", real)
    weekly = ledger.weekly_windows
    monkeypatch.setattr(ledger, "weekly_windows", lambda *a, only: asked.append(list(only)) or weekly(*a, only=only))
    assert run(parts) == list(range(8, 24))
    # Windows 8 to 15 had their rows: only the rest was read.
    assert asked == [list(range(16, 24))]
    assert run(parts) == [] and len(asked) == 1
    assert state(spark, parts) == state(spark, whole)

    jobs, display, none = waiting
    once = routines.run_jobs_routine(
        jobs, display, none, AS_OF, catalogue, lists, table(spark, "vag_id long, cargo_id int", (2, 0), (999, 9)),
        spark.createDataFrame([], FLAGS), steps=STEPS,
    )
    roles, flags, sent, counts = state(spark, parts)
    assert roles == rows(once.roles) and flags == rows(once.flags) and counts == rows(once.counts)
    assert sent == sorted(r.vag_id for r in once.normalized.collect())


def test_another_day_and_another_routine_have_their_own_windows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.ledger_states(spark, path, "jobs", AS_OF) == {}
    ledger._enter(spark, path, [("jobs", AS_OF, 0, ledger.FINISHED, "a"), ("jobs", AS_OF, 0, ledger.MATCHED, "a")])
    assert ledger.ledger_states(spark, path, "jobs", AS_OF) == {0: (ledger.FINISHED, "a")}
    assert ledger.ledger_states(spark, path, "cvs", AS_OF) == {}
    assert ledger.ledger_states(spark, path, "jobs", "2024-06-01 12:00:00") == {}
    states = {1: (ledger.FINISHED, "a"), 3: (ledger.MATCHED, "b"), 4: (ledger.MATCHED, "b"), 5: (ledger.MATCHED, "c")}
    assert ledger._steps(states, 9, 2) == [([0], None), ([2], None), ([3, 4], "b"), ([5], "c"), ([6, 7], None), ([8], None)]


def test_windows_by_number(spark):
    now = datetime.fromisoformat(AS_OF)
    frame = table(spark, "at timestamp", *[(now - timedelta(days=d),) for d in range(400)])
    for function, count in ((win.weekly_windows, win.window_count()), (win.user_windows, win.window_count(users=True))):
        every = rows(function(frame, "at", AS_OF))
        assert {w for _, w in every} == set(range(count))
        for only in ([0], [2, 3], [1, 5, count - 1], []):
            assert rows(function(frame, "at", AS_OF, only=only)) == [r for r in every if r[1] in only]


def test_the_user_routines_resume(spark, lists, catalogue, tmp_path):
    flag_schema = "usr_id long, cur_id long, curexpprof_id long, cargo_id int, data_atualizacao timestamp"
    keys = ["usr_id", "cur_id", "curexpprof_id"]
    day = datetime.fromisoformat(AS_OF) - timedelta(days=200)
    users = table(spark, "usr_id long, status string, organizacao_id int", (1, "A", 1))
    cvs = table(spark, "cur_id long, usr_id long, objetivo string, data_alteracao timestamp", (10, 1, "advogada", day))
    work = table(spark, "curexpprof_id long, cur_id long, cargo string", (7, 10, "medico"))
    for name, key, expected in (("cvs", "cur_id", (10, 2)), ("work", "curexpprof_id", (7, 3))):
        out = ledger.Outputs(*[f"{tmp_path}/{name}/{n}" for n in ("roles", "flags", "messages", "counts", "ledger")], 2)
        none = spark.createDataFrame([], f"{key} long, cargo_id int")
        kt.write_keyed_table(table(spark, f"{key} long, cargo_id int", (999, 1)), out.roles, [key], 2)
        kt.write_keyed_table(table(spark, flag_schema, (5, 5, 5, 5, day)), out.flags, keys, 2)
        tables = (users, cvs, none) if name == "cvs" else (users, cvs, work, none)
        resume = ledger.resume_cvs_routine if name == "cvs" else ledger.resume_work_exp_routine
        assert resume(*tables, AS_OF, catalogue, lists, out, steps=STEPS, together=16) == list(range(31))
        assert rows(kt.read_keyed_table(spark, out.roles)) == sorted([(999, 1), expected], key=repr)
        assert kt.read_keyed_table(spark, out.flags).count() == 2


def words(spark, *values):
    return table(spark, "word string, freq bigint", *values)


def test_a_load_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "words")
    assert rows(wl.read_word_freq(spark, path)) == []
    many = [(f"w{i}", 1) for i in range(50)]
    assert wl.add_word_load(spark, path, "a", words(spark, *many, ("w0", 4)))
    assert wl.add_word_load(spark, path, "b", words(spark, ("w0", 1), ("x", 2)))
    assert not wl.add_word_load(spark, path, "b", words(spark, ("w0", 1), ("x", 2)))
    assert not wl.add_word_load(spark, path, "a", words(spark, *many))
    found = dict(rows(wl.read_word_freq(spark, path)))
    assert found["w0"] == 6 and found["x"] == 2 and len(found) == 51
    # A small load leaves the large part where it is.
    assert len(wl._live(wl._parts(spark, path))) == 2

    # Stopped after the words of a load were written, before they were entered.
    written = wl.constant_table
    monkeypatch.setattr(wl, "constant_table", lambda s, c, values: written(s, c, values) if not values else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        wl.add_word_load(spark, path, "c", words(spark, ("x", 100)))
    monkeypatch.setattr(wl, "constant_table", written)
    assert dict(rows(wl.read_word_freq(spark, path))) == found
    assert wl.add_word_load(spark, path, "c", words(spark, ("x", 1)))
    assert dict(rows(wl.read_word_freq(spark, path))) == {**found, "x": 3}
    assert wl.compact_word_loads(spark, path, always=True) and len(wl._live(wl._parts(spark, path))) == 1
    assert not wl.compact_word_loads(spark, path, always=True)
    assert dict(rows(wl.read_word_freq(spark, path))) == {**found, "x": 3}
    assert not wl.add_word_load(spark, path, "c", words(spark, ("x", 1)))


def test_parts_merge_when_the_small_ones_weigh_as_much(spark, tmp_path):
    path = str(tmp_path / "words")
    for load in range(9):
        wl.add_word_load(spark, path, str(load), words(spark, *[(f"{load}-{i}", 1) for i in range(4)], ("all", 1)))
    live = wl._live(wl._parts(spark, path))
    assert live[0]["rows"] > sum(e["rows"] for e in live[1:])
    found = dict(rows(wl.read_word_freq(spark, path)))
    assert found["all"] == 9 and len(found) == 37
