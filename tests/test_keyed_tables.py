"""Keyed tables: a change rewrites the buckets it touches; a stream keeps one row per key over any number of batches."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from titleloom.operators import keyed_tables as kt
from titleloom.operators import writeback as wb
from titleloom.streaming import titles as st
from titleloom.streaming import upserts as up


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "roles")
    target = spark.range(3000).selectExpr("id AS vag_id", "CAST(id % 7 AS INT) AS cargo_id")
    kt.write_keyed_table(target, path, ["vag_id"], 32)
    before = files(path)
    updates = spark.createDataFrame([(5, 99, 1), (5, 98, 2), (6, 6, 1), (7, None, 1), (None, 4, 1)], "vag_id long, cargo_id int, pos int")
    changed = kt.update_existing_at(spark, path, updates, "vag_id", "pos", 32)
    assert rows(kt.read_keyed_table(spark, path)) == rows(wb.update_existing(target, updates, "vag_id", "pos"))
    gone = {f.split("/")[0] for f in before - files(path)}
    assert gone == {f"key_bucket={b}" for b in changed} and len(changed) == 1
    assert kt.update_existing_at(spark, path, updates, "vag_id", "pos", 32) == []
    assert kt.update_existing_at(spark, path, updates.limit(0), "vag_id", "pos", 32) == []


def test_upserts_in_place_equal_new_tables(spark, tmp_path):
    rng = random.Random(3)
    old = [(u, c, rng.randint(1, 9), "2020-01-01 00:00:00") for u in range(40) for c in (0, 1)]
    flags = spark.createDataFrame(old, "usr_id long, cur_id long, cargo_id int, at string").selectExpr(
        "usr_id", "cur_id", "cargo_id", "CAST(at AS timestamp) AS data_atualizacao"
    )
    drawn = [(rng.choice([None, rng.randint(0, 60)]), rng.choice([0, 1, 2, None]), rng.choice([None, 5, 6]), i) for i in range(30)]
    updates = spark.createDataFrame(drawn, "usr_id long, cur_id long, cargo_id int, pos int")
    path, now, keys = str(tmp_path / "flags"), "2021-05-05 01:02:03", ["usr_id", "cur_id"]
    kt.write_keyed_table(flags, path, keys, 8)
    kt.upsert_flags_at(spark, path, updates, keys, now, "pos", 8)
    assert rows(kt.read_keyed_table(spark, path)) == rows(wb.upsert_flags(flags, updates, keys, now, "pos"))
    assert kt.upsert_flags_at(spark, path, updates, keys, now, "pos", 8) == []


def arriving(spark, source, seed, count=120):
    rng = random.Random(seed)
    found = [(rng.randint(0, 40), rng.choice([None, 1, 2, 3]), seed * 1000 + rng.randint(0, 60)) for _ in range(count)]
    frame = spark.createDataFrame([*found, (None, 1, 1), (3, 1, None)], "vag_id long, cargo_id int, at long")
    frame.coalesce(1).write.mode("append").parquet(source)
    return found


def test_a_stream_that_is_stopped_gives_the_table_of_one_run(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    # The second file has older positions than the first: it changes only keys that it brings.
    sent = [row for seed in (2, 1, 3) for row in arriving(spark, source, seed)]
    calls = []

    def stopped(*args):
        calls.append(1)
        if len(calls) == 1:
            kt.rewrite_touched(*args)
            raise RuntimeError("stopped behind the write")
        return kt.rewrite_touched(*args)

    monkeypatch.setattr(up, "rewrite_touched", stopped)

    def run():
        stream = st.read_title_stream(spark, source, "vag_id long, cargo_id int, at long", files_per_batch=1)
        up.upsert_stream(stream, ["vag_id"], "at", out, state, 8).awaitTermination()

    with pytest.raises(Exception, match="stopped behind the write"):
        run()
    run()
    expected = {}
    # By position, of equal ones the lowest role last.
    for key, role, _ in sorted(sent, key=lambda r: (r[2], -(r[1] or 0))):
        expected[key] = (key, role or 0)
    found = kt.read_keyed_table(spark, out, "vag_id long, cargo_id long")
    assert sorted((r["vag_id"], r["cargo_id"]) for r in found.collect()) == sorted(expected.values())
    assert len(files(out)) <= 8


def test_a_stream_without_rows_leaves_an_empty_table(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(None, 1, 1)], "vag_id long, cargo_id int, at long").write.parquet(source)
    stream = st.read_title_stream(spark, source, "vag_id long, cargo_id int, at long")
    up.upsert_stream(stream, ["vag_id"], "at", out, state, 8).awaitTermination()
    assert kt.read_keyed_table(spark, out, "vag_id long, cargo_id long").count() == 0
