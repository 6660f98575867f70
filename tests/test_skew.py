"""Joins and rankings with one key holding a large share of the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from titleloom.operators import skew


def rows(spark, n=6000):
    """A third of the rows has one key, some have none."""
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 97) END AS key"
    )


def lookup(spark):
    return spark.range(90).selectExpr("concat('k', id) AS key", "id * 2 AS value").unionByName(
        spark.sql("SELECT 'hot' AS key, CAST(-1 AS BIGINT) AS value")
    )


def sort_key(row):
    return tuple((v is not None, v) for v in row)


def test_joins_equal_the_plain_join(spark, monkeypatch):
    left, right = rows(spark), lookup(spark)
    for how in ("left", "inner"):
        expected = sorted(
            ((r.id, r.key, r.value) for r in left.join(right, "key", how).collect()), key=sort_key
        )

        def result(frame):
            return sorted(((r.id, r.key, r.value) for r in frame.collect()), key=sort_key)

        assert result(skew.join_hot(left, right, ["key"], how)) == expected
        assert result(skew.join_salted(left, right, ["key"], how)) == expected
        assert result(skew.join_lookup(left, right, ["key"], how)) == expected
        with monkeypatch.context() as small:
            small.setattr(skew, "BROADCAST_ROWS", 3)
            assert result(skew.join_lookup(left, right, ["key"], how)) == expected


def test_hot_rows_are_spread(spark):
    """On four tasks a key with a third of the rows is cut in two, and no other key is."""
    left = rows(spark)
    (hot,) = skew.hot_keys(left, ["key"]).collect()
    assert hot["__repeats"] == 2
    assert hot["__hash"] == spark.sql("SELECT xxhash64('hot')").first()[0]
    numbers = left.filter("key = 'hot'").select(F.pmod(skew._spread(left, ["key"], None), F.lit(2)).alias("s"))
    sizes = [r["count"] for r in numbers.groupBy("s").count().collect()]
    assert len(sizes) == 2 and min(sizes) > 800


def test_joins_of_rows_are_never_broadcast(spark, capsys):
    skew.join_hot(rows(spark), lookup(spark), ["key"]).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Cartesian" not in plan


def test_rows_of_keys_alone_are_repeated_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(skew, "PIECE", 7)
    left, right = rows(spark).select("key"), lookup(spark)
    for how in ("left", "inner"):
        expected = sorted((tuple(r) for r in left.join(right, "key", how).collect()), key=sort_key)
        found = skew.join_hot(left, right, ["key"], how)
        assert found.columns == ["key", "value"]
        assert sorted((tuple(r) for r in found.collect()), key=sort_key) == expected
    assert skew.join_hot(left.filter("key = 'none'"), right, ["key"]).count() == 0


def test_more_hot_keys_than_the_least_number(spark, monkeypatch):
    """With many partitions the sketch returns as many keys as can exceed a share."""
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    frame = spark.range(900).selectExpr("id", "id % 3 AS key")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert sorted(r["__repeats"] for r in skew.hot_keys(frame, ["key"]).collect()) == [4, 4, 4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keep_hot_is_a_semi_join(spark):
    left, ids = rows(spark), lookup(spark).unionByName(lookup(spark))
    expected = left.join(ids, "key", "left_semi").select("id", "key")
    assert sorted(map(tuple, skew.keep_hot(left, ids, ["key"]).collect())) == sorted(map(tuple, expected.collect()))


def test_empty_sides(spark):
    nothing = rows(spark).filter("id < 0")
    assert skew.join_hot(nothing, lookup(spark), ["key"]).count() == 0
    assert skew.join_hot(rows(spark), lookup(spark).filter("value > 1000"), ["key"]).count() == 6000


def test_first_per_key_equals_brute_force(spark):
    rng = random.Random(7)
    data = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 30), i) for i in range(5000)]
    frame = spark.createDataFrame(data, "key int, ts int, id int").repartition(13)
    found = skew.first_per_key(frame, ["key"], 200, [F.desc("ts"), F.desc("id")]).collect()
    for key in (1, 2, 3):
        expected = sorted(((t, i) for k, t, i in data if k == key), reverse=True)[:200]
        assert [(r.ts, r.id) for r in sorted((r for r in found if r.key == key), key=lambda r: r.rank)] == expected


def both_sides(spark):
    """One key holds a third of both sides; some keys are null."""
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 97) END AS key"
    return spark.range(6000).selectExpr("id AS a", key), spark.range(3000).selectExpr("id AS b", key)


def test_many_to_many_join_equals_the_plain_join(spark):
    left, right = both_sides(spark)
    found = skew.join_both_hot(left, right, ["key"], ["a"], ["b"])
    plain = left.join(right, "key")
    assert found.columns == plain.columns

    def digest(frame):
        return frame.agg(F.count("*"), F.sum(F.xxhash64("key", "a", "b").cast("decimal(38,0)"))).first()

    assert digest(found) == digest(plain)
    assert skew.join_both_hot(left.filter("a < 0"), right, ["key"], ["a"], ["b"]).count() == 0
    assert skew.join_both_hot(left, right.filter("b < 0"), ["key"], ["a"], ["b"]).count() == 0


def test_pairs_of_a_hot_key_are_spread(spark):
    """With one key in a third of both sides the largest task makes at most twice the pairs of the median one."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        left, right = both_sides(spark)

        def sizes(joined):
            pairs = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return sorted([r["count"] for r in pairs] + [0] * (16 - len(pairs)))

        spread = sizes(skew.join_both_hot(left, right, ["key"], ["a"], ["b"]))
        plain = sizes(left.join(right.hint("merge"), "key"))
        assert sum(spread) == sum(plain)
        assert plain[-1] > 0.9 * sum(plain)
        assert spread[-1] <= 2 * spread[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
