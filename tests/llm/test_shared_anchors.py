from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from titleloom.llm import bwt_merge
from titleloom.llm.common import DROP_SHUFFLES, staged


def _expected(rows: list[tuple], length: int = 50) -> list[tuple]:
    """By brute force; a null doc_id is before all others."""
    contents = [(float("-inf") if i is None else i, i, (t or "").encode()) for i, t in sorted(set(rows), key=str)]
    first: dict = {}
    for key, _, data in contents:
        for k in range(len(data) - length + 1):
            first[data[k : k + length]] = min(first.get(data[k : k + length], key), key)
    found = []
    for key, i, data in contents:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < key:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        found.append((i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def _rows() -> list[tuple]:
    draw = np.random.default_rng(5)
    parts = ["".join(draw.choice(list("abcd é"), n)) for n in (49, 50, 51, 60, 84, 120, 300)]
    texts = ["".join(draw.choice(parts) for _ in range(draw.integers(1, 4))) for _ in range(40)]
    texts += [t[k:] for t, k in zip(texts, (1, 7, 20, 33, 34, 35), strict=False)] + ["ab" * 100, "ba" * 100, "a" * 99, "a" * 50]
    rows = [(int(draw.integers(0, 30)), t) for t in texts for _ in range(int(draw.integers(1, 4)))]
    return [*rows, (None, texts[0]), (None, texts[0]), (None, texts[1]), (31, None), (32, ""), (33, "x" * 49), (34, "x" * 49)]


def test_repeated_ids_copies_and_borders_against_brute_force(spark):
    rows = _rows()
    found = bwt_merge.drop_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == _expected(rows)


def test_only_anchors_with_a_partner_go_on(spark):
    draw = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    same, phrase = "".join(draw.choice(letters, 500)), "".join(draw.choice(letters, 30))
    alone = [[phrase + "".join(draw.choice(letters, 70)) for _ in range(10)] for _ in range(40)]
    rows = [*[(k, "".join(x)) for k, x in enumerate(alone)], *[(100 + k, same) for k in range(50)]]
    docs = spark.createDataFrame(rows, "key_text long, content string").withColumn("content", F.col("content").cast("binary"))
    docs = docs.withColumn("key_text", F.xxhash64("content"))
    spots = bwt_merge._spots(docs, 50)
    # Copies of one text are no partners, nor are texts that share a phrase shorter than a window.
    assert spots.count() > 2000
    assert bwt_merge._with_partner(spots).count() < 20
    more = docs.unionByName(spark.createDataFrame([(7, bytearray((same + "!").encode()))], docs.schema))
    both = bwt_merge._with_partner(bwt_merge._spots(more, 50)).groupBy("key_text").count().collect()
    assert sum(r["count"] > 20 for r in both) == 2


def test_anchors_with_more_rows_than_are_held_lose_nothing(spark):
    texts = [f"{k:04d}" + "common line that stands in all of the texts and is long enough" + f"{k:04d}" for k in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.xxhash64("t").alias("key_text"), F.col("t").cast("binary").alias("content")
    )
    spots = bwt_merge._spots(docs, 50)
    size, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(size, "16")
    try:
        few = {tuple(r) for r in bwt_merge._with_partner(spots, held=8).collect()}
        all_held = {tuple(r) for r in bwt_merge._with_partner(spots).collect()}
    finally:
        spark.conf.set(size, was)
    assert len(all_held) >= 200 and all_held <= few


def test_shuffles_of_a_staged_table_can_go_at_once(spark):
    was = spark.conf.get(DROP_SHUFFLES, None)
    rows = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "rows", drop_shuffles=True)
    assert {r["count"] for r in rows.collect()} == {142, 143} and spark.conf.get(DROP_SHUFFLES, None) == was


def test_a_phrase_in_very_many_texts_makes_no_partners(spark):
    """By chance sides would be alike in pairs that grow with the square of the texts, if their hashes were short."""
    draw = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    tails = draw.choice(letters, (4000, 80))
    texts = ["".join(t[:40]) + " a phrase of words " + "".join(t[40:]) for t in tails]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.xxhash64("t").alias("key_text"), F.col("t").cast("binary").alias("content")
    )
    assert bwt_merge._with_partner(bwt_merge._spots(docs, 50)).count() == 0
