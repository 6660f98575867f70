from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from titleloom.llm import weighted_sampling


def _texts(count: int, words: int) -> list[tuple[int, str]]:
    draw = np.random.default_rng(3)
    return [(i, " ".join(f"w{w}" for w in draw.zipf(1.3, words) % 5000)) for i in range(count)]


def test_few_terms_of_a_long_text_are_drawn(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(2000)))], "id long, text string")
    counted = weighted_sampling.word_counts(docs, ["id"], [(F.col("text"), ("own",))])
    drawn = weighted_sampling.draws(counted, ["own"], ["id"], weighted_sampling.REACH)
    row = drawn.agg(F.count("*").alias("rows"), *[F.count(f"r{k}").alias(f"r{k}") for k in range(4)]).first()
    assert row["rows"] == 2000 * 16
    assert sum(row[f"r{k}"] for k in range(4)) < 0.15 * 4 * row["rows"]


def test_reach_leaves_the_samples_as_they_are(spark):
    rows = [*_texts(30, 400), (100, ""), (101, None), (102, "a"), (103, "a a a b"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(map(str, weighted_sampling.fingerprint_documents(docs, 1e9).collect()))
    # With the small ones many samples are missing or not sure, and are drawn again.
    for reach in (0.05, 1.0, weighted_sampling.REACH):
        assert sorted(map(str, weighted_sampling.fingerprint_documents(docs, reach).collect())) == wanted


def test_samples_beyond_the_reach_are_not_sure(spark):
    docs = spark.createDataFrame(_texts(20, 400), "id long, text string")
    pieces = [(F.col("text"), ("own",))]
    whole = {r["id"]: r["own"] for r in weighted_sampling.signatures(docs, ["id"], pieces).collect()}
    for reach in (1.0, 4.0, 8.0):
        found = weighted_sampling.signatures(docs, ["id"], pieces, reach).collect()
        assert all(r["own"] == whole[r["id"]] for r in found if r["sure"])
        assert reach > 1 or not any(r["sure"] for r in found)
