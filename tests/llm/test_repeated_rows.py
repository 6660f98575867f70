"""Rows that repeat a doc_id, with the same text or with another one."""

from __future__ import annotations

from collections import Counter

import duckdb

from titleloom.llm import pipeline as corpus_pipeline
from titleloom.llm import block_names
from titleloom.llm.queries import operators as Q


def test_block_names_count_repeated_rows_as_the_sql(spark, tmp_path):
    rows = [(1, "Same"), (1, "same"), (1, "same"), (2, "same"), (2, "other"), (3, None), (3, ""), (4, "x" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in block_names.exact_duplicates(docs, 64).collect())
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert found == Counter(base.execute(Q.ORACLES["op4_block_naming"]).fetchall())
    assert sum(found.values()) == len(rows)


def test_pipeline_keeps_one_row_of_each_component(spark):
    """doc_id 1 stands for the first component; its other row is a copy of document 0."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (2, a), (1, b), (0, b), (None, a), (None, "alone"), (5, "five"), (5, "five")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (0, b), (None, "alone"), (5, "five")])
