"""The corpus pipeline, stage by stage."""

from __future__ import annotations

from collections import Counter

import pytest

from titleloom.llm import covering
from titleloom.llm import pipeline as corpus_pipeline
from titleloom.llm.common import read_documents, staged

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_documents(spark, SMALL)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SMALL), f"test-{name}")
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
        kept[name] = after
        docs = after
    # All documents of this table are in a known language.
    assert kept["language"].count() == 200
    lines = {r["doc_id"]: r["text"] for r in kept["lines"].collect()}
    prints = {i: covering.simhash(t, corpus_pipeline.SHINGLE) for i, t in lines.items()}
    root = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.RADIUS and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {i for i in root if root[i] == i}
    copies = Counter(r["doc_id"] for r in kept["mixture"].collect())
    assert max(copies.values()) <= 2
    sequences = Counter()
    for r in kept["packing"].collect():
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= 2048


EDGE = [
    (1, "One two three four five.\nSix seven.", "en", "a", 9), (2, "one two three four five.\nsix seven.", "en", None, 9),
    (3, None, None, "a", None), (4, "", "en", "b", 0), (5, " \n\n", None, None, 1), (6, "other words stand here", "en", "a", 1),
    (6, "other words stand here", "en", "a", 1), (6, "not the same text at all, with the same id", "en", "a", 1),
    (None, "a text that has no id", "en", "b", 3), (7, "very long " * 40000, "en", "b", 400000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, 1.5, 2, "x", 3) for r in EDGE]
    return spark.createDataFrame(rows, SCHEMA + ", rate double, copies int, root string, size int")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_rows_and_empty_tables(spark, edge, name, stage):
    after = stage(spark, edge, SMALL)
    ids = {r["doc_id"] for r in after.collect()}
    if name != "packing":
        assert after.columns == corpus_pipeline.COLUMNS
    if name in ("lines", "packing"):
        assert ids == {r[0] for r in EDGE}
    if name == "near_duplicates":
        # 1 and 2 are equal but for case; 3, 4 and 5 have no words; 6 has two texts.
        assert sorted((r["doc_id"] or 0) for r in after.collect()) == [0, 1, 3, 6, 6, 7]
    assert stage(spark, edge.limit(0), SMALL).collect() == []


def test_without_labels_no_language_is_unknown(spark, edge):
    bare = edge.withColumn("lang", edge["lang"].substr(9, 1)).selectExpr("*", "cast(null as string) as none")
    bare = bare.drop("lang").withColumnRenamed("none", "lang")
    assert corpus_pipeline.keep_identified(spark, bare, SMALL).count() == len(EDGE)
