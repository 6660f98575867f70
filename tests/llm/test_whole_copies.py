"""The mixture stage of the pipeline gives whole documents."""

from __future__ import annotations

from collections import Counter

from titleloom.llm import pipeline as corpus_pipeline
from titleloom.llm import mixing
from titleloom.llm.common import read_documents
from titleloom.llm.queries.operators import word_count

SMALL = "/root/testdata/sf0.001"


def test_no_document_is_cut(spark):
    docs = read_documents(spark, SMALL)
    texts = {r["doc_id"]: r for r in docs.collect()}
    words, most = Counter(), Counter()
    for r in corpus_pipeline.mix_to_targets(spark, docs, SMALL).collect():
        assert r["text"] == texts[r["doc_id"]]["text"]
        words[r["source"]] += len(r["text"].encode().split())
    for r in texts.values():
        most[r["source"]] = max(most[r["source"]], len(r["text"].encode().split()))
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(docs, word_count()).collect()}
    cut = [r for r in mixing.mix_sources(docs, word_count()).collect() if r["part"] > 0]
    assert cut
    for source, target in targets.items():
        assert abs(words[source] - target) <= most[source] / 2 + 1
