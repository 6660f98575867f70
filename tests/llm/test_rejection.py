"""Rejection by the nearest-centroid classifier: each language in turn is unknown to the model."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from titleloom.llm import langid
from titleloom.llm.common import read_documents

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_unknown_language_is_rejected_and_known_ones_stay(spark, left_out):
    docs = read_documents(spark, MEDIUM)
    model = langid.fit(docs.filter((F.col("lang") != left_out) & ~langid.held_out(F.col("doc_id"))))
    probes = docs.filter((F.col("lang") == left_out) | langid.held_out(F.col("doc_id")))
    shares = {
        r["foreign"]: r["share"]
        for r in langid.predict(probes, model)
        .groupBy((F.col("lang") == left_out).alias("foreign"))
        .agg(F.avg(F.col("rejected").cast("int")).alias("share"))
        .collect()
    }
    print(left_out, shares)
    assert shares[True] > 0.95
    assert shares[False] < 0.01
