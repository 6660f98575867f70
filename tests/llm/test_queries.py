"""Every corpus query against its SQL on the smallest data folder, or a named test against brute force."""

from __future__ import annotations

import duckdb
import pytest

import check
from titleloom.llm.queries import llm_oracles, llm_queries

FOLDER = "/root/testdata/sf0.001"
# Queries that SQL cannot express, and the test that holds them against another way.
HELD_AGAINST = {
    "op1_secret_scan": "test_operators.py::test_secret_base_spans",
    "op2_weighted_sampling": "test_operators.py::test_weighted_sampling_estimates_generalised_jaccard",
    "op3_rendezvous": "test_operators.py::test_shards_against_all_scores",
    "op5_bwt_merge": "test_operators.py::test_bytes_against_brute_force",
    "op6_shortest_pack_first": "test_operators.py::test_packing_holds_every_id_once",
    "op7_nearest_centroid": "test_operators.py::test_language_of_held_out_rows",
    "op8_covering_simhash": "test_queries.py::test_covering_query_against_all_pairs",
    "op10_entropy_balancing": "test_operators.py::test_mixture_meets_its_targets",
    "op11_byte_bpe": "test_byte_bpe.py::test_query_against_the_library",
    "op13_conversation_repair": "test_conversations.py::test_query_against_the_plain_version",
    "pipeline": "test_pipeline.py::test_stages",
}


def test_every_query_is_held_against_something():
    assert set(llm_oracles()) | set(HELD_AGAINST) == set(llm_queries())


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = llm_queries()[name](spark, FOLDER)
    found = check._sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(llm_oracles()[name])
    assert found == check._sorted_rows([d[0] for d in result.description], result.fetchall())


def test_covering_query_against_all_pairs(spark):
    """Fingerprints by whole numbers, components over all pairs."""
    import xxhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {}
    for i, text in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    found = llm_queries()["op8_covering_simhash"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {
        (i, f"{p:016x}", root[i]) for i, p in prints.items()
    }
