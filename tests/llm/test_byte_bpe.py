"""Byte-level BPE against the tiktoken library, and round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from titleloom.llm import byte_bpe
from titleloom.llm.queries import operators as Q

SMALL = "/root/testdata/sf0.001"
PATH = Q.rank_path()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={}
    )


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(PATH, public_tokenizers.PATTERN)


def numbers(data):
    return np.frombuffer(data, "<i4").tolist()


@pytest.mark.parametrize("window, together", [(4, 3), (7, 50), (byte_bpe.WINDOW, byte_bpe.TOGETHER)])
def test_ids_in_any_window(coder, library, monkeypatch, window, together):
    monkeypatch.setattr(byte_bpe, "WINDOW", window)
    monkeypatch.setattr(byte_bpe, "TOGETHER", together)
    coder.kept.clear()
    draw = random.Random(window)
    parts = [" ", "a", "t", "the", "'", "'ll", "'s", "1", "é", "\U0001f600", "\n", "  ", "!", "ab", "\x1f", "<|endoftext|>"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(1500)]
    assert [numbers(x) for x in coder.encode(texts)] == library.encode_ordinary_batch(texts)


def test_long_pre_tokens(coder, library):
    draw = random.Random(5)
    texts = ["a" * 70001, "ab" * 20000 + "a" * 9999, "!?" * 5000, "\n" * 3001, " " * 4000 + "x"]
    texts += ["".join(draw.choices(letters, k=20000)) for letters in ("abc", "etaoinshr", "aé", "abcdefghijklmnopqrstuvwxyzäß")]
    texts += ["".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 60))) for _ in range(3000)]
    assert [numbers(x) for x in coder.encode(texts)] == library.encode_ordinary_batch(texts)


def test_ranks_that_come_back(tmp_path):
    """'abc' ranks below 'ab': joining 'ab' makes a lower pair, which goes before the next 'ab'."""
    import base64

    words = [bytes([i]) for i in range(256)] + [b"abc", b"aba", b"ab", b"abab", b"bca", b"aa", b"aaa", b"ca", b"caa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    ranks = byte_bpe.read_ranks(path)
    coder = byte_bpe.ByteBpe(str(path), r"\w+|\W+")
    assert coder.reviving[ranks[b"ab"]]

    def naive(text):
        parts = [bytes([b]) for b in text.encode()]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, at = min(found)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    draw = random.Random(2)
    texts = ["".join(draw.choices("abc", k=draw.randint(1, 30))) for _ in range(2000)]
    assert [numbers(x) for x in coder.encode(texts)] == [[ranks[t.encode()]] if t.encode() in ranks else naive(t) for t in texts]


def test_queue_gives_ranks_in_order():
    draw = np.random.default_rng(3)
    queue = byte_bpe.RankQueue(50256)
    ranks, places = draw.integers(0, 50256, 5000), np.arange(5000)
    queue.push(ranks, places)
    seen = []
    while (entry := queue.pop()) is not None:
        seen += [(entry[0], p) for part in entry[1] for p in part.tolist()]
    assert seen == sorted(zip(ranks.tolist(), places.tolist(), strict=True))
    assert not any(map(any, queue.levels)) and not queue.buckets


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = Q.op11_byte_bpe(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, 3, "x"), (2, "", 3, "x"), (2, "", 3, "x"), (None, "a b", 3, "x"), (3, "word " * 300000, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    coded = byte_bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN)
    back = byte_bpe.decode_ids(coded, PATH).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in back) == sorted(
        (i or 0, t or "") for i, t, _, _ in rows
    )
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).collect() == []
    unknown = spark.createDataFrame([(1, [5, 60000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="rank file|out of bounds"):
        byte_bpe.decode_ids(unknown, PATH).collect()
    absent = spark.createDataFrame([(1, None), (2, [72])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode_ids(absent, PATH).collect()} == {1: b"", 2: b"i"}
