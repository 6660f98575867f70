"""Fill-in-middle against a plain version by regular expressions, and the compressed set against lists."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleloom.llm import fill_middle
from titleloom.llm.queries import operators as Q

SMALL = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text, percent=50):
    text = text or ""
    tokens = TOKEN.findall(text)
    n, digest = len(tokens), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


ROWS = [
    (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "a <P> mark"), (6, "é\U0001f600 　 wide one  "), (None, "no id"),
    (7, "twice"), (7, "twice"), (8, "a b " * 60000), (9, "x" * 70000 + " y" * 70000), (10, " " * 65536), (11, "w" * 65535 + " "),
    (12, "w" * 65536), (13, " " * 65535 + "w"), *[(i, f"word{i}  " * (i % 37) + "<P") for i in range(14, 120)],
]


def test_against_the_plain_version(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, n int, form string")
    for percent in (50, 100):
        cut = fill_middle.fill_in_middle(docs, percent=percent)
        found = cut.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        expected = [(i, *plain_version(i, t, percent), t or "") for i, t in ROWS]
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert {r[1] for r in (plain_version(i, t, 100) for i, t in ROWS)} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_query_against_the_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in Q.op12_fill_in_middle(spark, SMALL).collect():
        n, form, a, b, output = plain_version(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, a, b)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_characters_as_units(spark):
    docs = spark.createDataFrame([(i, "\U0001f600ab c" * 9000) for i in range(8)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(docs, percent=100, unit="character").collect():
        assert r["n"] == 45000 and len(r["output"]) == 45009


@pytest.mark.parametrize(
    "low, kind",
    [
        (np.arange(0, 60000, 7), fill_middle.BitmapContainer),
        (np.arange(0, 60000, 17), fill_middle.ArrayContainer),
        (np.r_[0:9000, 9001:40000, 65535], fill_middle.RunContainer),
        (np.array([5]), fill_middle.ArrayContainer),
        (np.arange(65536), fill_middle.RunContainer),
        (np.flatnonzero(np.random.default_rng(1).random(65536) < 0.6), fill_middle.BitmapContainer),
    ],
)
def test_containers_select(low, kind):
    held = fill_middle.container(low)
    assert type(held) is kind
    ranks = [*range(0, len(low), 97), len(low) - 1]
    assert [held.select(r) for r in ranks] == low[ranks].tolist()


def test_set_selects_across_containers():
    parts = [(0, np.array([0, 9])), (65536, np.arange(0)), (131072, np.arange(50000)), (196608, np.arange(1, 60000, 3))]
    held = fill_middle.BoundarySet(iter(parts))
    flat = np.concatenate([base + low for base, low in parts])
    ranks = [0, 1, 2, 3, 50000, 50001, 50002, 50003, len(flat) - 1]
    assert held.count == len(flat)
    assert [held.select(r) for r in ranks] == flat[ranks].tolist()
