"""Embedding match against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators import embedding as emb
from titleloom.operators import skew

WORDS = ["chef", "cook", "nurse", "lead", "trainee", "x", "y", "z"]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(11)
    table = {w: ([rng.gauss(0, 1) for _ in range(3)], rng.choice([0.5, 1.0, 2.5])) for w in WORDS}
    table["zero"] = ([1.0, 1.0, 1.0], 0.0)
    table["near"] = ([v + 0.05 for v in table["chef"][0]], 1.0)
    return table


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(w, v, i) for w, (v, i) in vectors.items()] + [("noidf", [1.0, 0.0, 0.0], None), ("novec", None, 1.0)]
    return spark.createDataFrame(rows, "word string, vec array<double>, idf double")


def whole(title, vectors):
    words = title.split()
    if not words or any(w not in vectors for w in words):
        return None
    weight = sum(vectors[w][1] for w in set(words))
    if not weight:
        return None
    return [sum(vectors[w][0][d] * vectors[w][1] for w in words) / weight for d in range(3)]


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 9)


def matched(title, roles, vectors):
    words = title.split()
    if not words or any(whole(w, vectors) is None for w in words):
        return None
    starts = bool(set(words) & set(fv.STARTING_ROLE_WORDS))
    targets = {r: whole(r, vectors) for r in roles if whole(r, vectors)}
    best, best_similarity, best_words = None, 0, 0
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            part = words[i:j]
            vector = [sum(vectors[w][0][d] for w in part) / sum(vectors[w][1] for w in part) for d in range(3)]
            ranked = sorted(((-cosine(vector, v), r) for r, v in targets.items()))[:5]
            for negative, role in ranked:
                if set(role.split()) & set(fv.STARTING_ROLE_WORDS) and not starts:
                    continue
                similarity = -negative
                if similarity <= fv.MIN_SIMILARITY:
                    continue
                if similarity - best_similarity > 0.01 or (
                    abs(similarity - best_similarity) <= 0.01 and j - i > best_words
                ):
                    best, best_similarity, best_words = role, similarity, j - i
    return best


def titles(n, seed):
    rng = random.Random(seed)
    pool = WORDS + ["near", "zero", "noidf", "novec", "unknown"]
    weights = [8] * len(WORDS) + [6, 1, 1, 1, 1]
    return sorted({" ".join(rng.choices(pool, weights, k=rng.randint(1, 4))) for _ in range(n)} | {""})


def test_title_embedding(spark, vectors, table):
    asked = titles(80, 1)
    frame = spark.createDataFrame([(t,) for t in asked], "title string")
    found = {r.title: r.embedding for r in emb.title_embedding(frame, table).collect()}
    expected = {t: whole(t, vectors) for t in asked}
    assert set(found) == {t for t, v in expected.items() if v}
    for title, vector in found.items():
        assert vector == pytest.approx(expected[title])


@pytest.mark.parametrize("block", [8192, 7])
def test_match_equals_brute_force(spark, vectors, table, monkeypatch, block):
    monkeypatch.setattr(emb, "BLOCK_ROWS", block)
    monkeypatch.setattr(emb, "_CHUNK_ROWS", 3)
    asked, roles = titles(60, 2), [t for t in titles(40, 3) if t]
    frame = spark.createDataFrame([(t,) for t in asked], "norm_title string")
    catalogue = spark.createDataFrame([(r,) for r in roles], "processed_title string")
    found = {r.norm_title: r.matched_title for r in emb.match_embedding(frame, catalogue, table).collect()}
    expected = {t: matched(t, roles, vectors) for t in asked}
    assert found == {t: r for t, r in expected.items() if r}
    assert len(found) > 10


def test_nearest_titles_keep_ties_in_name_order(spark):
    texts = spark.createDataFrame([("q", [1.0, 0.0])], "text string, embedding array<double>")
    same = [(f"t{i}", [2.0, 0.0]) for i in (3, 1, 2, 7, 5, 6, 4)] + [("a", [1.0, 1.0])]
    frame = spark.createDataFrame(same, "matched_title string, embedding array<double>")
    found = emb.nearest_titles(texts, frame, k=5).orderBy("rank").collect()
    assert [(r.rank, r.matched_title) for r in found] == [(i, f"t{i}") for i in range(1, 6)]


def test_the_fold_is_no_maximum(spark):
    rows = [("t", 0, 1, 1, 0.95, "first"), ("t", 0, 2, 1, 0.945, "longer"), ("t", 1, 2, 1, 0.954, "best"), ("u", 0, 1, 1, 0.9, "low")]
    frame = spark.createDataFrame(rows, "norm_title string, start int, end int, rank int, similarity double, matched_title string")
    assert [tuple(r) for r in emb.best_similarity_fold(frame).collect()] == [("t", "longer", 0.945)]


def clustered(count, centers, spread, seed, dimensions=16):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(centers, dimensions))
    rows = middles[draw.integers(0, centers, count)] + spread * draw.normal(size=(count, dimensions))
    rows[:: count // 3 + 1] = 0
    rows[1 : count // 3 : 2] = rows[1]
    return rows


@pytest.mark.parametrize("k, above, spread", [(5, None, 0.1), (5, 0.9, 0.1), (300, None, 0.3), (2, None, 2.0)])
def test_nearest_titles_equal_all_with_all(spark, monkeypatch, k, above, spread):
    monkeypatch.setattr(emb, "BLOCK_ROWS", 40)
    vectors, asked = clustered(900, 12, spread, 1), clustered(160, 14, spread, 1)
    titles = spark.createDataFrame([(f"t{i:03}", v.tolist()) for i, v in enumerate(vectors)], "matched_title string, embedding array<double>")
    texts = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "text string, embedding array<double>")

    def unit(rows):
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(lengths == 0, 1, lengths)

    similarity = np.round(unit(asked) @ unit(vectors).T, emb.DIGITS)
    expected = set()
    for i, row in enumerate(similarity):
        order = sorted((j for j in range(len(row)) if above is None or row[j] > above), key=lambda j: (-row[j], j))[:k]
        expected |= {(f"q{i}", f"t{j:03}", n) for n, j in enumerate(order, 1)}
    found = emb.nearest_titles(texts, titles, k, above).collect()
    assert {(r["text"], r["matched_title"], r["rank"]) for r in found} == expected


def test_most_blocks_of_clustered_titles_are_not_compared(spark):
    vectors, asked = clustered(4000, 40, 0.1, 2), clustered(300, 40, 0.1, 2)[2:]
    titles = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(vectors)], "matched_title string, embedding array<double>")
    texts = spark.createDataFrame([(f"q{i}", v.tolist(), 0.9) for i, v in enumerate(asked) if v.any()], "text string, embedding array<double>, least double")
    index = emb.title_blocks(titles, 100)
    assert index.count.max() <= 250
    pairs = emb.block_pairs(texts, index, 5, False, "least").count()
    share = pairs / (texts.count() * len(index.pivot))
    print("share of block pairs", share)
    assert share < 1 / 3


def test_sequences_by_running_sums(spark, vectors, table):
    asked = titles(60, 5)
    frame = spark.createDataFrame([(t,) for t in asked], "norm_title string")
    found = {(r.norm_title, r.start, r.end): r for r in emb.ngram_embedding(frame, table).collect()}
    expected = {}
    for title in asked:
        words = title.split()
        if not words or any(whole(w, vectors) is None for w in words):
            continue
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                weight = sum(vectors[w][1] for w in words[i:j])
                expected[title, i, j] = [sum(vectors[w][0][d] for w in words[i:j]) / weight for d in range(3)]
    assert set(found) == set(expected)
    for key, vector in expected.items():
        assert found[key].embedding == pytest.approx(vector)
        assert found[key].ngram == " ".join(key[0].split()[key[1] : key[2]])


def test_long_titles_and_large_word_tables_are_not_repeated(spark, vectors, table, monkeypatch):
    """Words go under a digest of their title, and a word table too large to broadcast is not copied per salt."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    held, plain = [], emb.join_hot

    def watching(rows, lookup, keys, *rest, **named):
        held.extend(rows.agg(*[F.max(F.length(c)) for c in rows.columns if c not in ("word", "at")]).first())
        return plain(rows, lookup, keys, *rest, **named)

    def salted(*_, **__):
        raise AssertionError("the lookup is repeated")

    monkeypatch.setattr(emb, "join_hot", watching)
    monkeypatch.setattr(skew, "join_salted", salted)
    asked = [" ".join(["chef", "lead", "nurse"] * 30), "chef", "chef unknown", "noidf", "", None]
    frame = spark.createDataFrame([(t,) for t in asked], "title string")
    found = {r.title: r.embedding for r in emb.title_embedding(frame, table).collect()}
    assert set(found) == {asked[0], "chef"}
    assert all(found[t] == pytest.approx(whole(t, vectors)) for t in found)
    assert held and max(held) <= 32


def test_only_words_in_use_are_looked_up(spark, vectors, table):
    """Vectors of words that no text has are not written, so a few titles never meet a large table."""
    more = spark.range(500).selectExpr("concat('other', id) AS word", "array(1.0D, 0.0D, 0.0D) AS vec", "1.0D AS idf")
    texts = spark.createDataFrame([("chef lead",), ("noidf x",), (None,)], "text string")
    words = emb.known_words(table.unionByName(more), texts, "text")
    assert sorted(r.word for r in words.table.collect()) == ["chef", "lead", "x"]


def test_pairs_of_texts_and_blocks_are_handed_over_in_bounded_batches():
    blocks = 50
    index = emb.TitleBlocks(
        None, np.eye(3), np.arange(blocks) % 3, np.zeros(blocks), np.full(blocks, math.pi), np.full(blocks, 10)
    )
    rows = pd.DataFrame({"text": [str(i) for i in range(3000)], "embedding": [[1.0, 0.0, 0.5]] * 3000, "least": [-1.0] * 3000})

    class Texts:
        schema = ()

        def mapInPandas(self, pairs, kinds):
            return [*pairs([rows])]

    batches = emb.block_pairs(Texts(), index, 5, False, "least")
    assert max(map(len, batches)) <= 8192
    pairs = {(t, b) for batch in batches for t, b in zip(batch["text"], batch["title_block"])}
    assert sum(map(len, batches)) == len(pairs) == 3000 * blocks
