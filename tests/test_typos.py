"""Edit distance and spelling correction against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from titleloom.functions.edit_distance import edits_up_to_two
from titleloom.operators import typos
from titleloom.operators.typos import MAX_DELETION_LENGTH, correct_typos, corrections


def osa(a, b):
    """Edit distance by rows, swaps of neighbours included."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_up_to_two(spark):
    words = ["".join(p) for n in range(6) for p in itertools.product("abé", repeat=n)]
    rng = random.Random(1)
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(15000)]
    pairs += [("ca", "abc"), ("abcd", "badc"), ("abc", "bca"), ("ab", "ba"), ("", "ab"), ("", "")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.select("a", "b", edits_up_to_two(F.col("a"), F.col("b")).alias("n")).collect():
        expected = osa(row.a, row.b)
        assert row.n == (expected if expected <= 2 else None), row


def edited(rng, word, letters):
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(word) + 1), rng.randrange(4)
        if kind == 0:
            word = word[:at] + rng.choice(letters) + word[at:]
        elif kind == 1:
            word = word[:at] + word[at + 1 :]
        elif kind == 2:
            word = word[:at] + rng.choice(letters) + word[at + 1 :]
        else:
            word = word[:at] + word[at : at + 2][::-1] + word[at + 2 :]
    return word


def best(word, vocabulary):
    near = [(osa(word, v), -f, v) for v, f in vocabulary.items() if abs(len(v) - len(word)) <= 2]
    near = [n for n in near if n[0] <= 2]
    return min(near)[::2] if near else None


def check(spark, vocabulary, words):
    frame = spark.createDataFrame(list(vocabulary.items()), "word string, freq bigint")
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    found = {r.word: (r.distance, r.corrected) for r in corrections(asked, frame).collect()}
    expected = {w: best(w, vocabulary) for w in set(words) - set(vocabulary)}
    assert found == {w: b for w, b in expected.items() if b}


@pytest.mark.parametrize("rows", [0, 10**6])
def test_corrections_equal_brute_force(spark, monkeypatch, rows):
    """With the vocabulary's keys split over a grid of cells, and broadcast."""
    monkeypatch.setattr(typos, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    letters = "abcé"
    vocabulary = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 4) for _ in range(250)}
    words = [edited(rng, rng.choice(list(vocabulary)), letters) for _ in range(500)]
    words += ["".join(rng.choices("abcéxyz", k=rng.randint(1, 3))) for _ in range(100)]
    check(spark, vocabulary, [w for w in words if w])


def test_long_words_are_found_by_segments(spark):
    rng = random.Random(4)
    letters = "abcdef"
    lengths = [MAX_DELETION_LENGTH + d for d in (-3, -1, 0, 1, 2, 5)] + [60, 200]
    vocabulary = {"".join(rng.choices(letters, k=n)): rng.randint(1, 3) for n in lengths for _ in range(6)}
    shared = "x" * 30
    vocabulary |= {shared + "".join(rng.choices(letters, k=15)): 1 for _ in range(10)}
    words = [edited(rng, w, letters) for w in vocabulary for _ in range(12)]
    check(spark, vocabulary, words)


def test_words_of_other_scripts(spark):
    vocabulary = {"工程": 3, "工人": 5, "医生": 1, "x": 2, "yz": 7}
    check(spark, vocabulary, ["工城", "医", "程工", "人", "z", "zy", "qq", "xx"])


def test_dictionary_words_stay(spark):
    vocabulary = spark.createDataFrame([("casa", 3)], "word string, freq bigint")
    dictionary = spark.createDataFrame([("cama",)], "word string")
    texts = spark.createDataFrame([("t", "cama caza casa"), ("u", "")], "title string, text string")
    done = {r.title: r.text for r in correct_typos(texts, vocabulary, dictionary).collect()}
    assert done == {"t": "cama casa casa", "u": ""}


def test_long_titles_are_not_moved_with_each_word(spark, monkeypatch):
    """A title goes through the join of words as a digest of fixed size; titles may repeat or be null."""
    vocabulary = spark.createDataFrame([("engineer", 5), ("software", 3)], "word string, freq bigint")
    long = " ".join(["enginer", "sofware", "other"] * 50)
    rows = [(long, long), ("x", "enginer"), ("x", "enginer"), (None, "enginer"), ("", "")]
    seen = []
    plain = typos.join_hot

    def watching(words, lookup, keys, *rest, **named):
        held = [F.max(F.length(c)) for c in words.columns if c not in ("word", "at")]
        seen.extend(words.agg(*held).first())
        return plain(words, lookup, keys, *rest, **named)

    monkeypatch.setattr(typos, "join_hot", watching)
    done = correct_typos(spark.createDataFrame(rows, "title string, text string"), vocabulary)
    right = " ".join(["engineer", "software", "other"] * 50)
    expected = [(long, right), ("x", "engineer engineer"), ("x", "engineer engineer"), (None, ""), ("", "")]
    assert sorted(map(str, done.collect())) == sorted(f"Row(title={t!r}, text={x!r})" for t, x in expected)
    assert max(seen) <= 32
