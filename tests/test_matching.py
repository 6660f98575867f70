"""Catalogue, cascade and compound titles on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators import catalogue as cat
from titleloom.operators import matching as m
from titleloom.operators import skew
from titleloom.operators.catalogue import ID_COLUMNS
from titleloom.operators import vocabulary as voc
from titleloom.operators.normalize import Steps
from titleloom.sources.catalogue import read_id_mapping, read_main_roles, read_similar_roles

STEPS = Steps(correct_typos=False)


@pytest.fixture(scope="module")
def roles(spark):
    main = spark.createDataFrame(
        [(5, "Advogado"), (2, "Advogada"), (3, "Médico"), (4, "Analista de Banco de Dados"), (0, "zero"), (9, ""), (8, None), (7, "??")],
        "cargo_id int, titulo string",
    )
    similar = spark.createDataFrame([(6, "Lawyer"), (6, "Recepção"), (3, "Enfermeiras Sr")], "cargo_id int, titulo string")
    return read_main_roles(main).unionByName(read_similar_roles(similar))


@pytest.fixture(scope="module")
def mapping(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ids") / "mapping.json"
    path.write_text('{"2": {"areap_ids": [1, 2], "nivelh_ids": [], "perfil_ids": [1]},\n "4": {"areap_ids": [7], "nivelh_ids": [3], "perfil_ids": [2, 6]}}')
    return read_id_mapping(spark, str(path))


@pytest.fixture(scope="module")
def catalogue(lists, roles, mapping):
    return cat.build_catalogue(roles, lists, mapping)


def test_invalid_roles_are_left_out(roles):
    assert {(r.role_id, r.title) for r in roles.collect()} == {
        (5, "Advogado"), (2, "Advogada"), (3, "Médico"), (4, "Analista de Banco de Dados"), (7, "??"),
        (6, "Lawyer"), (6, "Recepção"), (3, "Enfermeiras Sr"),
    }


def test_first_role_wins_and_main_comes_before_similar(catalogue, lists, roles, mapping):
    found = {r.processed_title: (r.role_id, r.title, r.source) for r in catalogue.collect()}
    assert found["advogado"] == (2, "Advogada", "main")
    assert found["recepcionista"] == (6, "Recepção", "similar")
    assert found["analista dado"][0] == 4 and "" not in found
    done = cat.normalize_catalogue(roles, lists, mapping)
    main = cat.dedupe_main(done)
    both = main.unionByName(cat.dedupe_similar(done, main)).filter("processed_title <> ''")
    assert sorted(map(str, both.collect())) == sorted(map(str, catalogue.collect()))


def test_missing_ids_are_empty_lists(catalogue):
    row = catalogue.filter("processed_title = 'recepcionista'").first()
    assert (row.areap_ids, row.nivelh_ids, row.perfil_ids) == ([], [], [])


def brute_ngrams(title):
    words = title.split()[:50]
    spans = [words[i:j] for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i <= 10]
    unique = list(dict.fromkeys(map(tuple, spans)))
    kept = [s for s in unique if len(s) > 1 or s[0] not in fv.SINGLE_WORD_BLOCKLIST]
    return [" ".join(s) for s in sorted(kept, key=len, reverse=True)]


def test_ngrams_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "medico", "design"]
    titles = ["", "a"] + [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(40)]
    titles += [" ".join(f"w{i}" for i in range(70))]
    frame = spark.createDataFrame([(t,) for t in titles], "norm_title string")
    for row in frame.select("norm_title", m.title_ngrams(F.col("norm_title")).alias("n")).collect():
        assert row.n == brute_ngrams(row.norm_title)


def cascade(spark, catalogue, titles, **options):
    frame = spark.createDataFrame([(t,) for t in titles], "norm_title string")
    return {r.norm_title: (r.match_type, r.role.role_id) for r in m.match_cascade(frame, catalogue, **options).collect()}


def test_cascade_prefers_the_whole_title_then_the_longest_sequence(spark, catalogue):
    found = cascade(spark, catalogue, ["advogado", "medico", "vaga medico x", "x analista dado advogado", "advogado recepcionista", "", "none"])
    assert found == {
        "advogado": ("database", 2),
        "medico": ("database", 3),  # blocked only inside longer titles
        "x analista dado advogado": ("ahocorasick", 4),
        "advogado recepcionista": ("ahocorasick", 2),  # leftmost of equal length
    }


def test_a_match_that_fails_the_profile_is_final(spark, catalogue):
    titles = ["advogado", "analista dado", "analista dado advogado"]
    assert cascade(spark, catalogue, titles, profile_ids=[1]) == {"advogado": ("database", 2)}
    assert cascade(spark, catalogue, titles, profile_ids=[6]) == {
        "analista dado": ("database", 4), "analista dado advogado": ("ahocorasick", 4)
    }


def test_ids_are_restricted_to_the_profiles(spark, catalogue):
    profiles = spark.createDataFrame(
        [(1, [2, 9], [], [1]), (6, [7], [3, 4], [6])], "id int, areap_ids array<int>, nivelh_ids array<int>, perfil_ids array<int>"
    )
    frame = spark.createDataFrame([("advogado",), ("analista dado",)], "norm_title string")
    both = m.match_cascade(frame, catalogue, profile_ids=[1, 6], profiles=profiles)
    found = {r.norm_title: (r.role.areap_ids, r.role.nivelh_ids, r.role.perfil_ids) for r in both.collect()}
    assert found == {"advogado": ([2], [], [1]), "analista dado": ([7], [3], [6])}


def test_titles_with_several_roles(spark, catalogue, lists):
    titles = spark.createDataFrame(
        [("Lawyer/Recepção",), ("Recepção, nada; Médico|x ou Advogadas",), ("nada",), (None,), ("Lawyer/Recepção",)], "title string"
    )
    answers = {r.title: r.roles for r in m.normalize_titles(titles, catalogue, lists, STEPS).collect()}
    assert {t: [a.role_id for a in r] for t, r in answers.items()} == {
        "Lawyer/Recepção": [2, 6], "Recepção, nada; Médico|x ou Advogadas": [6, 3, 2]
    }
    first = answers["Lawyer/Recepção"][0]
    assert (first.normalized_role, first.match_type, first.areap_ids) == ("Advogada", "database", [1, 2])
    pieces = m.match_pieces(titles, catalogue, lists, STEPS)
    assert {r.title: r.role_id for r in m.first_match(pieces).collect()} == {
        "Lawyer/Recepção": 2, "Recepção, nada; Médico|x ou Advogadas": 6
    }


def test_a_title_inside_a_sentence_finds_the_same_role(spark, catalogue, lists):
    titles = spark.createDataFrame([("advogado júnior",), ("procuro vaga de advogado júnior em empresa",)], "title string")
    found = m.first_match(m.match_pieces(titles, catalogue, lists, STEPS)).collect()
    assert [r.role_id for r in found] == [2, 2]


def test_seniority_comes_from_the_role(spark, catalogue, lists):
    titles = spark.createDataFrame([("enfermeira sr",)], "title string")
    (answer,) = m.normalize_titles(titles, catalogue, lists, STEPS).first().roles
    assert (answer.normalized_role, answer.seniority) == ("Enfermeiras Sr", ["sr"])


def test_ab_groups(spark):
    rows = spark.range(5).withColumnRenamed("id", "job_id")
    groups = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (2, "b")], "id bigint, ab_test_group string")
    assert {r.job_id for r in m.ab_group_filter(rows, groups, "job_id", "b").collect()} == {1, 2}


def test_vocabulary(spark):
    texts = spark.createDataFrame([("Ab-cd, de a; AB.cd\\tef",), ("cd/ab",)], "text string")
    words = voc.extract_words(texts, "text", {"de"})
    assert {r.word: r.freq for r in words.collect()} == {"ab": 3, "cd": 3, "ef": 1}
    merged = voc.merge_word_freq(words, spark.createDataFrame([("ab", 10)], "word string, freq bigint"))
    assert {r.word: r.freq for r in merged.collect()} == {"ab": 13, "cd": 3, "ef": 1}
    built = {r.word for r in voc.build_dictionary(words, words=["zz"]).collect()}
    assert built == {"ab", "cd", "ef", "zz", *fv.SENIORITIES, *fv.HIERARCHIES}


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_prefixes_find_the_longest_sequence(spark, monkeypatch, broadcast_rows):
    """Word by word through the catalogue's prefixes, broadcast and joined: the first of all sequences in it."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(4)
    words = [*"abcdefgh", fv.SINGLE_WORD_BLOCKLIST[0]]
    known = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)} | {words[-1], "a  b", " c", "b c d e f g h"}
    titles = sorted({" ".join(rng.choices(words + ["x", "y", "z"], k=rng.randint(0, 9))) for _ in range(150)} | {"b c d e f g h"})
    lists_of = {c: "array<string>" for c in ("seniorities", "hierarchies")} | {c: "array<int>" for c in ID_COLUMNS}
    frame = spark.createDataFrame([(t,) for t in sorted(known)], "processed_title string").select(
        "processed_title", F.lit(1).alias("role_id"), F.col("processed_title").alias("title"), F.lit("main").alias("source"),
        *[F.array().cast(t).alias(c) for c, t in lists_of.items()],
    )
    asked = spark.createDataFrame([(t,) for t in titles], "norm_title string")
    for max_words, longest in ((50, 10), (5, 3), (None, 2)):
        expected = {}
        for title in titles:
            parts = title.split()[:max_words]
            for n in range(min(longest, len(parts)), 0, -1):
                hits = [s for i in range(len(parts) - n + 1) if (s := " ".join(parts[i : i + n])) in known and s not in fv.SINGLE_WORD_BLOCKLIST]
                if hits:
                    expected[title] = hits[0]
                    break
        found = m.match_longest_ngram(asked, frame, max_words, longest).collect()
        assert {r.norm_title: r.matched_title for r in found} == expected
        assert all(r.role.title == r.matched_title for r in found)
        cascade = {r.norm_title: (r.match_type, r.role.title) for r in m.match_cascade(asked, frame, max_words=max_words, longest=longest).collect()}
        assert cascade == {t: (fv.MATCH_EXACT, t) if t in known and t else (fv.MATCH_NGRAM, expected[t]) for t in {*expected, *(known & set(titles))} if t}
    assert m.match_longest_ngram(asked, frame.limit(0)).count() == 0
    assert m.match_cascade(asked.limit(0), frame).count() == 0


def test_starts_behind_a_longest_title_are_not_shuffled(spark, monkeypatch):
    """With a large catalogue a text goes on behind its first words only if a longer title may still come."""
    rng = random.Random(7)
    known = ["a b c", "d e", "f", "c a"]
    texts = ["a b c " + " ".join(rng.choices("abcdefgh", k=60)) for _ in range(40)]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "norm_title string")
    roles = spark.createDataFrame(
        [(t, i, t, "main", [], [], [], [], []) for i, t in enumerate(known)],
        "processed_title string, role_id int, title string, source string, seniorities array<string>, "
        "hierarchies array<string>, " + ", ".join(f"{c} array<int>" for c in ID_COLUMNS),
    )
    looked_at = []
    plain = m.join_lookup

    def counting(rows, lookup, keys, *rest, **named):
        if keys == ["prefix"]:
            looked_at.append(rows.filter("prefix IS NOT NULL").count())
        return plain(rows, lookup, keys, *rest, **named)

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(m, "join_lookup", counting)
    found = {r.norm_title: r.matched_title for r in m.match_longest_ngram(frame, roles, max_words=None).collect()}

    def expected(text):
        words = text.split()
        for n in (3, 2, 1):
            for at in range(len(words) - n + 1):
                if " ".join(words[at : at + n]) in known:
                    return " ".join(words[at : at + n])

    assert found == {t: expected(t) for t in texts if expected(t)}
    # The first step looks at no position of the 40 long texts but their first ones.
    short = sum(len(t.split()) for t in set(texts[40:]))
    assert sum(looked_at[::3]) <= 40 * m.FIRST_STARTS + short
