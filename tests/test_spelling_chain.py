"""The default chain with spelling correction: gazetteer words are right as they are."""

from __future__ import annotations

import dataclasses

import pytest

from titleloom.operators.catalogue import build_catalogue
from titleloom.operators.matching import normalize_titles, restrict_ids_to_profile
from titleloom.operators.normalize import normalize_title
from titleloom.session import shared_folder
from titleloom.sources.gazetteers import MAX_INLINE_VERBS

TITLES = [("Gerente de vendas",), ("Gerente sr de vendas",), ("Gerente de vemdas",)]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([("vendas", 9), ("gerente", 5), ("ti", 7), ("obra", 3)], "word string, freq long")


def test_stopwords_and_seniorities_are_not_corrected(spark, lists, vocabulary):
    roles = spark.createDataFrame([(1, "Gerente de vendas", "main")], "role_id int, title string, source string")
    catalogue = build_catalogue(roles, lists)
    found = normalize_titles(spark.createDataFrame(TITLES, "title string"), catalogue, lists, vocabulary=vocabulary)
    # The seniority stays in the text, so the second title is no title of the catalogue.
    roles_of = {r["title"]: [x["role_id"] for x in r["roles"]] for r in found.collect()}
    assert roles_of == {"Gerente de vendas": [1], "Gerente de vemdas": [1]}
    done = normalize_title(spark.createDataFrame(TITLES, "title string"), lists, vocabulary=vocabulary).collect()
    assert {r["title"]: r["seniorities"] for r in done}["Gerente sr de vendas"] == ["sr"]


def test_long_verb_lists_run_through_the_catalogue(spark, lists):
    verbs = {f"verbei{i}": f"verbo{i}" for i in range(MAX_INLINE_VERBS + 500)}
    many = dataclasses.replace(lists, conjugation=verbs)
    roles = spark.createDataFrame([(1, "verbei7 obra", "main")], "role_id int, title string, source string")
    assert [r["processed_title"] for r in build_catalogue(roles, many).collect()] == ["verbo7 obra"]


def test_all_rows_of_a_profile_count(spark):
    role = "role struct<areap_ids:array<int>,nivelh_ids:array<int>,perfil_ids:array<int>>"
    matches = spark.createDataFrame([(([1, 2, 3], [1], [1]),)], role)
    profiles = spark.createDataFrame(
        [(1, [1], [1], [1]), (1, [2], None, [1])], "id int, areap_ids array<int>, nivelh_ids array<int>, perfil_ids array<int>"
    )
    kept = restrict_ids_to_profile(matches, profiles, [1]).first()["role"]
    assert (kept["areap_ids"], kept["nivelh_ids"]) == ([1, 2], [1])


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
