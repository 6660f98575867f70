"""Text steps over whole documents, and the whole chain over titles and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions import text as T
from titleloom.functions.phrase_rules import apply_phrase_rules
from titleloom.operators.normalize import Steps, normalize_title
from titleloom.operators.typos import correct_typos
from titleloom.operators.vocabulary import extract_words, word_breaks
from titleloom.queries import sql
from titleloom.queries.standins import gazetteer, table, view, with_views
from titleloom.sources.gazetteers import Gazetteer


def _on_documents(step: Callable[[Column, Gazetteer], Column]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = table(spark, sf_dir, "documents")
        return documents.select("doc_id", step(F.col("text"), gazetteer(spark)).alias("text"))

    return query


def _listed(words: Column) -> Column:
    return F.array_join(words, ",")


def _sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


def _words_sql(kept) -> str:
    found = f"coalesce(array_to_string({sql.only('lower(title)', kept)}, ','), '')"
    return with_views(["staff_titles"], f"SELECT id, {found} AS words FROM staff_titles")


def title_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part titles, order titles and whole conversation turns, each with an id."""
    turns = table(spark, sf_dir, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.col("text").alias("title")
    )
    parts = view(spark, sf_dir, "part_titles").unionByName(view(spark, sf_dir, "staff_titles"))
    return parts.unionByName(turns)


TITLE_ROWS = (
    "(SELECT * FROM part_titles UNION ALL SELECT * FROM staff_titles UNION ALL SELECT -1 - conv_id * 1000 - turn AS id, text AS title FROM conversations)"
)


def normalize_title_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalize_title(title_rows(spark, sf_dir), gazetteer(spark), Steps(correct_typos=False))
    return done.select(
        "id", "norm_title", _listed(F.col("seniorities")).alias("seniorities"),
        _listed(F.col("hierarchies")).alias("hierarchies"),
    )


def normalize_title_with_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with locations on and the rule steps off."""
    steps = Steps(
        correct_typos=False, remove_locations=True, conjugation=False, gender=False, thesaurus=False, special_terms=False
    )
    return normalize_title(title_rows(spark, sf_dir), gazetteer(spark), steps).select("id", "norm_title")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark").select(T.strip_line_breaks(F.col("text")).alias("text"))
    return extract_words(benchmark, "text", gazetteer(spark).stopwords)


def correct_typos_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all conversations, corrected to the words of the benchmark texts."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("title"),
        T.drop_symbols(T.symbols_to_space(T.strip_line_breaks(T.lowercase(F.col("text"))))).alias("text"),
    )
    return correct_typos(turns, vocabulary(spark, sf_dir)).select(F.col("title").alias("turn_id"), "text")


_ONE_BYTE = "translate({}.word, 'éèêçóñüäößíáúàâîôûëïãõìò', 'ABCDEFGHIJKLMNOPQRSTUVWX')"

# CTE ``best``: the correction of each word of ``unknown`` by a table ``word, freq``.
NEAREST = """-- The distance function counts bytes: letters of two bytes stand as unused letters of one.
near AS (
  SELECT * FROM (
    SELECT u.word, v.word AS corrected, v.freq, damerau_levenshtein(__U__, __V__)
      AS free_distance
    FROM unknown u JOIN {known} v ON abs(length(u.word) - length(v.word)) <= 2)
  WHERE free_distance <= 2),
-- A swap counts as one edit only where nothing else happens inside the swapped pair: three edits otherwise.
cut AS (
  SELECT *, list_max(list_concat([0], list_filter(range(1, least(length(word), length(corrected)) + 1),
      lambda n: word[1:n] = corrected[1:n]))) AS p FROM near),
cut2 AS (
  SELECT *, substr(word, p + 1) AS a0, substr(corrected, p + 1) AS b0 FROM cut),
cut3 AS (
  SELECT *, list_max(list_concat([0], list_filter(range(1, least(length(a0), length(b0)) + 1),
      lambda n: right(a0, n) = right(b0, n)))) AS q FROM cut2),
cut4 AS (
  SELECT *, left(a0, length(a0) - q) AS a, left(b0, length(b0) - q) AS b FROM cut3),
best AS (
  SELECT word, arg_min(corrected, (free_distance, -freq, corrected)) AS corrected FROM cut4
  WHERE NOT (free_distance = 2 AND length(a) = 2 AND length(b) = 3 AND a[1] = b[3] AND a[2] = b[1]
      AND b[2] NOT IN (a[1], a[2]))
    AND NOT (free_distance = 2 AND length(a) = 3 AND length(b) = 2 AND a[1] = b[2] AND a[3] = b[1]
      AND a[2] NOT IN (b[1], b[2]))
  GROUP BY word)"""


def nearest_ctes(known: str) -> str:
    text = NEAREST.replace("__U__", _ONE_BYTE.format("u")).replace("__V__", _ONE_BYTE.format("v"))
    return text.replace("{known}", known)


_TYPO_SQL = f"""
WITH vocabulary AS (
  SELECT word, count(*) AS freq FROM (
    SELECT unnest(list_transform(regexp_split_to_array({sql.line_breaks('text')}, '__BREAKS__'),
      lambda w: lower({sql.strip('w')}))) AS word FROM benchmark)
  WHERE length(word) >= 2 AND NOT list_contains({sql.listed(sql.stopwords())}, word) GROUP BY word),
turns AS (
  SELECT conv_id || '-' || turn AS turn_id,
    {sql.words(sql.drop_symbols(sql.symbols_to_space(sql.line_breaks('lower(text)'))))} AS words FROM conversations),
placed AS (
  SELECT turn_id, words[pos] AS word, pos FROM (
    SELECT turn_id, words, unnest(range(1, len(words) + 1)) AS pos FROM turns)),
unknown AS (SELECT DISTINCT word FROM placed ANTI JOIN vocabulary USING (word)),
__NEAREST__
SELECT turns.turn_id, coalesce(string_agg(coalesce(corrected, placed.word), ' ' ORDER BY pos), '') AS text
FROM turns LEFT JOIN placed USING (turn_id) LEFT JOIN best ON placed.word = best.word GROUP BY turns.turn_id
"""


QUERIES = {
    "lowercase": _on_documents(lambda c, g: T.lowercase(c)),
    "strip_line_breaks": _on_documents(lambda c, g: T.strip_line_breaks(c)),
    "rewrite_special_terms": _on_documents(lambda c, g: apply_phrase_rules(T.lowercase(c), g.special_terms)),
    "symbols_to_space": _on_documents(lambda c, g: T.symbols_to_space(c)),
    "drop_symbols": _on_documents(lambda c, g: T.drop_symbols(c)),
    "correct_typos": correct_typos_query,
    "remove_stopwords": _on_documents(lambda c, g: T.remove_stopwords(T.lowercase(c), g.stopwords)),
    "strip_accents": _on_documents(lambda c, g: T.strip_accents(c)),
    "extract_seniority": lambda spark, sf_dir: view(spark, sf_dir, "staff_titles").select(
        "id", _listed(T.extract_seniority(T.lowercase(F.col("title")))).alias("words")
    ),
    "extract_hierarchy": lambda spark, sf_dir: view(spark, sf_dir, "staff_titles").select(
        "id", _listed(T.extract_hierarchy(T.lowercase(F.col("title")))).alias("words")
    ),
    "remove_locations": _on_documents(lambda c, g: T.remove_locations(T.lowercase(c), g.locations)),
    "normalize_conjugation": _on_documents(lambda c, g: T.normalize_conjugation(T.lowercase(c), g.conjugation)),
    "normalize_plural": _on_documents(lambda c, g: T.normalize_plural(T.lowercase(c), g.plural)),
    "normalize_gender": _on_documents(lambda c, g: apply_phrase_rules(T.lowercase(c), g.gender)),
    "normalize_thesaurus": _on_documents(lambda c, g: apply_phrase_rules(T.lowercase(c), g.thesaurus)),
    "normalize_title": normalize_title_query,
    "normalize_title_with_locations": normalize_title_with_locations,
}

ORACLES = {
    "lowercase": _sql("lower(text)"),
    "strip_line_breaks": _sql(sql.line_breaks("text")),
    "rewrite_special_terms": _sql(sql.phrase_rules("lower(text)", "mapping_special_character_terms")),
    "symbols_to_space": _sql(sql.symbols_to_space("text")),
    "drop_symbols": _sql(sql.drop_symbols("text")),
    "correct_typos": _TYPO_SQL.replace("__BREAKS__", word_breaks().replace("'", "''")).replace("__NEAREST__", nearest_ctes("vocabulary")),
    "remove_stopwords": _sql(sql.remove_stopwords("lower(text)")),
    "strip_accents": _sql(sql.accents("text")),
    "extract_seniority": _words_sql(fv.SENIORITIES),
    "extract_hierarchy": _words_sql(fv.HIERARCHIES),
    "remove_locations": _sql(sql.remove_locations("lower(text)")),
    "normalize_conjugation": _sql(sql.conjugated("lower(text)")),
    "normalize_plural": _sql(sql.plural("lower(text)")),
    "normalize_gender": _sql(sql.phrase_rules("lower(text)", "mapping_gender")),
    "normalize_thesaurus": _sql(sql.phrase_rules("lower(text)", "mapping_thesaurus")),
    "normalize_title": with_views(
        ["part_titles", "staff_titles"],
        "SELECT id, norm_title, coalesce(array_to_string(seniorities, ','), '') AS seniorities, "
        "coalesce(array_to_string(hierarchies, ','), '') AS hierarchies "
        f"FROM ({sql.normalized(TITLE_ROWS, 'title', 'id')})",
    ),
    "normalize_title_with_locations": with_views(
        ["part_titles", "staff_titles"],
        "SELECT id, "
        + sql.plural(sql.remove_locations(sql.accents(sql.remove_stopwords(sql.drop_symbols(
            sql.symbols_to_space(sql.line_breaks("lower(title)")))))))
        + f" AS norm_title FROM {TITLE_ROWS}",
    ),
}
