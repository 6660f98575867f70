"""Match titles made from parts and orders to a catalogue made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators import matching as m
from titleloom.operators.normalize import Steps, normalize_distinct
from titleloom.queries import sql
from titleloom.queries.standins import gazetteer, table, view, with_views
from titleloom.queries.vocabulary import built_catalogue, with_catalogue

STEPS = Steps(correct_typos=False)
PROFILES = (1, 11)


def job_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all parts and of all line items with their part and order."""
    parts = view(spark, sf_dir, "part_titles").select("title")
    return parts.unionByName(view(spark, sf_dir, "long_titles").select("title"))


JOB_TITLES = "(SELECT title FROM part_titles UNION ALL SELECT title FROM long_titles)"
TITLE_VIEWS = ("part_titles", "long_titles")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized pieces of all titles."""
    pieces = m.split_compound_title(job_titles(spark, sf_dir)).select(F.col("piece").alias("title")).distinct()
    return normalize_distinct(pieces, gazetteer(spark), STEPS).select("norm_title")


def role_columns(frame: DataFrame, *keep: str) -> DataFrame:
    lists = [F.array_join(F.col(f"role.{c}").cast("array<string>"), ",").alias(c) for c in ("areap_ids", "nivelh_ids", "perfil_ids")]
    return frame.select(*keep, F.col("role.role_id").alias("role_id"), F.col("role.title").alias("role_title"), *lists)


def title_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = normalized(spark, sf_dir).distinct()
    return titles.select("norm_title", F.posexplode(m.title_ngrams(F.col("norm_title"))).alias("rank", "ngram"))


def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_columns(m.match_exact(normalized(spark, sf_dir), built_catalogue(spark, sf_dir)), "norm_title", "match_type")


def match_longest_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.match_longest_ngram(normalized(spark, sf_dir), built_catalogue(spark, sf_dir))
    return role_columns(found, "norm_title", "match_type", "matched_title")


def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known word sequence of documents and conversations, where every text start is a known title."""
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    titles = texts.select(F.lower("text").alias("norm_title"))
    roles = built_catalogue(spark, sf_dir)
    known = titles.select(
        F.array_join(F.slice(m.split_words(F.col("norm_title")), 1, 3), " ").alias("processed_title")
    ).filter("processed_title <> ''").distinct()
    prose = known.select(
        "processed_title", F.lit(1).alias("role_id"), F.col("processed_title").alias("title"), F.lit("main").alias("source"),
        *[F.array().cast(t).alias(c) for c, t in roles.dtypes if t.startswith("array")],
    )
    # Whole texts; no known title has more than three words.
    found = m.match_longest_ngram(titles, prose, max_words=None, longest=3)
    return found.select("norm_title", "matched_title")


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = normalized(spark, sf_dir).distinct()
    return role_columns(m.match_cascade(titles, built_catalogue(spark, sf_dir)), "norm_title", "match_type")


def match_cascade_with_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = normalized(spark, sf_dir).distinct()
    found = m.match_cascade(
        titles, built_catalogue(spark, sf_dir), profile_ids=PROFILES, profiles=profiles(spark, sf_dir)
    )
    return role_columns(found, "norm_title", "match_type")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per profile with the ids that its parts have."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.expr("CAST(p_size % 13 AS INT)").alias("id")).agg(
        F.array_sort(F.collect_set("p_size")).alias("areap_ids"),
        F.array_sort(F.collect_set(F.expr("p_size % 5"))).alias("nivelh_ids"),
        F.array_sort(F.collect_set(F.expr("p_size % 4"))).alias("perfil_ids"),
    )


def filter_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.match_exact(normalized(spark, sf_dir), built_catalogue(spark, sf_dir))
    return role_columns(m.filter_by_profile(found, PROFILES), "norm_title")


def restrict_ids_to_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.match_exact(normalized(spark, sf_dir), built_catalogue(spark, sf_dir))
    return role_columns(m.restrict_ids_to_profile(found, profiles(spark, sf_dir), PROFILES), "norm_title")


def split_compound_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compound titles."""
    return m.split_compound_title(table(spark, sf_dir, "documents").select(F.col("text").alias("title"))).groupBy(
        "pos", "piece"
    ).agg(F.count("*").alias("titles"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.match_pieces(job_titles(spark, sf_dir), built_catalogue(spark, sf_dir), gazetteer(spark), STEPS)


def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = m.normalize_titles(job_titles(spark, sf_dir), built_catalogue(spark, sf_dir), gazetteer(spark), STEPS)
    shown = F.transform("roles", lambda r: F.concat_ws(":", r["role_id"], r["normalized_role"], r["match_type"]))
    return answers.select("title", F.array_join(shown, "|").alias("roles"), F.size("roles").alias("n_roles"))


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.first_match(pieces(spark, sf_dir))


def ab_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select("vag_id", "titulo")
    assigned = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS ab_test_group"
    )
    return m.ab_group_filter(jobs, assigned, "vag_id", "b")


QUERIES = {
    "title_ngrams": title_ngrams,
    "match_exact": match_exact,
    "match_longest_ngram": match_longest_ngram,
    "match_documents": match_documents,
    "match_cascade": match_cascade,
    "match_cascade_with_profile": match_cascade_with_profile,
    "filter_by_profile": filter_by_profile,
    "restrict_ids_to_profile": restrict_ids_to_profile,
    "split_compound_title": split_compound_title,
    "normalize_titles": normalize_titles,
    "first_match": first_match,
    "ab_group_filter": ab_group_filter,
}


def ngram_ctes(source: str, key: str = "norm_title", words: str = "[1:50]", longest: int = 10) -> str:
    """``ngrams``: distinct word sequences of ``norm_title`` with length and first position."""
    blocked = sql.listed(fv.SINGLE_WORD_BLOCKLIST)
    return f"""
titles_in AS (SELECT DISTINCT {key}{'' if key == 'norm_title' else ', norm_title'} FROM {source}),
title_words AS (SELECT *, ({sql.words('norm_title')}){words} AS w FROM titles_in),
spans AS (SELECT *, unnest(range(1, least(len(w) - first + 1, {longest}) + 1)) AS n
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS first FROM title_words)),
ngrams AS (SELECT {key}, array_to_string(w[first:first + n - 1], ' ') AS ngram, n, min(first) AS first
  FROM spans GROUP BY 1, 2, 3 HAVING NOT list_contains({blocked}, ngram))"""


_PIECES = f"(SELECT unnest(regexp_split_to_array(title, '/|,| ou |;|[|]')) AS title FROM {JOB_TITLES})"
_NORM = f"norm AS (SELECT DISTINCT norm_title FROM ({sql.normalized(_PIECES, 'title', 'title')}))"
_IDS = "areap_ids, nivelh_ids, perfil_ids"
LONGEST = (
    "longest AS (SELECT {key}, c.*, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS rn "
    "FROM ngrams JOIN catalogue c ON c.processed_title = ngrams.ngram)"
)


def _matched(query: str) -> str:
    """A query over ``norm``, ``ngrams``, ``longest`` and ``catalogue``."""
    return with_catalogue(", " + ", ".join([_NORM, ngram_ctes("norm"), LONGEST.format(key="norm_title")]) + " " + query, *TITLE_VIEWS)


CASCADE = (
    "cascade AS (SELECT n.norm_title, CASE WHEN e.role_id IS NOT NULL THEN 'database' ELSE 'ahocorasick' END AS match_type, "
    "coalesce(e.role_id, l.role_id) AS role_id, coalesce(e.title, l.title) AS role_title, "
    + ", ".join(f"CASE WHEN e.role_id IS NOT NULL THEN e.{c} ELSE l.{c} END AS {c}" for c in _IDS.split(", "))
    + " FROM norm n LEFT JOIN catalogue e ON e.processed_title = n.norm_title "
    "LEFT JOIN longest l ON l.norm_title = n.norm_title AND l.rn = 1 "
    "WHERE e.role_id IS NOT NULL OR l.role_id IS NOT NULL)"
)
_PROFILE_LIST = "[" + ", ".join(f"'{p}'" for p in PROFILES) + "]"
_OF_PROFILE = f"list_has_any(string_split(perfil_ids, ','), {_PROFILE_LIST})"
_ALLOWED = (
    f"allowed AS (SELECT list(DISTINCT p_size) AS areap, list(DISTINCT p_size % 5) AS nivelh, "
    f"list(DISTINCT p_size % 4) AS perfil FROM part WHERE p_size % 13 IN {PROFILES})"
)


def _kept(column: str, allowed: str) -> str:
    values = f"list_transform(list_filter(string_split({column}, ','), lambda v: v <> ''), lambda v: CAST(v AS INT))"
    return f"coalesce(array_to_string(list_sort(list_intersect({values}, {allowed})), ','), '') AS {column}"


_KEPT = ", ".join([_kept("areap_ids", "areap"), _kept("nivelh_ids", "nivelh"), _kept("perfil_ids", "perfil")])
_EXACT = f"SELECT norm_title, 'database' AS match_type, role_id, title AS role_title, {_IDS} FROM norm JOIN catalogue ON processed_title = norm_title"

def piece_ctes(norm: str) -> str:
    """Pieces of compound titles, each matched by the cascade; ``norm`` selects ``piece, norm_title`` of ``pieces``."""
    return (
        "pieces AS (SELECT title, pos - 1 AS pos, parts[pos] AS piece FROM (SELECT title, parts, "
        "unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT title, regexp_split_to_array(title, '/|,| ou |;|[|]') AS parts "
        "FROM (SELECT DISTINCT title FROM {titles})))), " + norm + ", "
        + ngram_ctes("norm").strip() + ", " + LONGEST.format(key="norm_title") + ", " + CASCADE + ", "
        "found AS (SELECT p.title, p.pos, c.role_id, c.role_title, c.match_type FROM pieces p "
        "JOIN norm n ON n.piece = p.piece JOIN (SELECT DISTINCT * FROM cascade) c ON c.norm_title = n.norm_title)"
    )


PIECE_CTES = piece_ctes(
    "norm AS (SELECT DISTINCT piece, norm_title FROM (" + sql.normalized("pieces", "piece", "piece") + ") WHERE norm_title <> '')"
)


def with_pieces(titles: str, query: str, *views: str, ctes: str = PIECE_CTES) -> str:
    """A query over ``found``: title, pos, role of every matched piece of the titles of a FROM item."""
    return with_catalogue(", " + ctes.replace("{titles}", titles) + " " + query, *views)


ORACLES = {
    "title_ngrams": with_views(
        list(TITLE_VIEWS) + ["main_table"],
        f", {_NORM}, {ngram_ctes('norm')} SELECT norm_title, CAST(row_number() OVER (PARTITION BY norm_title "
        "ORDER BY n DESC, first) - 1 AS INT) AS rank, ngram FROM ngrams",
    ),
    "match_exact": _matched(_EXACT),
    "match_longest_ngram": _matched(
        "SELECT norm_title, 'ahocorasick' AS match_type, processed_title AS matched_title, role_id, "
        f"title AS role_title, {_IDS} FROM longest WHERE rn = 1"
    ),
    "match_documents": (
        "WITH texts AS (SELECT DISTINCT lower(text) AS norm_title FROM (SELECT text FROM documents UNION ALL "
        f"SELECT text FROM conversations)), {ngram_ctes('texts', words='', longest=3)}, known AS (SELECT DISTINCT "
        f"array_to_string(({sql.words('norm_title')})[1:3], ' ') AS processed_title FROM texts) "
        "SELECT norm_title, ngram AS matched_title FROM (SELECT *, row_number() OVER (PARTITION BY norm_title "
        "ORDER BY n DESC, first) AS rn FROM ngrams JOIN known ON ngram = processed_title) WHERE rn = 1"
    ),
    "match_cascade": _matched(f", {CASCADE} SELECT * FROM cascade"),
    "match_cascade_with_profile": _matched(
        f", {CASCADE}, {_ALLOWED} SELECT norm_title, match_type, role_id, role_title, {_KEPT} "
        f"FROM cascade, allowed WHERE {_OF_PROFILE}"
    ),
    "filter_by_profile": _matched(
        f"SELECT norm_title, role_id, title AS role_title, {_IDS} FROM norm JOIN catalogue "
        f"ON processed_title = norm_title WHERE {_OF_PROFILE}"
    ),
    "restrict_ids_to_profile": _matched(
        f", {_ALLOWED} SELECT norm_title, role_id, title AS role_title, {_KEPT} FROM norm JOIN catalogue "
        "ON processed_title = norm_title, allowed"
    ),
    "split_compound_title": (
        "SELECT CAST(pos - 1 AS INT) AS pos, parts[pos] AS piece, count(*) AS titles FROM (SELECT parts, "
        "unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT regexp_split_to_array(text, '/|,| ou |;|[|]') AS parts "
        "FROM documents)) GROUP BY 1, 2"
    ),
    "normalize_titles": with_pieces(
        JOB_TITLES,
        "SELECT title, string_agg(role_id || ':' || role_title || ':' || match_type, '|' ORDER BY pos) AS roles, "
        "CAST(count(*) AS INT) AS n_roles FROM found GROUP BY title",
        *TITLE_VIEWS,
    ),
    "first_match": with_pieces(
        JOB_TITLES, "SELECT title, arg_min(role_id, pos) AS role_id FROM found GROUP BY title", *TITLE_VIEWS
    ),
    "ab_group_filter": with_views(
        ["jobs"],
        "SELECT vag_id, titulo FROM jobs WHERE vag_id IN (SELECT o_orderkey FROM orders "
        "WHERE o_custkey % 2 <> 0 AND o_orderpriority <> '5-LOW')",
    ),
}
