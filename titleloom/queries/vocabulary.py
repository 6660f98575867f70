"""Vocabulary and catalogue building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators import catalogue as cat
from titleloom.operators import vocabulary as voc
from titleloom.operators import word_loads
from titleloom.queries import sql
from titleloom.queries.standins import gazetteer, table, view, with_views
from titleloom.session import new_shared_path
from titleloom.sources import catalogue as roles
from titleloom.sources import gazetteers

_ID_LISTS = ("areap_ids", "nivelh_ids", "perfil_ids")


def all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = roles.read_main_roles(view(spark, sf_dir, "main_table"))
    return main.unionByName(roles.read_similar_roles(view(spark, sf_dir, "similar_table")))


def id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id lists of all parts but promotional ones."""
    return table(spark, sf_dir, "part").filter("p_type <> 'PROMO'").selectExpr(
        "CAST(p_partkey AS INT) AS id", "array(p_size, p_size % 7 + 100) AS areap_ids",
        "array(p_size % 5) AS nivelh_ids", "array(p_size % 4, p_size % 3 + 10) AS perfil_ids",
    )


def built_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.build_catalogue(all_roles(spark, sf_dir), gazetteer(spark), id_mapping(spark, sf_dir))


def shown(frame: DataFrame) -> DataFrame:
    """Lists as texts."""
    lists = [c for c, t in frame.dtypes if t.startswith("array")]
    return frame.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in frame.columns])


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "text_lines")


def _stop_table(spark: SparkSession) -> DataFrame:
    return gazetteers.stopwords_of(gazetteers.packaged_lines(spark, "stopwords"))


def distinct_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = all_roles(spark, sf_dir)
    return voc.distinct_titles(both.filter("source = 'main'"), both.filter("source = 'similar'"))


def extract_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.extract_words(table(spark, sf_dir, "documents"), "text", gazetteer(spark).stopwords)


def merge_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = gazetteer(spark).stopwords
    turns = voc.extract_words(table(spark, sf_dir, "conversations"), "text", stop)
    return voc.merge_word_freq(extract_words(spark, sf_dir), turns)


def merge_word_freq_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words from a table kept load by load; one load comes twice and counts once."""
    stop, path = gazetteer(spark).stopwords, new_shared_path(spark, "word-loads")
    for name in ("documents", "conversations", "documents"):
        word_loads.add_word_load(spark, path, name, voc.extract_words(table(spark, sf_dir, name), "text", stop))
    return word_loads.read_word_freq(spark, path)


def rule_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteers.rule_words_of(_document_lines(spark, sf_dir), _stop_table(spark))


def build_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, rule lines, stopwords and verb forms, with the fixed words."""
    lists = gazetteer(spark)
    verbs = {*lists.conjugation, *lists.conjugation.values()}
    return voc.build_dictionary(extract_words(spark, sf_dir), rule_words(spark, sf_dir), words={*lists.stopwords, *verbs})


def location_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the document lines that no conversation uses."""
    titles = table(spark, sf_dir, "conversations").select(F.col("text").alias("title"))
    return voc.location_words(_document_lines(spark, sf_dir), titles, _stop_table(spark))


def normalize_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cat.normalize_catalogue(all_roles(spark, sf_dir), gazetteer(spark), id_mapping(spark, sf_dir)))


def _main_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cat.normalize_catalogue(all_roles(spark, sf_dir), gazetteer(spark), id_mapping(spark, sf_dir))
    return cat.dedupe_main(done)


def dedupe_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cat.normalize_catalogue(all_roles(spark, sf_dir), gazetteer(spark), id_mapping(spark, sf_dir))
    return shown(cat.dedupe_similar(done, cat.dedupe_main(done)))


QUERIES = {
    "distinct_titles": distinct_titles,
    "extract_words": extract_words,
    "merge_word_freq": merge_word_freq,
    "merge_word_freq_loads": merge_word_freq_loads,
    "build_dictionary": build_dictionary,
    "rule_words": rule_words,
    "location_words": location_words,
    "normalize_catalogue": normalize_catalogue,
    "dedupe_main": lambda spark, sf_dir: shown(_main_catalogue(spark, sf_dir)),
    "dedupe_similar": dedupe_similar,
    "build_catalogue": lambda spark, sf_dir: shown(built_catalogue(spark, sf_dir)),
}

_BREAKS = voc.word_breaks().replace("'", "''")


def _words_of(table_name: str, column: str) -> str:
    return (
        f"SELECT word FROM (SELECT unnest(list_transform(regexp_split_to_array({column}, '{_BREAKS}'), "
        f"lambda w: lower({sql.strip('w')}))) AS word FROM {table_name}) "
        f"WHERE length(word) >= {fv.MIN_WORD_LENGTH} AND NOT list_contains({sql.listed(sql.stopwords())}, word)"
    )


def _freq_of(table_name: str) -> str:
    return f"SELECT word, count(*) AS freq FROM ({_words_of(table_name, 'text')}) GROUP BY word"


_RULE_WORDS = (
    "SELECT DISTINCT word FROM (SELECT unnest(" + sql.words("token") + ") AS word FROM (SELECT unnest(string_split("
    "lower(text), ',')) AS token FROM text_lines WHERE text NOT LIKE '#%')) "
    f"WHERE NOT list_contains({sql.listed(sql.stopwords())}, word)"
)
_FIXED = {*fv.SENIORITIES, *fv.HIERARCHIES, *sql.stopwords(), *sql.conjugation(), *sql.conjugation().values()}

_ROLES = (
    "(SELECT cargo_id AS role_id, titulo AS title, 'main' AS source FROM main_table WHERE cargo_id > 0 AND titulo <> '' "
    "UNION ALL SELECT cargo_id, titulo, 'similar' FROM similar_table WHERE cargo_id > 0 AND titulo <> '')"
)
_MAPPED = (
    "SELECT r.role_id, r.title, r.source, r.norm_title AS processed_title, "
    "coalesce(array_to_string(r.seniorities, ','), '') AS seniorities, "
    "coalesce(array_to_string(r.hierarchies, ','), '') AS hierarchies, "
    "coalesce(p_size || ',' || (p_size % 7 + 100), '') AS areap_ids, coalesce(CAST(p_size % 5 AS VARCHAR), '') AS nivelh_ids, "
    "coalesce((p_size % 4) || ',' || (p_size % 3 + 10), '') AS perfil_ids FROM roles_done r "
    "LEFT JOIN part ON p_partkey = r.role_id AND p_type <> 'PROMO'"
)


def with_catalogue(query: str, *views: str) -> str:
    """A query over ``mapped`` (all normalized roles), ``main``, ``similar`` and ``catalogue``."""
    start = with_views(["main_table", "similar_table", *views], "").rstrip()
    first = "row_number() OVER (PARTITION BY processed_title ORDER BY {}role_id, title) AS rn"
    return (
        f"{start}, roles_done AS ({sql.normalized(_ROLES, 'title', 'role_id, title, source')}), mapped AS ({_MAPPED}), "
        f"main AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {first.format('')} FROM mapped WHERE source = 'main') WHERE rn = 1), "
        f"similar_roles AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {first.format('')} FROM mapped WHERE source = 'similar') "
        "WHERE rn = 1 AND processed_title NOT IN (SELECT processed_title FROM main)), "
        "catalogue AS (SELECT * FROM main WHERE processed_title <> '' UNION ALL "
        f"SELECT * FROM similar_roles WHERE processed_title <> '') {query}"
    )


ORACLES = {
    "distinct_titles": with_views(["main_table", "similar_table"], f"SELECT DISTINCT title FROM {_ROLES}"),
    "extract_words": _freq_of("documents"),
    "merge_word_freq": "SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM "
    f"({_freq_of('documents')} UNION ALL {_freq_of('conversations')}) GROUP BY word",
    "build_dictionary": with_views(
        ["text_lines"],
        f"SELECT DISTINCT word FROM (({_words_of('documents', 'text')}) UNION ALL ({_RULE_WORDS}) "
        f"UNION ALL SELECT unnest({sql.listed(_FIXED)}))",
    ),
    "rule_words": with_views(["text_lines"], _RULE_WORDS),
    "location_words": with_views(
        ["text_lines"], f"({_RULE_WORDS}) EXCEPT ({_words_of('conversations', 'text')})"
    ),
    "normalize_catalogue": with_catalogue("SELECT * FROM mapped"),
    "dedupe_main": with_catalogue("SELECT * FROM main"),
    "dedupe_similar": with_catalogue("SELECT * FROM similar_roles"),
    "build_catalogue": with_catalogue("SELECT * FROM catalogue"),
}

# Load by load or at once, the words are the same.
ORACLES["merge_word_freq_loads"] = ORACLES["merge_word_freq"]
