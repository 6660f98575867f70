"""The chain with spelling on, and the cascade with its embedding leg."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.operators import matching as m
from titleloom.operators.normalize import Steps, normalize_title
from titleloom.queries import embedding as emb
from titleloom.queries import matching as mq
from titleloom.queries import sql, text
from titleloom.queries.standins import gazetteer, table, with_views
from titleloom.queries.vocabulary import built_catalogue, with_catalogue


def normalize_title_with_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles through the whole chain, corrected to the words of the benchmark texts and of the rules."""
    rows = text.title_rows(spark, sf_dir)
    done = normalize_title(rows, gazetteer(spark), Steps(), text.vocabulary(spark, sf_dir))
    return done.select(
        "id", "norm_title", F.array_join("seniorities", ",").alias("seniorities"),
        F.array_join("hierarchies", ",").alias("hierarchies"),
    )


def normalize_titles_with_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = m.normalize_titles(
        mq.job_titles(spark, sf_dir), built_catalogue(spark, sf_dir), gazetteer(spark), Steps(), text.vocabulary(spark, sf_dir)
    )
    shown = F.transform("roles", lambda r: F.concat_ws(":", r["role_id"], r["normalized_role"], r["match_type"]))
    return answers.select("title", F.array_join(shown, "|").alias("roles"), F.size("roles").alias("n_roles"))


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as they are, and with their words turned round, which only the embedding leg finds."""
    return table(spark, sf_dir, "part").selectExpr(
        "explode(array(lower(p_name), lower(concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))), "
        "lower(concat(p_brand, ' ', p_name)), lower(p_type))) AS norm_title"
    ).distinct()


def match_cascade_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.match_cascade(
        _turned(spark, sf_dir), built_catalogue(spark, sf_dir), word_vectors=emb.word_vectors(spark, sf_dir)
    )
    return mq.role_columns(found, "norm_title", "match_type")


QUERIES = {
    "normalize_title_with_spelling": normalize_title_with_spelling,
    "normalize_titles_with_spelling": normalize_titles_with_spelling,
    "match_cascade_with_vectors": match_cascade_with_vectors,
}


def _terms() -> Counter:
    """Words of the special terms and the thesaurus, as often as the rules hold them."""
    found: Counter = Counter()
    for name in ("mapping_special_character_terms", "mapping_thesaurus"):
        rules = {line[0]: {line[0], *line[1:]} if line[0] in line[1:] else {*line[1:]} for line in sql.file_lines(name) if len(line) >= 2}
        for base, variations in rules.items():
            for term in (base, *variations):
                found.update(w for w in term.split() if w not in sql.stopwords())
    return found


def spelling_ctes(source: str, title: str) -> str:
    """CTE ``spelled``: ``title, text`` of the distinct titles of a FROM item, cleaned and corrected."""
    terms, verbs = _terms(), sql.conjugation()
    right = {*sql.stopwords(), *sql.locations(), *fv.SENIORITIES, *fv.HIERARCHIES, *verbs, *verbs.values(), *terms}
    counted = ", ".join(f"({sql.quoted(w)}, {n})" for w, n in sorted(terms.items()))
    return f"""
vocabulary AS (
  SELECT word, count(*) AS freq FROM (
    SELECT unnest(list_transform(regexp_split_to_array({sql.line_breaks('text')}, '{text.word_breaks().replace("'", "''")}'),
      lambda w: lower({sql.strip('w')}))) AS word FROM benchmark)
  WHERE length(word) >= 2 AND NOT list_contains({sql.listed(sql.stopwords())}, word) GROUP BY word),
targets AS (SELECT word, sum(freq) AS freq FROM (SELECT * FROM vocabulary UNION ALL SELECT * FROM (VALUES {counted}) AS t(word, freq)) GROUP BY word),
turns AS (SELECT title, {sql.words('cleaned')} AS words FROM (
  SELECT title, {sql.cleaned('title')} AS cleaned FROM (SELECT DISTINCT {title} AS title FROM {source}) WHERE title <> '')),
placed AS (SELECT title, words[pos] AS word, pos FROM (SELECT title, words, unnest(range(1, len(words) + 1)) AS pos FROM turns)),
unknown AS (SELECT DISTINCT word FROM placed ANTI JOIN targets USING (word) WHERE NOT list_contains({sql.listed(right)}, word)),
{text.nearest_ctes('targets')},
spelled AS (SELECT turns.title, coalesce(string_agg(coalesce(corrected, placed.word), ' ' ORDER BY pos), '') AS text
  FROM turns LEFT JOIN placed USING (title) LEFT JOIN best ON placed.word = best.word GROUP BY turns.title)"""


_PLAIN = f"(SELECT title, {sql.accents(sql.remove_stopwords('text'))} AS plain_text FROM spelled)"
_PIECES = mq.piece_ctes(
    spelling_ctes("pieces", "piece").strip() + ", norm AS (SELECT DISTINCT piece, norm_title FROM (SELECT title AS piece, "
    + sql.reworded("plain_text") + f" AS norm_title FROM {_PLAIN}) WHERE norm_title <> '')"
)

_LEG = (
    emb._SPANS.replace("titles_in", "rest_in").replace("spans AS", "leg_spans AS").replace("FROM spans)", "FROM leg_spans)")
)

ORACLES = {
    "normalize_title_with_spelling": with_views(
        ["part_titles", "staff_titles"],
        f", {spelling_ctes(text.TITLE_ROWS, 'title').strip()} SELECT id, coalesce(norm_title, '') AS norm_title, "
        "coalesce(array_to_string(seniorities, ','), '') AS seniorities, coalesce(array_to_string(hierarchies, ','), '') AS hierarchies "
        f"FROM {text.TITLE_ROWS} LEFT JOIN (SELECT title, {sql.reworded('plain_text')} AS norm_title, "
        f"{sql.only('plain_text', fv.SENIORITIES)} AS seniorities, {sql.only('plain_text', fv.HIERARCHIES)} AS hierarchies "
        f"FROM {_PLAIN}) USING (title)",
    ),
    "normalize_titles_with_spelling": mq.with_pieces(
        mq.JOB_TITLES,
        "SELECT title, string_agg(role_id || ':' || role_title || ':' || match_type, '|' ORDER BY pos) AS roles, "
        "CAST(count(*) AS INT) AS n_roles FROM found GROUP BY title",
        *mq.TITLE_VIEWS,
        ctes=_PIECES,
    ),
    "match_cascade_with_vectors": emb._recursive(with_catalogue(
        ", norm AS (SELECT DISTINCT unnest([lower(p_name), lower(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)), "
        "lower(p_brand || ' ' || p_name), lower(p_type)]) AS norm_title FROM part), "
        + ", ".join([mq.ngram_ctes("norm"), mq.LONGEST.format(key="norm_title"), mq.CASCADE, emb._VECTORS])
        + ", rest_in AS (SELECT norm_title AS title FROM norm WHERE norm_title <> '' AND norm_title NOT IN (SELECT norm_title FROM cascade)), "
        + _LEG + ", " + emb._embedded("role_vec", "SELECT DISTINCT processed_title AS title FROM catalogue")
        + """, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, start, "end"
  ORDER BY similarity DESC, matched_title) AS rank FROM (SELECT s.title, s.start, s."end", r.title AS matched_title,
    round(list_cosine_similarity(s.vec, r.vec), 9) AS similarity FROM span_vec s, role_vec r)) WHERE rank <= 5),
candidates AS (SELECT * FROM near WHERE NOT list_has_any(""" + sql.words("matched_title") + f", {emb._STARTING}) "
        f"OR list_has_any({sql.words('title')}, {emb._STARTING})), {emb._FOLD} "
        "SELECT norm_title, match_type, role_id, role_title, areap_ids, nivelh_ids, perfil_ids FROM cascade UNION ALL "
        "SELECT norm_title, 'word2vec', role_id, title, areap_ids, nivelh_ids, perfil_ids FROM folded "
        "JOIN catalogue ON processed_title = matched_title",
    )),
}
