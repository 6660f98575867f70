"""Embedding match with vectors of the embeddings table standing for word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.text import split_words
from titleloom.operators import embedding as emb
from titleloom.queries import sql
from titleloom.queries.standins import table, view, with_views


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of all part titles and conversations."""
    titles = view(spark, sf_dir, "similar_table").select(F.col("titulo").alias("text"))
    texts = titles.unionByName(table(spark, sf_dir, "conversations").select("text"))
    return texts.select(F.explode(split_words(F.lower("text"))).alias("word")).distinct()


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, vec, idf``: a vector and a weight picked by the word itself; very long and very short words have none."""
    picked = _words(spark, sf_dir).withColumn("h", F.expr("CAST(conv(substr(md5(word), 1, 7), 16, 10) AS BIGINT)"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))
    # Every vector of the table can be picked.
    return (
        picked.withColumn("v", F.col("h") % F.lit(vectors.count()))
        .join(vectors, "v")
        .filter("length(word) <= 13")
        .selectExpr("word", "vec", "CASE WHEN length(word) = 1 THEN NULL ELSE 1 + (h % 9) / 4.0 END AS idf")
    )


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part titles; some repeat their first word."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "lower(concat(p_type, ' ', p_name, CASE WHEN p_size % 3 = 0 THEN concat(' ', p_type) ELSE '' END)) AS title"
    )
    return parts.distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), r"\n")).alias("title"))
    return lines.filter("title <> ''").distinct()


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, plain and after their type, as catalogue titles."""
    names = table(spark, sf_dir, "part").selectExpr("lower(p_name) AS a", "lower(p_type) AS b")
    return names.selectExpr("explode(array(a, concat(b, ' ', a))) AS processed_title").distinct()


def title_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir).unionByName(_lines(spark, sf_dir))
    done = emb.title_embedding(titles, word_vectors(spark, sf_dir))
    return done.select(
        "title", F.round("weight", 6).alias("weight"), F.posexplode("embedding").alias("dimension", "value")
    ).groupBy("title", "weight").agg(
        F.round(F.sum(F.col("value") * (F.col("dimension") + 1)), 6).alias("checksum"),
        F.round(F.max("value"), 6).alias("largest"),
    )


def ngram_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir).select(F.col("title").alias("norm_title"))
    done = emb.ngram_embedding(titles, word_vectors(spark, sf_dir))
    return done.select(
        "norm_title", "start", "end", "ngram",
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


def top5_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector of the embeddings table."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("text"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    titles = vectors.select(F.concat(F.lit("t"), "text").alias("matched_title"), "embedding")
    return emb.top5_titles(vectors, titles).select("text", "matched_title", F.round("similarity", 6).alias("similarity"), "rank")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of titles from line items: some hold a starting word."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).selectExpr(
        "concat(p_name, CASE WHEN p_size % 4 = 0 THEN ' trainee' ELSE '' END) AS norm_title",
        "concat(CASE WHEN l_linenumber % 3 = 0 THEN 'estagiario ' ELSE '' END, p_type) AS matched_title",
    ).distinct()


def starting_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb.starting_role_filter(_pairs(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per order with similarities from prices: line numbers give spans and ranks."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('order ', l_orderkey) AS norm_title", "l_linenumber AS start", "l_linenumber + 1 + CAST(l_suppkey % 3 AS INT) AS end",
        "CAST(l_partkey AS INT) AS rank", "0.86 + CAST(l_extendedprice % 141 AS INT) / 1000.0D AS similarity",
        "concat('part ', l_partkey) AS matched_title",
    ).distinct()


def best_similarity_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = emb.best_similarity_fold(_candidates(spark, sf_dir))
    return done.select("norm_title", "matched_title", F.round("similarity", 6).alias("similarity"))


def _input_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in another word order than the catalogue, with further words."""
    return table(spark, sf_dir, "part").selectExpr(
        "lower(concat(p_name, ' ', p_type, CASE WHEN p_size % 2 = 0 THEN concat(' ', p_name) ELSE '' END)) AS norm_title"
    ).distinct()


def match_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = emb.match_embedding(_input_titles(spark, sf_dir), _catalogue(spark, sf_dir), word_vectors(spark, sf_dir))
    return found.select("norm_title", "matched_title", F.round("similarity", 6).alias("similarity"))


QUERIES = {
    "title_embedding": title_embedding,
    "ngram_embedding": ngram_embedding,
    "top5_titles": top5_titles,
    "starting_role_filter": starting_role_filter,
    "best_similarity_fold": best_similarity_fold,
    "match_embedding": match_embedding,
}

_W = sql.words("lower(text)")
_VECTORS = f"""
words AS (SELECT DISTINCT word FROM (SELECT unnest({_W}) AS word FROM (SELECT titulo AS text FROM similar_table
  UNION ALL SELECT text FROM conversations))),
picked AS (SELECT word, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) AS h FROM words),
vectors AS (SELECT word, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN length(word) = 1 THEN NULL ELSE 1 + (h % 9) / 4.0 END AS idf
  FROM picked JOIN embeddings ON vec_id = h % (SELECT count(*) FROM embeddings) WHERE length(word) <= 13),
known AS (SELECT * FROM vectors WHERE idf IS NOT NULL)"""
_PARTS = (
    "SELECT DISTINCT lower(p_type || ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || p_type ELSE '' END) AS title FROM part"
)
_LINES = (
    "SELECT DISTINCT title FROM (SELECT unnest(string_split(lower(text), chr(10))) AS title FROM conversations) WHERE title <> ''"
)


def _embedded(name: str, titles: str) -> str:
    """CTE ``title, weight, vec`` of the titles all of whose words are known."""
    return f"""
{name}_w AS (SELECT title, word, pos FROM (SELECT title, w[pos] AS word, pos FROM (SELECT title, w,
  unnest(range(1, len(w) + 1)) AS pos FROM (SELECT title, {sql.words('title')} AS w FROM ({titles}))))),
{name}_ok AS (SELECT title FROM {name}_w LEFT JOIN known USING (word) GROUP BY title HAVING count(*) = count(known.vec)),
{name}_d AS (SELECT title, d, sum(vec[d] * idf) AS total FROM (SELECT title, vec, idf, unnest(range(1, 65)) AS d
  FROM {name}_w JOIN known USING (word) WHERE title IN (SELECT title FROM {name}_ok)) GROUP BY title, d),
{name}_g AS (SELECT title, sum(idf) AS weight FROM (SELECT DISTINCT title, word FROM {name}_w) JOIN known USING (word) GROUP BY title),
{name} AS (SELECT title, weight, list(total / weight ORDER BY d) AS vec FROM {name}_d JOIN {name}_g USING (title) GROUP BY title, weight)"""


_SPANS = f"""
span_w AS (SELECT title, {sql.words('title')} AS w FROM titles_in
  WHERE title NOT IN (SELECT title FROM (SELECT title, unnest({sql.words('title')}) AS word FROM titles_in)
    WHERE word NOT IN (SELECT word FROM known))),
spans AS (SELECT title, s AS start, e AS "end", w[s + 1:e] AS part FROM (SELECT title, w, s, unnest(range(s + 1, len(w) + 1)) AS e
  FROM (SELECT title, w, unnest(range(0, len(w))) AS s FROM span_w))),
span_words AS (SELECT title, start, "end", unnest(part) AS word FROM spans),
span_d AS (SELECT title, start, "end", d, sum(vec[d]) / sum(idf) AS x FROM (SELECT title, start, "end", vec, idf,
  unnest(range(1, 65)) AS d FROM span_words JOIN known USING (word)) GROUP BY ALL),
span_vec AS (SELECT title, start, "end", list(x ORDER BY d) AS vec FROM span_d GROUP BY ALL)"""

# The fold as a recursion over the candidates of a title in order.
_FOLD = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY start, "end", rank, similarity, matched_title) AS rn
  FROM candidates WHERE similarity > {fv.MIN_SIMILARITY}),
fold AS (
  SELECT title, CAST(0 AS BIGINT) AS rn, CAST(0.0 AS DOUBLE) AS similarity, CAST(NULL AS VARCHAR) AS matched_title, 0 AS words
  FROM (SELECT DISTINCT title FROM ordered)
  UNION ALL
  SELECT title, rn, CASE WHEN takes THEN s ELSE similarity END, CASE WHEN takes THEN t ELSE matched_title END,
    CASE WHEN takes THEN n ELSE words END
  FROM (SELECT f.title, o.rn, f.similarity, f.matched_title, f.words, o.similarity AS s, o.matched_title AS t,
      CAST(o."end" - o.start AS INT) AS n, (o.similarity - f.similarity > {fv.SIMILARITY_TOLERANCE}) OR
      (abs(o.similarity - f.similarity) <= {fv.SIMILARITY_TOLERANCE} AND o."end" - o.start > f.words) AS takes
    FROM fold f JOIN ordered o ON o.title = f.title AND o.rn = f.rn + 1)),
folded AS (SELECT title AS norm_title, matched_title, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER
  (PARTITION BY title ORDER BY rn DESC) AS back FROM fold) WHERE back = 1)"""

_INPUT = (
    "SELECT DISTINCT lower(p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END) AS title FROM part"
)
_STARTING = sql.listed(fv.STARTING_ROLE_WORDS)


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "title_embedding": with_views(
        ["similar_table"],
        f", {_VECTORS}, {_embedded('embedded', _PARTS + ' UNION ' + _LINES)} "
        "SELECT title, round(weight, 6) AS weight, round(list_sum(list_transform(range(1, 65), lambda d: vec[d] * d)), 6) AS checksum, "
        "round(list_max(vec), 6) AS largest FROM embedded",
    ),
    "ngram_embedding": with_views(
        ["similar_table"],
        f", {_VECTORS}, titles_in AS ({_PARTS}), {_SPANS} SELECT s.title AS norm_title, CAST(s.start AS INT) AS start, "
        'CAST(s."end" AS INT) AS "end", array_to_string(part, \' \') AS ngram, round(list_sum(vec), 6) AS total '
        'FROM spans s JOIN span_vec v ON s.title = v.title AND s.start = v.start AND s."end" = v."end"',
    ),
    "top5_titles": """
SELECT text, matched_title, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, matched_title) AS rank FROM (
    SELECT CAST(a.vec_id AS VARCHAR) AS text, 't' || b.vec_id AS matched_title,
      round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
    FROM embeddings a, embeddings b)) WHERE rank <= 5""",
    "starting_role_filter": (
        "SELECT * FROM (SELECT DISTINCT p_name || CASE WHEN p_size % 4 = 0 THEN ' trainee' ELSE '' END AS norm_title, "
        "CASE WHEN l_linenumber % 3 = 0 THEN 'estagiario ' ELSE '' END || p_type AS matched_title FROM lineitem "
        f"JOIN part ON l_partkey = p_partkey) WHERE NOT list_has_any({sql.words('matched_title')}, {_STARTING}) "
        f"OR list_has_any({sql.words('norm_title')}, {_STARTING})"
    ),
    "best_similarity_fold": (
        "WITH RECURSIVE candidates AS (SELECT DISTINCT 'order ' || l_orderkey AS title, l_linenumber AS start, "
        'l_linenumber + 1 + CAST(l_suppkey % 3 AS INT) AS "end", CAST(l_partkey AS INT) AS rank, '
        "CAST(0.86 AS DOUBLE) + CAST(floor(l_extendedprice % 141) AS INT) / CAST(1000 AS DOUBLE) AS similarity, "
        f"'part ' || l_partkey AS matched_title FROM lineitem), {_FOLD} SELECT * FROM folded"
    ),
    "match_embedding": _recursive(with_views(
        ["similar_table"],
        f", {_VECTORS}, titles_in AS ({_INPUT}), {_SPANS}, "
        + _embedded("role_vec", "SELECT DISTINCT unnest([lower(p_name), lower(p_type) || ' ' || lower(p_name)]) AS title FROM part")
        + """, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, start, "end"
  ORDER BY similarity DESC, matched_title) AS rank FROM (SELECT s.title, s.start, s."end", r.title AS matched_title,
    round(list_cosine_similarity(s.vec, r.vec), 9) AS similarity FROM span_vec s, role_vec r)) WHERE rank <= 5),
candidates AS (SELECT * FROM near WHERE NOT list_has_any(""" + sql.words("matched_title") + f", {_STARTING}) "
        f"OR list_has_any({sql.words('title')}, {_STARTING})), {_FOLD} SELECT * FROM folded",
    )),
}
