"""The corpus pipeline: language, repeated lines, near duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)``, reads what its predecessor kept and, but for the last, returns the columns
of documents. Null texts count as empty, null doc_ids are kept as such, an empty table gives an empty table, columns
beside ``COLUMNS`` are not read and not returned. Rows that repeat are worked on each, but for the near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleloom.llm import covering, langid, line_windows, mixing, packing
from titleloom.llm.common import read_documents, staged
from titleloom.llm.queries.operators import CAPACITY, tokenizer_path, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# The near duplicates are those of the covering SimHash query: three-word shingles, two bits.
SHINGLE = 3
RADIUS = 2


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those that the nearest-centroid classifier does not reject.

    Texts without letters (null and empty ones too) are rejected. A table without labelled rows has nothing to
    compare with, so all its documents stay.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.select(*COLUMNS)
    return langid.predict(docs, model, keep_text=True).filter("not rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those that lose every line go.

    A document that loses nothing stays as it is, also a null or empty one. Of repeated rows the first keeps its lines.
    """
    cleaned = line_windows.drop_repeated_windows(docs)
    return _counted(cleaned.filter("n_removed = 0 OR trim(text) != ''"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (then text key) of each component of near-equal fingerprints, as one row.

    Null and empty texts and those of white space have the fingerprint zero, so one of them stays. A null doc_id stands
    for a component only if it has no other.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    found = covering.near_duplicates(keyed, SHINGLE, RADIUS, ("doc_id", "text_key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    first = found.groupBy("root").agg(least.alias("first")).select(
        F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    stays = keyed.join(first, same, "left_semi")
    repeat = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("source", "lang"))
    return stays.withColumn("__repeat", repeat).filter("__repeat = 1").select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; a part of one is a whole copy from one half on, else none.

    A null source is a source of its own. Documents without words have no size; they come once for each whole copy
    their rate gives.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    mixed = mixing.mix_sources(keyed, word_count(), keys=("doc_id", "text_key"))
    whole = F.col("copies") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = staged(mixed.select("doc_id", "text_key", whole.cast("int").alias("copies")).distinct(), "taken")
    joined = keyed.join(taken.toDF("t_id", "t_key", "copies"),
                        F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key")))
    return _counted(joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences; a null or empty text is its closing id."""
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY)


STAGES = [
    ("language", keep_identified),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixture", mix_to_targets),
    ("packing", pack),
]

# A classifier, SimHash and a tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
