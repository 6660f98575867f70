"""Exact duplicates by deterministic block naming: equal blocks get equal integers, then equal pairs do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import equal_keys, join_counted, shuffle_partitions, staged

BLOCK_BYTES = 16_384
# A bucket's ranks stay below this, so bucket and rank fit one long.
RANKS = 1 << 40


def ascii_lower(text: Column) -> Column:
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def fixed_blocks(content: Column, size: int) -> Column:
    """Blocks of ``size`` bytes, the last one shorter; empty content is one empty block."""
    last = F.floor((F.octet_length(content) - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * size + 1, F.lit(size)))
    return F.when(F.octet_length(content) <= size, F.array(content)).otherwise(cut)


def _named(rows: DataFrame, value: list[str]) -> DataFrame:
    """``doc_id, text_key, n_blocks, at, name`` from rows with those columns but the name, and ``value``.

    Rows equal in ``value`` get one integer, others another. First, rows of one salt agree on a representative
    (their smallest); then the representatives, at most one per value and salt, are sorted by value and numbered
    inside buckets of values. A value that most rows hold is so spread over all salts.
    """
    buckets = shuffle_partitions(rows.sparkSession)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(7)), F.lit(buckets)))
    # Both uses below need every column, so that they read one exchange.
    member = F.struct("doc_id", "text_key", "at", "n_blocks")
    near = salted.withColumn("__near", F.min(member).over(Window.partitionBy(*value, "__salt")))
    sorted_values = Window.partitionBy("__bucket").orderBy(*value)
    names = (
        near.filter(member.eqNullSafe(F.col("__near")))
        .select("__near", *value, F.pmod(F.xxhash64(*value, F.lit(11)), F.lit(buckets)).alias("__bucket"))
        .select("__near", (F.col("__bucket") * RANKS + F.dense_rank().over(sorted_values)).alias("name"))
        .groupBy("__near")
        .agg(F.min("name").alias("name"))
        .select("name", *[F.col(f"__near.{c}").alias(f"near_{c}") for c in ("doc_id", "text_key", "at")])
    )
    members = near.select(
        "doc_id", "text_key", "n_blocks", "at",
        *[F.col(f"__near.{c}").alias(f"near_{c}") for c in ("doc_id", "text_key", "at")],
    )
    joined = members.join(names, equal_keys(members, names, ["near_doc_id", "near_text_key", "near_at"]))
    return joined.select("doc_id", "text_key", "n_blocks", "at", "name")


def block_names(docs: DataFrame, content: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text_key, n_blocks, name``: contents are equal if and only if ``n_blocks, name`` are.

    ``content`` is a binary column of ``docs``, never null. It is cut into blocks of fixed size, equal blocks are
    sorted together and named by an integer, then neighbouring names are paired and the pairs named, until each
    document has one name. Names stand for values, not hashes, so there are no collisions. ``text_key`` tells rows
    apart that share a doc_id; rows equal in both are one document and give one row.
    """
    blocks = docs.select("doc_id", content.alias("content")).select(
        "doc_id", F.xxhash64("content").alias("text_key"), fixed_blocks(F.col("content"), block_bytes).alias("blocks")
    ).select("doc_id", "text_key", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("at", "block"))
    named = staged(_named(blocks, ["block"]), "names")
    done = []
    while True:
        # A document whose content is one block, or whose pairs have been paired up to one, is done.
        done.append(named.filter("n_left = 1") if "n_left" in named.columns else named.filter("n_blocks = 1"))
        left = F.col("n_left") if "n_left" in named.columns else F.col("n_blocks")
        open_rows = named.withColumn("n_left", left).filter("n_left > 1")
        if open_rows.isEmpty():
            break
        pairs = (
            open_rows.groupBy(
                "doc_id", "text_key", "n_blocks", "n_left", F.floor(F.col("at") / 2).cast("int").alias("pair")
            )
            .agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            )
            .withColumnRenamed("pair", "at")
        )
        halves = pairs.select("doc_id", "text_key", "n_blocks", "at", "first", "second")
        again = _named(halves, ["first", "second"])
        rounds = len(done)
        n_left = F.ceil(F.col("n_blocks") / F.lit(1 << rounds)).cast("int")
        named = staged(again.withColumn("n_left", n_left), "names")
    result = done[0].select("doc_id", "text_key", "n_blocks", "name")
    for part in done[1:]:
        result = result.unionByName(part.select("doc_id", "text_key", "n_blocks", "name"))
    return result.dropDuplicates(["doc_id", "text_key", "n_blocks"])


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with its group of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty, and empty texts are equal. The
    largest doc_id of a group stays. One row per input row: rows equal in doc_id and text are named once, but each counts
    in ``group_size`` and comes back; rows that share a doc_id but not the text are documents of their own. A null doc_id is smaller than any other. Columns beside ``doc_id`` and
    ``text`` are not read.
    """
    lowered = docs.select(F.col("doc_id"), ascii_lower(F.col("text")).alias("text"))
    content = F.col("text").cast("binary")
    names = block_names(lowered, content, block_bytes)
    digests = lowered.groupBy(
        F.col("doc_id").alias("__doc_id"),
        F.xxhash64(content).alias("__text_key"),
        F.sha2(content, 256).alias("text_sha256"),
    ).agg(F.count("*").alias("copies"))
    same = names["doc_id"].eqNullSafe(digests["__doc_id"]) & (names["text_key"] == digests["__text_key"])
    documents = staged(
        names.join(digests, same).select("doc_id", "n_blocks", "name", "copies", "text_sha256"), "identities"
    )
    groups = staged(
        documents.groupBy("n_blocks", "name").agg(
            F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("documents")
        ),
        "groups",
    )
    grouped = join_counted(documents, groups, ["n_blocks", "name"], "documents")
    return grouped.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
