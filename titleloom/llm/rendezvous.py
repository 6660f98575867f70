"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import bucket_of, shuffle_partitions, staged, with_prefix_sum

# 13 hexadecimal digits: a double holds every such number exactly.
DRAWS = float(16**13)


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """The score of a shard for a key: an exponential draw from key and shard, divided by the weight; least wins."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / DRAWS
    return -F.log(uniform) / F.lit(float(weight))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the one with the least score. Shards of weight 0 get nothing.

    A shard's score depends on the key, its number and its weight alone. So a new shard only takes keys, and a shard
    that goes only gives its own away. The share of a shard is its weight over all weights.
    """
    scores = [
        F.struct(shard_score(key, i, w).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*scores))["shard"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, overhead: int = 16
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and, for a second list of weights, ``grown_shard``.

    The key is doc_id; a null doc_id is a key as well, so rows that repeat a key share a shard. ``size`` is the UTF-8
    length of the text plus ``overhead`` (a null text has none), ``text_crc32`` that of the text (0 for null or empty).
    ``slot`` numbers the rows of a shard without gaps, by a hash of the key, then key and size; equal rows are numbered
    in any order. Extra columns are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    content = F.coalesce(F.col("text"), F.lit(""))
    buckets = shuffle_partitions(docs.sparkSession)
    placed = docs.select(
        "doc_id",
        (F.octet_length(content) + overhead).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        rendezvous_shard(key, weights).alias("shard"),
        *([rendezvous_shard(key, grown).alias("grown_shard")] if grown else []),
        bucket_of(key, buckets=buckets).alias("bucket"),
    )
    written = staged(placed, "shards")
    numbered = with_prefix_sum(
        written, ["shard"], "bucket", ["doc_id", "size", "text_crc32"], F.lit(1).cast("long"), "slot"
    )
    return numbered.drop("bucket")
