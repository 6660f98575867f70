"""Keyed state across micro-batches: a stream of roles keeps one current row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titleloom.operators.keyed_tables import BUCKETS, rewrite_touched, write_keyed_table


def latest_roles(updates: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """``keys, cargo_id`` of the keys that arrive, with the role of their last position so far.

    The state store holds one row per key. Of equal positions the lowest role counts. So rows that arrive again, or
    late, change nothing. Null keys and positions are skipped, a null role counts as 0.
    """
    role = F.coalesce(F.col("cargo_id").cast("long"), F.lit(0))
    wanted = updates.dropna(subset=[*keys, position]).select(*keys, F.struct(position, (-role).alias("below")).alias("last"))
    return wanted.groupBy(*keys).agg(F.max("last").alias("last")).select(*keys, (-F.col("last.below")).alias("cargo_id"))


def upsert_stream(
    updates: DataFrame,
    keys: Sequence[str],
    position: str,
    path: str,
    checkpoint: str,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the table at ``path`` (``keys, cargo_id``, one row per key) at the last role of each key.

    Each micro-batch rewrites only the buckets that hold keys with another role, so reading costs the same after any
    number of batches. A batch that runs again after a stop leaves the table as it is. Works off what is there.
    """

    def merged(table: DataFrame, changes: DataFrame) -> DataFrame:
        return table.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)

    def write(batch: DataFrame, batch_id: int) -> None:
        if _has_rows(batch.sparkSession, path):
            rewrite_touched(batch.sparkSession, path, batch, keys, merged, buckets)
        else:
            write_keyed_table(batch, path, keys, buckets)

    return (
        latest_roles(updates, keys, position)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether something was written to the path: a folder without files has no schema."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False
