"""Run the title chain and the role match over arriving files.

The chain keeps no state, so a plain streaming select runs it. Matching groups rows and therefore runs per
micro-batch. Each batch writes a folder of its own, named by the batch: a batch that is run again after a
failure replaces what it wrote, and readers take the last batch of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titleloom.operators.normalize import Steps, normalize_distinct
from titleloom.plans.routines import with_first_role
from titleloom.session import new_shared_path
from titleloom.sources.gazetteers import Gazetteer


def read_title_stream(
    spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)


def normalize_stream(
    titles: DataFrame, lists: Gazetteer, path: str, checkpoint: str, steps: Steps = Steps(correct_typos=False)
) -> StreamingQuery:
    """Append ``title, norm_title, seniorities, hierarchies`` of each arriving title; works off what is there.

    Corrections need a grouping and are left to the batch routine.
    """
    done = normalize_distinct(titles.select("title"), lists, Steps(**{**steps.__dict__, "correct_typos": False}))
    return (
        done.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def match_stream(
    rows: DataFrame,
    keys: list[str],
    catalogue: DataFrame,
    lists: Gazetteer,
    path: str,
    checkpoint: str,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
) -> StreamingQuery:
    """Write ``keys, cargo_id`` of each arriving row with a matched title, one folder per micro-batch."""

    # Read by every batch: written once, before the first.
    written = new_shared_path(catalogue.sparkSession, "catalogue")
    catalogue.write.parquet(written)
    roles = catalogue.sparkSession.read.schema(catalogue.schema).parquet(written)

    def write(batch: DataFrame, batch_id: int) -> None:
        found = with_first_role(
            batch.select(*keys, "title"), roles, lists, steps, vocabulary, "inner", verbs, dictionary
        )
        flags = found.groupBy(*keys).agg(F.min("role_id").alias("cargo_id"))
        flags.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_flags(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``keys, cargo_id`` by the last batch that wrote each key: the upsert of all batches, done at reading."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("cargo_id", "batch").alias("cargo_id"))
