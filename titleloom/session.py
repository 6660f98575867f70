"""Session defaults and the shared folder for written intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "titleloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators were planned for. On a cluster pass no master."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A title is few bytes and much work, so small shuffle partitions are worth a task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Written intermediate results go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: the one the cluster names, or on one machine a new one where none is named."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or "local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="titleloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: readers take only their columns, lineage ends here."""
    path = new_shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
