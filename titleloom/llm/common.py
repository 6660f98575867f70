"""Helpers of the corpus operators: intermediate tables, prefix sums without a global order, joins that stand hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleloom.session import new_shared_path


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Spark's setting for shuffle files that go when the execution they belong to has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(rows: DataFrame, name: str, compression: str | None = None, drop_shuffles: bool = False) -> DataFrame:
    """The rows, written once to the shared folder and read again: fixed values, short lineage, no lost work.

    With ``drop_shuffles`` the shuffle files of the write go as soon as it is done, not when the driver collects garbage.
    """
    path, conf = new_shared_path(rows.sparkSession, name), rows.sparkSession.conf
    was = conf.get(DROP_SHUFFLES, None)
    if drop_shuffles:
        conf.set(DROP_SHUFFLES, "true")
    try:
        rows.write.parquet(path, compression=compression)
    finally:
        if drop_shuffles:
            conf.set(DROP_SHUFFLES, was) if was is not None else conf.unset(DROP_SHUFFLES)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(*keys: Column, buckets: int) -> Column:
    """A bucket that depends on the values of the keys only."""
    return F.pmod(F.xxhash64(*keys, F.lit(0x5EED)), F.lit(buckets)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where the body names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def equal_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality that also holds between nulls."""
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(right[key])
    return same


def with_prefix_sum(
    rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Rows with the sum of ``value`` over the rows of their group that stand before them.

    Rows of a group stand by ``bucket``, then by ``order``. Only the rows of one bucket meet in a task; what lies
    before a bucket comes from one total per group and bucket. The rows are read twice: pass a written table.
    """
    totals = rows.groupBy(*group, bucket).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__{c}") for c in [*group, bucket]],
        F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.lit(True)
    for c in [*group, bucket]:
        same = same & placed[c].eqNullSafe(offsets[f"__{c}"])
    return placed.join(offsets, same).select(*rows.columns, (F.col("__inside") + F.col("__offset")).alias(name))


def join_counted(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key and, in ``count``, the number of rows that hold the key.

    Keys with more than a share of a task are joined by broadcast, so that none of their rows moves: there can be
    no more of them than four per shuffle partition. All others are joined by a shuffle. Both inputs are read
    more than once: pass written tables. Columns beside the keys must have different names.
    """
    spark = rows.sparkSession
    total = table.agg(F.sum(count)).first()[0] or 0
    share = max(1.0, total / (4 * shuffle_partitions(spark)))
    renamed = table.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in table.columns])
    hot, rest = renamed.filter(F.col(count) > share), renamed.filter(F.col(count) <= share)

    def same(side: DataFrame) -> Column:
        condition = F.lit(True)
        for key in keys:
            condition = condition & rows[key].eqNullSafe(side[f"__{key}"])
        return condition

    by_broadcast = rows.join(F.broadcast(hot), same(hot))
    others = rows.join(F.broadcast(hot.select(*[f"__{k}" for k in keys])), same(hot), "left_anti")
    names = [*rows.columns, *[c for c in table.columns if c not in keys]]
    return by_broadcast.select(*names).unionByName(others.join(rest, same(rest), how).select(*names))
