"""Mixing sources to token targets by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import bucket_of, join_counted, shuffle_partitions, staged, with_prefix_sum

ROUNDS = 60
CLOSE = 1e-10


def capped_targets(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """``sources`` (``source, weight, source_size``) with ``target``: ``total`` shared by weight, at most ``cap`` sizes each.

    What lies above a cap is shared again by weight among the others until none is above. Only sums come to the driver.
    """
    limit = F.col("source_size") * cap
    unit, full = 0.0, -1
    while True:
        is_full = limit <= F.col("weight") * unit
        row = sources.agg(
            F.sum(F.when(is_full, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(is_full.cast("int")).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == full or not row["weights"]:
            break
        full, unit = row["n"], max(0.0, total - row["held"]) / row["weights"]
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(unit)))


def balanced_tilts(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``source, tilt``: the dual solution under which the rates ``min(cap, prior * exp(tilt))`` meet the targets.

    Among all rates that give each source its target and stay below the cap, these are nearest to the prior in
    relative entropy, weighted by tokens. ``cells`` (``source, prior, tokens``) are the sums of all documents; each
    Newton round adds up gradient and curvature of the dual over them by source. A bracket around each tilt makes up
    for steps where the cap has flattened the dual. Rounds end when every source is met.
    """
    state = staged(
        targets.filter("source_size > 0").select(
            F.col("source").alias("s"), "target", F.lit(0.0).alias("tilt"),
            F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"),
        ),
        "tilts",
    )
    for _ in range(ROUNDS):
        rate = F.col("prior") * F.exp("tilt")
        moments = (
            cells.join(state, cells["source"].eqNullSafe(state["s"]))
            .groupBy("s")
            .agg(
                F.sum(F.col("tokens") * F.least(rate, F.lit(cap))).alias("mass"),
                F.sum(F.when(rate < cap, F.col("tokens") * rate).otherwise(0.0)).alias("curve"),
                *[F.first(c).alias(c) for c in ("target", "tilt", "low", "high")],
            )
        )
        gap = F.col("mass") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.when(F.col("curve") > 0, F.col("curve"))
        met = F.abs(gap) <= F.greatest(F.col("target"), F.lit(1.0)) * CLOSE
        state = staged(
            moments.select("s", "target", "tilt", low.alias("low"), high.alias("high"), step.alias("step"), met.alias("met"))
            .select(
                "s", "target", "low", "high", "met",
                F.when(F.col("met"), F.col("tilt"))
                .when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step"))
                .otherwise((F.greatest(F.col("low"), F.lit(-60.0)) + F.col("high")) / 2)
                .alias("tilt"),
            ),
            "tilts",
        )
        if state.filter("not met").isEmpty():
            break
    return state.select(F.col("s").alias("source"), "tilt")


def mix_sources(
    docs: DataFrame,
    size: Column,
    cycle: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    prior: Column | None = None,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Every document with how much of it a mix of given source weights takes.

    Returns the ``keys`` (``doc_id`` and what else tells rows apart) and ``source, size, source_size, target, rate,
    taken, copies, part``. Sources in code-point order,
    null last as a source of its own, have the weights of ``cycle`` in turn and share ``share`` times all
    tokens; no target is above ``cap`` times the source. ``prior`` is a positive rate per document (1 if not given).
    The balanced rates are rounded into ``copies`` whole copies: the whole part of the rate for all, and one more
    for documents in an order by hash until the source has what its fractions add up to; the last of these gives only
    its first ``part`` words, so a source's taken words are its target to the nearest word. ``taken`` is
    ``copies * size + part``.
    A null size counts as 0, a source without tokens has target 0. Rows equal in all values may swap places. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    rows = staged(
        docs.select(
            *keys,
            "source",
            F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
            (prior.cast("double") if prior is not None else F.lit(1.0)).alias("prior"),
            bucket_of(F.col("doc_id"), F.col("source"), buckets=shuffle_partitions(spark)).alias("bucket"),
            F.xxhash64("doc_id", F.lit(10)).alias("order"),
        ),
        "sizes",
    )
    cells = staged(
        rows.groupBy("source", "prior").agg(F.sum("size").alias("tokens"), F.count("*").alias("documents")), "cells"
    )
    # One row per source: their number is that of the weights to be given, not of the documents.
    named = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("documents").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    sources = staged(named.withColumn("weight", F.get(weights, place % len(cycle))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = staged(capped_targets(sources, share * total, cap), "targets")
    tilts = staged(balanced_tilts(cells, targets, cap), "balanced")
    table = targets.select("source", "source_size", "documents", "target").join(
        tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left"
    ).select("source", "source_size", "documents", "target", F.coalesce("tilt", F.lit(0.0)).alias("tilt"))
    rated = join_counted(rows, staged(table, "table"), ["source"], "documents").withColumn(
        "rate", F.least(F.lit(cap), F.col("prior") * F.exp("tilt"))
    )
    # A rate within rounding error of a whole number is that number.
    whole = F.floor(F.col("rate") + 1e-9).cast("long")
    fraction = F.greatest(F.lit(0.0), F.col("rate") - whole)
    shared = staged(rated.withColumn("whole", whole).withColumn("fraction", fraction), "rated")
    missing = staged(
        shared.groupBy("source")
        .agg(F.first("target").alias("t"), F.sum(F.col("whole") * F.col("size")).alias("base"), F.count("*").alias("rows"))
        .select("source", F.round(F.col("t") - F.col("base")).cast("long").alias("missing"), "rows"),
        "missing",
    )
    placed = staged(join_counted(shared, missing, ["source"], "rows"), "placed")
    open_size = F.when(F.col("fraction") > 0, F.col("size")).otherwise(F.lit(0).cast("long"))
    filled = with_prefix_sum(placed, ["source"], "bucket", ["order", *keys, "size"], open_size, "before")
    part = F.greatest(F.lit(0).cast("long"), F.least(open_size, F.col("missing") - F.col("before")))
    is_whole = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return (
        filled.withColumn("extra", part)
        .select(
            *keys, "source", "size", "source_size", "target", "rate",
            (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
            (F.col("whole") + is_whole.cast("long")).alias("copies"),
            F.when(is_whole, F.lit(0).cast("long")).otherwise(F.col("extra")).alias("part"),
        )
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word, with the white space between them."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")
