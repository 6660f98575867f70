"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.session import written_once

# The sketch returns a key per shuffle partition, since no more can exceed a partition's share: at least the first
# number, and no more than the second, so the table of hot keys can always be broadcast. It tracks four times as many.
HOT_KEYS = 2048
MOST_HOT_KEYS = 100_000
# Rows that equal each other are counted, and come back in pieces of this many.
PIECE = 10_000
# Tasks hand in their sketches in this many groups first, so that no task reads the sketches of all others.
SKETCH_GROUPS = 512
SALTS = 16
# A lookup within both bounds is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Cells per task for the pairs of a many-to-many join: enough that their chance placement evens out.
CELLS = 8

_HASH, _SALT, _REPEATS, _COUNT = "__hash", "__salt", "__repeats", "__count"
_ROWS, _COLUMNS, _ROW, _COLUMN = "__rows", "__columns", "__row", "__column"


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def frequent_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__hash, __count, n``: about how often the most frequent keys stand, and the number of all rows.

    Frequencies come from a sketch kept per task; they only decide how work is spread, never what a join returns.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(max(HOT_KEYS, tasks), MOST_HOT_KEYS)
    per_group = (
        rows.select(_hash(keys).alias(_HASH), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate({_HASH}, {4 * most})").alias("sketch"), F.count("*").alias("n"))
    )
    # Grouped by a constant, so that no rows give no group: an empty sketch cannot be read.
    top = per_group.groupBy(F.lit(0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {4 * most})").alias("sketch"), F.sum("n").alias("n")
    )
    return top.select("n", F.expr(f"explode(approx_top_k_estimate(sketch, {most}))").alias("top")).select(
        F.col("top.item").alias(_HASH), F.col("top.count").alias(_COUNT), "n"
    )


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__hash, __repeats`` of keys too frequent for one task: each piece is about as large as an average partition."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        frequent_keys(rows, keys)
        .select(_HASH, F.ceil(F.col(_COUNT) * tasks / F.col("n")).cast("int").alias(_REPEATS))
        .filter(F.col(_REPEATS) > 1)
    )


def key_grid(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__hash, __rows, __columns`` of keys whose pairs, or whose rows of one side, are too many for one task.

    A key with ``a`` rows on the left and ``b`` on the right is cut into cells of about equal work: the left is dealt to
    ``__rows`` parts, the right to ``__columns`` parts, and each cell joins one part with one part. Parts
    are cut as ``a : b``, which moves the fewest rows for that many cells. A key that a sketch does not name is rare on
    that side and counts once. Only shares count, so both sides may be samples.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(max(HOT_KEYS, tasks), MOST_HOT_KEYS)
    a = frequent_keys(left, keys).toDF(_HASH, "a", "n")
    b = frequent_keys(right, keys).toDF(_HASH, "b", "m")
    # Small by construction: at most ``most`` keys a side. Written, since both sides of the join read the result.
    both = written_once(
        a.join(b.hint("merge"), _HASH, "full").select(
            _HASH, F.coalesce("a", F.lit(1)).alias("a"), F.coalesce("b", F.lit(1)).alias("b"), "n", "m"
        ),
        "frequent-keys",
    )
    totals = both.agg(F.sum(F.col("a").cast("double") * F.col("b")), F.max("n"), F.max("m")).first()
    pairs, n, m = totals[0] or 0.0, totals[1] or 0, totals[2] or 0
    # Keys that no sketch names make pairs too, about as many as there are rows.
    share = max(1.0, (pairs + n + m) / (tasks * CELLS))
    cells = F.greatest(F.lit(1.0), F.ceil(F.col("a").cast("double") * F.col("b") / share))
    by_pairs = F.least(cells, F.ceil(F.sqrt(cells * F.col("a") / F.col("b"))))
    by_size = F.ceil(F.col("a") * tasks / F.lit(max(1, n)))
    grid = both.select(_HASH, "a", "b", cells.alias("cells"), F.greatest(by_pairs, by_size).cast("int").alias(_ROWS))
    columns = F.greatest(F.ceil(F.col("cells") / F.col(_ROWS)), F.ceil(F.col("b") * tasks / F.lit(max(1, m))))
    return (
        grid.select(_HASH, _ROWS, columns.cast("int").alias(_COLUMNS))
        .filter((F.col(_ROWS) > 1) | (F.col(_COLUMNS) > 1))
    )


def _spread(rows: DataFrame, keys: Sequence[str], spread: Sequence[str] | None) -> Column:
    """A number from the contents of a row: a task that runs again gives every row the same one."""
    # Spark hashes every type but maps.
    spread = spread or [c for c, kind in rows.dtypes if c not in keys and "map<" not in kind] or list(keys)
    return F.xxhash64(F.lit("salt"), *spread)


def join_hot(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Join many rows to a lookup with at most one row per key, whatever the key frequencies.

    Rows of hot keys are spread over as many tasks as they need by the ``spread`` columns (all others than the
    keys unless named) and only the lookup rows of those keys are repeated; all other rows are joined as usual.
    ``how`` is ``inner`` or ``left``. With a lookup of keys alone an inner join is a semi join. Rows of keys alone,
    which hold nothing to spread them by, are counted, joined once per key and repeated.
    """
    if not spread and set(rows.columns) <= set(keys):
        return _join_counted(rows, lookup, keys, how)
    hot = F.broadcast(hot_keys(rows, keys))
    number = _spread(rows, keys, spread)
    salted = (
        rows.withColumn(_HASH, _hash(keys))
        .join(hot, _HASH, "left")
        .withColumn(_SALT, F.when(F.col(_REPEATS).isNull(), 0).otherwise(F.pmod(number, F.col(_REPEATS)).cast("int")))
        .drop(_HASH, _REPEATS)
    )
    repeated = (
        lookup.withColumn(_HASH, _hash(keys))
        .join(hot, _HASH, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_REPEATS), F.lit(1)) - 1)))
        .drop(_HASH, _REPEATS)
    )
    return _merged(salted, repeated, [*keys, _SALT], how).drop(_SALT)


def join_both_hot(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by_left: Sequence[str],
    by_right: Sequence[str],
    seen: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """An inner join of two sides that may both repeat a key many times.

    Keys with many pairs are cut into a grid of cells (``key_grid``): a left row goes to one row of the grid, by the
    contents of ``by_left``, and to all its columns; a right row to one column, by ``by_right``, and to all rows. Each
    pair meets in one cell. All other keys are joined as usual. Both sides are read twice, unless ``seen`` has samples
    of them to count keys in.
    """
    grid = F.broadcast(written_once(key_grid(*(seen or (left, right)), keys), "grid"))

    def dealt(rows: DataFrame, own: str, parts: str, spread: Sequence[str], other: str, others: str) -> DataFrame:
        number = F.pmod(F.xxhash64(F.lit("cell"), *spread), F.coalesce(F.col(parts), F.lit(1)))
        return (
            rows.withColumn(_HASH, _hash(keys))
            .join(grid, _HASH, "left")
            .withColumn(own, number.cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1)))
            .drop(_HASH, _ROWS, _COLUMNS)
        )

    cells = [*keys, _ROW, _COLUMN]
    on_left = dealt(left, _ROW, _ROWS, by_left, _COLUMN, _COLUMNS)
    on_right = dealt(right, _COLUMN, _COLUMNS, by_right, _ROW, _ROWS)
    return _merged(on_left, on_right, cells, "inner").drop(_ROW, _COLUMN)


def _join_counted(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count("*").alias(_REPEATS))
    joined = _merged(counted, lookup, keys, how)
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col(_REPEATS) - 1) / PIECE))
    cut = joined.withColumn(_SALT, F.explode(pieces)).repartition(*keys, _SALT)
    size = F.least(F.lit(PIECE), F.col(_REPEATS) - F.col(_SALT) * PIECE)
    return cut.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop(_REPEATS, _SALT, "__one")


def keep_hot(rows: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is among the ids: a semi join that stands frequent keys."""
    return join_hot(rows, ids.select(*keys).distinct(), keys, "inner").select(*rows.columns)


def _merged(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A sort-merge join, whatever the planner thinks of the sizes.

    Adaptive planning judges a side by its compressed shuffle size. Rows with many repeats compress so well
    that it would broadcast millions of them.
    """
    return rows.join(lookup.hint("merge"), list(keys), how)


class Lookup(NamedTuple):
    """A lookup table in the shared folder, and whether it was measured to be small enough to broadcast."""

    table: DataFrame
    small: bool

    def select(self, *columns: Column | str) -> Lookup:
        """Some columns of the lookup; what was small stays small."""
        return Lookup(self.table.select(*columns), self.small)


def _bytes(table: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(0).cast("long")
    for name, kind in table.dtypes:
        if kind == "string":
            size = F.length(name)
        elif kind in ("array<double>", "array<float>", "array<int>", "array<bigint>"):
            size = F.size(name) * 8
        elif kind.startswith(("array", "struct", "map")):
            size = F.length(F.to_json(F.struct(name)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0)) + 8
    return total


def written_lookup(lookup: DataFrame) -> Lookup:
    """Write a lookup once to the shared folder and measure it against both broadcast bounds."""
    written = written_once(lookup, "lookup")
    size = written.agg(F.count("*"), F.coalesce(F.sum(_bytes(written)), F.lit(0))).first()
    return Lookup(written, size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES)


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame | Lookup,
    keys: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Join rows that are costly to compute to a lookup that is usually small.

    A lookup within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` is broadcast, beyond that the join is salted.
    """
    if not isinstance(lookup, Lookup):
        lookup = written_lookup(lookup)
    if lookup.small:
        return rows.join(F.broadcast(lookup.table), list(keys), how)
    return join_salted(rows, lookup.table, keys, how, spread=spread)


def join_salted(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Join rows that are costly to compute twice to a much smaller lookup.

    No look at the key frequencies: every key is spread over ``salts`` tasks and the lookup is repeated.
    """
    salted = rows.withColumn(_SALT, F.pmod(_spread(rows, keys, spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _merged(salted, repeated, [*keys, _SALT], how).drop(_SALT)


def first_per_key(
    rows: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], rank: str = "rank", groups: int = 64
) -> DataFrame:
    """The first ``n`` rows per key in a given order, with their rank from 1.

    Each input partition keeps its own first ``n`` before anything is shuffled (Spark plans this for a
    bounded row number). The survivors are ranked in ``groups`` groups per key and then once more, so the
    last ranking of a key sees at most ``n * groups`` rows however many the key has.
    """
    by_group = Window.partitionBy(*keys, "__group").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("__group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        .withColumn(rank, F.row_number().over(by_group))
        .filter(F.col(rank) <= n)
        .drop("__group")
        .withColumn(rank, F.row_number().over(by_key))
        .filter(F.col(rank) <= n)
    )
