"""Checks of rule lists: replaced terms that come up again, and lines that stand for several roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.functions.text import strip
from titleloom.operators.matching import first_match, match_pieces
from titleloom.operators.normalize import Steps
from titleloom.operators.skew import join_hot
from titleloom.sources.gazetteers import Gazetteer

# Lines are compared inside ranges of this many lines first, then range by range.
RANGE_LINES = 4096


def _pieces(text: Column) -> Column:
    return F.split(strip(text), ",")


def _sequences(piece: Column, longest: int) -> Column:
    """Texts of up to ``longest`` neighbouring words of a piece."""
    return F.transform(
        F.array(F.struct(F.split(piece, " ").alias("w"))),
        lambda p: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.size(p["w"]))),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.size(p["w"]) - n + 1),
                    lambda at: F.array_join(F.slice(p["w"], at, n), " "),
                ),
            )
        ),
    )[0]


def rule_order_lint(lines: DataFrame) -> DataFrame:
    """``line, term, later_lines, next_line``: terms a line replaces that later lines still use.

    Rules run in order, so those later lines never see the term. Instead of one row per pair of lines, a term
    is reported with the number of later lines and the first of them. Lines of a term are counted inside
    ranges of lines and then over the ranges, so a term on very many lines is no single group.
    """
    pieces = lines.select("line", _pieces(F.col("text")).alias("pieces"))
    replaced = (
        pieces.filter(F.size("pieces") >= 2)
        .select("line", F.explode(F.expr("slice(pieces, 2, size(pieces))")).alias("term"))
        .distinct()
    )
    longest = replaced.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    used = pieces.select("line", F.explode("pieces").alias("piece")).select(
        "line", F.explode(_sequences(F.col("piece"), longest)).alias("term")
    )
    # A line that replaces a term also holds it, so one row per line and term serves both sides.
    held = (
        used.withColumn("replaces", F.lit(False))
        .unionByName(replaced.withColumn("replaces", F.lit(True)))
        .groupBy("term", "line")
        .agg(F.bool_or("replaces").alias("replaces"))
        .withColumn("range", F.floor(F.col("line") / RANGE_LINES))
    )
    after = Window.partitionBy("term", "range").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    inside = held.withColumn("later", F.count("*").over(after)).withColumn("next", F.min("line").over(after))
    ranges = held.groupBy("term", "range").agg(
        F.count("*").alias("n"), F.min("line").alias("first"), F.bool_or("replaces").alias("replaces")
    )
    following = Window.partitionBy("term").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    beyond = ranges.select(
        "term", "range",
        F.coalesce(F.sum("n").over(following), F.lit(0)).alias("beyond"),
        F.min("first").over(following).alias("beyond_first"),
    )
    return (
        join_hot(inside.filter("replaces"), beyond, ["term", "range"], "inner")
        .select(
            "line", "term",
            (F.col("later") + F.col("beyond")).alias("later_lines"),
            F.coalesce("next", "beyond_first").alias("next_line"),
        )
        .filter(F.col("later_lines") > 0)
    )


def rule_ambiguity_lint(
    lines: DataFrame,
    catalogue: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """``line, role_ids``: lines whose terms lead to more than one role, with the roles in order of their terms."""
    terms = lines.select("line", F.posexplode(_pieces(F.col("text"))).alias("at", "title"))
    roles = first_match(match_pieces(terms, catalogue, lists, steps, vocabulary, verbs=verbs, dictionary=dictionary))
    found = join_hot(terms, roles, ["title"], "inner", spread=["line", "at"])
    # A line holds at most one role per term.
    return (
        found.groupBy("line")
        .agg(F.array_sort(F.collect_list(F.struct("at", "role_id"))).alias("found"))
        .select("line", F.array_distinct(F.col("found.role_id")).alias("role_ids"))
        .filter(F.size("role_ids") > 1)
    )


def repeated_bases(rules: DataFrame) -> DataFrame:
    """``base, lines``: bases (``line, base``) listed on several lines, of which only the last one's terms count."""
    return rules.groupBy("base").agg(F.count("*").alias("lines")).filter(F.col("lines") > 1)
