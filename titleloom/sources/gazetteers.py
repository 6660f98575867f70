"""Rule and word lists: text files with one entry per line, or DataFrames of ``(line, text)``.

Lists are configuration. ``*_of`` functions parse a DataFrame of lines; ``load_gazetteer`` turns the parsed
tables of a folder into a ``Gazetteer`` for the title chain and refuses more than ``MAX_ENTRIES`` entries.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.phrase_rules import PhraseRule
from titleloom.functions.text import split_words, strip
from titleloom.sources.tables import constant_table

MAX_ENTRIES = 100_000
# Above this size a verb table is joined (see ``operators.normalize.replace_words``), not inlined.
MAX_INLINE_VERBS = 2_000


@dataclass(frozen=True)
class Gazetteer:
    """Lists the title chain works with. All of them may be empty."""

    stopwords: frozenset[str] = frozenset()
    special_terms: tuple[PhraseRule, ...] = ()
    thesaurus: tuple[PhraseRule, ...] = ()
    gender: tuple[PhraseRule, ...] = ()
    plural: tuple[tuple[str, str], ...] = ()
    conjugation: dict[str, str] = field(default_factory=dict)
    locations: frozenset[str] = frozenset()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with their number. Gazetteer files are small, so a file is one row here."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "text")).select(
        (F.col("line") + 1).alias("line"), "text"
    )


def _entries(lines: DataFrame) -> DataFrame:
    """Lines that are no comment, cut at commas: ``line, tokens``."""
    return lines.filter(~F.col("text").startswith("#")).select(
        "line", F.transform(F.split(F.lower("text"), ","), strip).alias("tokens")
    )


def stopwords_of(lines: DataFrame) -> DataFrame:
    """``word``: listed words without the always-kept ones, with the always-added ones."""
    listed = lines.filter(~F.col("text").startswith("#")).select(strip(F.col("text")).alias("word"))
    added = constant_table(lines.sparkSession, "word string", [(w,) for w in fv.STOPWORDS_ADDED])
    return (
        listed.filter((F.col("word") != "") & ~F.col("word").isin(list(fv.STOPWORDS_KEPT)))
        .union(added)
        .distinct()
    )


def _most_words_first(variations: Column) -> Column:
    keyed = F.transform(variations, lambda v: F.struct((-F.size(split_words(v))).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda k: k["v"])


def phrase_rules_of(lines: DataFrame) -> DataFrame:
    """``line, base, variations``: one rule per base, at its first line, with the variations of its last.

    Variations are distinct; those with more words come first.
    """
    return (
        _entries(lines)
        .filter(F.size("tokens") >= 2)
        .select("line", F.col("tokens")[0].alias("base"), F.expr("slice(tokens, 2, size(tokens))").alias("v"))
        .groupBy("base")
        .agg(F.min("line").alias("line"), F.max_by("v", "line").alias("v"))
        .select("line", "base", _most_words_first(F.array_distinct("v")).alias("variations"))
    )


def conjugation_of(lines: DataFrame) -> DataFrame:
    """``variation, base``: of several bases for one variation the last listed wins."""
    return (
        _entries(lines)
        .filter(F.size("tokens") >= 2)
        .select(
            "line", F.col("tokens")[0].alias("base"),
            F.posexplode(F.expr("slice(tokens, 2, size(tokens))")).alias("at", "variation"),
        )
        .groupBy("variation")
        .agg(F.max_by("base", F.struct("line", "at")).alias("base"))
    )


def plural_rules_of(lines: DataFrame) -> DataFrame:
    """``line, suffix, replacement``: lines of exactly two tokens."""
    return (
        _entries(lines)
        .filter(F.size("tokens") == 2)
        .select("line", F.col("tokens")[0].alias("suffix"), F.col("tokens")[1].alias("replacement"))
    )


def rule_words_of(lines: DataFrame, stopwords: DataFrame) -> DataFrame:
    """``word``: every word of a rule list that is no stopword."""
    # A comma ends a word as white space does, so a line is cut once.
    entries = lines.filter(~F.col("text").startswith("#"))
    words = entries.select(F.explode(split_words(F.lower("text"), ",")).alias("word"))
    return words.distinct().join(stopwords, "word", "left_anti")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return stopwords_of(read_lines(spark, path))


def read_phrase_rules(spark: SparkSession, path: str) -> DataFrame:
    return phrase_rules_of(read_lines(spark, path))


def read_conjugation_rules(spark: SparkSession, path: str) -> DataFrame:
    return conjugation_of(read_lines(spark, path))


def read_plural_rules(spark: SparkSession, path: str) -> DataFrame:
    return plural_rules_of(read_lines(spark, path))


GAZETTEER_FILES = (
    "stopwords",
    "mapping_special_character_terms",
    "mapping_thesaurus",
    "mapping_gender",
    "mapping_plural",
    "mapping_conjugation",
    "locations",
)


def _as_entries(name: str, lines: DataFrame, stopwords: DataFrame | None) -> DataFrame:
    """A parsed list in one common form: ``name, line, entry, others``."""
    none = F.array().cast("array<string>")
    if name == "stopwords":
        parsed = stopwords_of(lines).select(F.lit(0).alias("line"), F.col("word").alias("entry"), none.alias("others"))
    elif name == "locations":
        no_words = constant_table(lines.sparkSession, "word string", [])
        found = rule_words_of(lines, no_words if stopwords is None else stopwords_of(stopwords))
        parsed = found.select(F.lit(0).alias("line"), F.col("word").alias("entry"), none.alias("others"))
    elif name == "mapping_plural":
        parsed = plural_rules_of(lines).select("line", F.col("suffix").alias("entry"), F.array("replacement").alias("others"))
    elif name == "mapping_conjugation":
        parsed = conjugation_of(lines).select(
            F.lit(0).alias("line"), F.col("variation").alias("entry"), F.array("base").alias("others")
        )
    else:
        parsed = phrase_rules_of(lines).select("line", F.col("base").alias("entry"), F.col("variations").alias("others"))
    return parsed.select(F.lit(name).alias("name"), "line", "entry", "others")


def gazetteer_of(files: dict[str, DataFrame]) -> Gazetteer:
    """A ``Gazetteer`` from the lines (``line, text``) of some or all ``GAZETTEER_FILES``.

    The lists are configuration of known size: all of them come to the driver at once, or none.
    """
    parts = [_as_entries(name, lines, files.get("stopwords")) for name, lines in files.items()]
    rows = reduce(DataFrame.unionByName, parts).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a gazetteer may hold at most {MAX_ENTRIES} entries")
    rows.sort(key=lambda r: r.line)

    def of(name: str) -> list:
        return [r for r in rows if r.name == name]

    def rules(name: str) -> tuple[PhraseRule, ...]:
        return tuple(PhraseRule(r.entry, tuple(r.others)) for r in of(name))

    return Gazetteer(
        stopwords=frozenset(r.entry for r in of("stopwords")),
        special_terms=rules("mapping_special_character_terms"),
        thesaurus=rules("mapping_thesaurus"),
        gender=rules("mapping_gender"),
        plural=tuple((r.entry, r.others[0]) for r in of("mapping_plural")),
        conjugation={r.entry: r.others[0] for r in of("mapping_conjugation")},
        locations=frozenset(r.entry for r in of("locations")),
    )


def load_gazetteer(spark: SparkSession, folder: str, names: Iterable[str] = GAZETTEER_FILES) -> Gazetteer:
    """The gazetteer files (``<name>.txt``) of a folder that all executors can read."""
    return gazetteer_of({name: read_lines(spark, f"{folder}/{name}.txt") for name in names})


def packaged_lines(spark: SparkSession, name: str) -> DataFrame:
    """``line, text`` of one of the small sample lists that come with the package."""
    text = resources.files("titleloom").joinpath("gazetteers", f"{name}.txt").read_text("utf-8")
    return constant_table(spark, "line int, text string", enumerate(text.splitlines(), 1))


def sample_gazetteer(spark: SparkSession) -> Gazetteer:
    return gazetteer_of({name: packaged_lines(spark, name) for name in GAZETTEER_FILES})
