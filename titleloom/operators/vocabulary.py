"""Which words count as correctly spelt, and how often each was seen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.text import regex_literal, strip
from titleloom.sources.gazetteers import rule_words_of
from titleloom.sources.tables import constant_table


def distinct_titles(main: DataFrame, similar: DataFrame) -> DataFrame:
    return main.select("title").unionByName(similar.select("title")).distinct()


def word_breaks() -> str:
    """Regex for everything that ends a word in a phrase: space, separators and special characters."""
    single = "".join(regex_literal(b) for b in (" ", *fv.SPACE_CHARACTERS, *fv.SPECIAL_CHARACTERS))
    return "|".join([*map(regex_literal, fv.SPACE_SEQUENCES), f"[{single}]"])


def phrase_words(phrase: Column) -> Column:
    """Words of a phrase: stripped, lower case, at least ``MIN_WORD_LENGTH`` long."""
    pieces = F.transform(F.split(phrase, word_breaks()), lambda w: F.lower(strip(w)))
    return F.filter(pieces, lambda w: F.length(w) >= fv.MIN_WORD_LENGTH)


def extract_words(phrases: DataFrame, phrase: str, stopwords: Iterable[str]) -> DataFrame:
    """``word, freq`` over all phrases, without stopwords."""
    words = phrases.select(F.explode(phrase_words(F.col(phrase))).alias("word"))
    stopwords = sorted(stopwords)
    if stopwords:
        words = words.filter(~F.col("word").isin(stopwords))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def merge_word_freq(*tables: DataFrame) -> DataFrame:
    """Add up ``word, freq`` tables."""
    return reduce(DataFrame.unionByName, tables).groupBy("word").agg(F.sum("freq").alias("freq"))


def build_dictionary(*tables: DataFrame, words: Iterable[str] = ()) -> DataFrame:
    """Distinct ``word`` of tables with that column, of the fixed word lists and of further words."""
    fixed = sorted({*words, *fv.SENIORITIES, *fv.HIERARCHIES})
    constant = constant_table(tables[0].sparkSession, "word string", [(w,) for w in fixed])
    parts = [t.select("word") for t in tables] + [constant]
    return reduce(DataFrame.unionByName, parts).distinct()


def location_words(location_lines: DataFrame, titles: DataFrame, stopwords: DataFrame) -> DataFrame:
    """``word``: words of location names that no role title uses."""
    used = (
        titles.select(F.explode(phrase_words(F.col("title"))).alias("word"))
        .distinct()
        .join(stopwords, "word", "left_anti")
    )
    return rule_words_of(location_lines, stopwords).join(used, "word", "left_anti")
