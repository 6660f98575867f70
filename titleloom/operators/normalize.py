"""The title chain: from free text to a normalized title, seniorities and hierarchies."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions import text as T
from titleloom.functions.phrase_rules import apply_phrase_rules
from titleloom.operators.skew import join_hot
from titleloom.operators.typos import correct_typos
from titleloom.sources.gazetteers import MAX_INLINE_VERBS, Gazetteer
from titleloom.sources.tables import constant_table


@dataclass(frozen=True)
class Steps:
    """Switches of the chain. Lower case, symbols, stopwords and accents always run."""

    correct_typos: bool = True
    remove_locations: bool = False
    conjugation: bool = True
    plural: bool = True
    gender: bool = True
    thesaurus: bool = True
    special_terms: bool = True


# Catalogue titles are taken as correctly spelt.
CATALOGUE_STEPS = Steps(correct_typos=False)


def cleaned(title: Column, lists: Gazetteer, steps: Steps = Steps()) -> Column:
    """Steps before the spelling correction: case, line breaks, special terms, symbols."""
    text = T.strip_line_breaks(T.lowercase(F.coalesce(title, F.lit(""))))
    if steps.special_terms:
        text = apply_phrase_rules(text, lists.special_terms)
    return T.drop_symbols(T.symbols_to_space(text))


def without_stopwords_and_accents(text: Column, lists: Gazetteer) -> Column:
    return T.strip_accents(T.remove_stopwords(text, lists.stopwords))


def reworded(text: Column, lists: Gazetteer, steps: Steps = Steps()) -> Column:
    """Steps after seniorities and hierarchies are read off: locations, verbs, plural, gender, synonyms."""
    if steps.remove_locations:
        text = T.remove_locations(text, lists.locations)
    if steps.conjugation:
        text = T.normalize_conjugation(text, lists.conjugation)
    if steps.plural:
        text = T.normalize_plural(text, lists.plural)
    if steps.gender:
        text = apply_phrase_rules(text, lists.gender)
    if steps.thesaurus:
        text = apply_phrase_rules(text, lists.thesaurus)
    return text


def computed_once(columns: Column) -> Column:
    """The fields of a struct as columns that later filters cannot be moved below.

    Spark moves a filter on a computed column under the projection and then computes the column twice; it
    does not do so through a generator.
    """
    return F.inline(F.array(columns))


def replace_words(rows: DataFrame, text: str, verbs: DataFrame, id_column: str) -> DataFrame:
    """Replace words of a text by their base from a table ``variation, base`` too large to inline."""
    words = rows.select(id_column, F.posexplode(T.split_words(F.col(text))).alias("at", "variation"))
    based = join_hot(words, verbs, ["variation"], "left", spread=[id_column, "at"])
    texts = based.groupBy(id_column).agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("base", "variation").alias("word")))).alias("words")
    ).select(id_column, F.array_join(F.col("words.word"), " ").alias("__text"))
    return (
        rows.join(texts, id_column, "left")
        .withColumn(text, F.coalesce("__text", F.lit("")))
        .drop("__text")
    )


def drop_words(rows: DataFrame, text: str, dropped: DataFrame, id_column: str) -> DataFrame:
    """Leave out the words of a text that a table ``word`` of any size holds. Each distinct word is looked up once."""
    words = rows.select(id_column, F.posexplode(T.split_words(F.col(text))).alias("at", "word"))
    hits = words.select("word").distinct().join(dropped.select("word").distinct(), "word", "left_semi")
    marked = join_hot(words, hits.withColumn("__drop", F.lit(True)), ["word"], "left", spread=[id_column, "at"])
    texts = marked.groupBy(id_column).agg(
        F.array_sort(F.collect_list(F.when(F.col("__drop").isNull(), F.struct("at", "word")))).alias("words")
    ).select(id_column, F.array_join(F.col("words.word"), " ").alias("__text"))
    return rows.join(texts, id_column, "left").withColumn(text, F.coalesce("__text", F.lit(""))).drop("__text")


def spelling_tables(
    lists: Gazetteer, vocabulary: DataFrame, verbs: DataFrame | None = None, dictionary: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (``word, freq``) and the dictionary (``word``) that titles are corrected with.

    Every word that a later step looks for is right as it is: stopwords, seniorities, hierarchies, verb forms and
    bases, locations, and the words of the special terms and the thesaurus. The last two are also words that others
    are corrected to, as often as the rules hold them.
    """
    spark = vocabulary.sparkSession
    terms = Counter(
        word
        for rule in (*lists.special_terms, *lists.thesaurus)
        for term in (rule.base, *rule.variations)
        for word in term.lower().split()
        if word not in lists.stopwords
    )
    targets = vocabulary.select("word", "freq").unionByName(
        constant_table(spark, "word string, freq long", sorted(terms.items()))
    )
    verb_words = () if verbs is not None else (*lists.conjugation, *lists.conjugation.values())
    right = sorted({*lists.stopwords, *lists.locations, *fv.SENIORITIES, *fv.HIERARCHIES, *verb_words, *terms})
    known = constant_table(spark, "word string", [(w,) for w in right])
    if verbs is not None:
        known = known.unionByName(verbs.select(F.explode(F.array("variation", "base")).alias("word")))
    if dictionary is not None:
        known = known.unionByName(dictionary.select("word"))
    return targets, known


def normalize_distinct(
    titles: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
    locations: DataFrame | None = None,
) -> DataFrame:
    """``title, norm_title, seniorities, hierarchies`` for distinct titles.

    Without a vocabulary nothing is shuffled. With one (``word, freq``), words outside it, outside the gazetteer
    and outside the ``dictionary`` (``word``) are corrected.
    ``verbs`` (``variation, base``) replaces the verb list of the gazetteer; a list too long to inline becomes
    such a table. ``locations`` (``word``, lower case) replaces the location list of the gazetteer, at any size.
    """
    if verbs is None and len(lists.conjugation) > MAX_INLINE_VERBS:
        verbs = constant_table(titles.sparkSession, "variation string, base string", sorted(lists.conjugation.items()))
    texts = titles.select("title", cleaned(F.col("title"), lists, steps).alias("text"))
    if steps.correct_typos and vocabulary is not None:
        right = spelling_tables(lists, vocabulary, verbs, dictionary)
        if locations is not None:
            right = right[0], right[1].unionByName(locations.select("word"))
        texts = correct_typos(texts, *right)
    texts = texts.select("title", without_stopwords_and_accents(F.col("text"), lists).alias("text")).select(
        "title",
        "text",
        T.extract_seniority(F.col("text")).alias("seniorities"),
        T.extract_hierarchy(F.col("text")).alias("hierarchies"),
    )
    if steps.remove_locations and locations is not None:
        texts = drop_words(texts, "text", locations, "title")
        steps = Steps(**{**steps.__dict__, "remove_locations": False})
    if steps.conjugation and verbs is not None:
        if steps.remove_locations:
            texts = texts.withColumn("text", T.remove_locations(F.col("text"), lists.locations))
        texts = replace_words(texts, "text", verbs, "title")
        steps = Steps(**{**steps.__dict__, "conjugation": False, "remove_locations": False})
    done = F.struct(reworded(F.col("text"), lists, steps).alias("norm_title"), "seniorities", "hierarchies")
    return texts.select("title", computed_once(done))


def normalize_title(
    rows: DataFrame,
    lists: Gazetteer,
    steps: Steps = Steps(),
    vocabulary: DataFrame | None = None,
    verbs: DataFrame | None = None,
    dictionary: DataFrame | None = None,
    locations: DataFrame | None = None,
) -> DataFrame:
    """Rows with a ``title``, plus ``norm_title, seniorities, hierarchies``.

    Every distinct title is worked on once. Null and empty titles give an empty text and empty lists.
    """
    titles = rows.select("title").filter(F.col("title") != "").distinct()
    done = normalize_distinct(titles, lists, steps, vocabulary, verbs, dictionary, locations)
    joined = join_hot(rows, done, ["title"])
    nothing = F.array().cast("array<string>")
    return joined.select(
        *rows.columns,
        F.coalesce("norm_title", F.lit("")).alias("norm_title"),
        F.coalesce("seniorities", nothing).alias("seniorities"),
        F.coalesce("hierarchies", nothing).alias("hierarchies"),
    )
