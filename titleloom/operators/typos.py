"""Spelling correction by joining words that share a text with up to two letters deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.edit_distance import edits_up_to_two, letters
from titleloom.functions.text import split_words
from titleloom.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, join_both_hot, join_hot
from titleloom.session import written_once

# A word of n letters has up to 1 + n + n(n-1)/2 deletion keys. Longer vocabulary words are found by
# segments instead, whose number does not grow with the word.
MAX_DELETION_LENGTH = 24
# Share of the words whose keys are counted before a join of two large sides.
SKETCHED = 1 / 16
_SEGMENTS = fv.MAX_EDIT_DISTANCE + 1


def deletions(word: Column) -> Column:
    """Distinct texts left after deleting none, one or two letters."""

    def without_one(text: Column, first: Column) -> Column:
        """Pairs (rest, position) for each letter at or after a position."""
        return F.transform(
            F.sequence(first, F.length(text)),
            lambda i: F.struct(
                F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))).alias("rest"),
                i.alias("at"),
            ),
        )

    none = F.array(F.struct(word.alias("rest"), F.lit(1).alias("at")))
    empty = F.slice(none, 1, 0)
    one = F.when(F.length(word) >= 1, without_one(word, F.lit(1))).otherwise(empty)
    two = F.flatten(
        F.transform(
            one,
            lambda d: F.when(
                (F.length(d["rest"]) >= 1) & (d["at"] <= F.length(d["rest"])), without_one(d["rest"], d["at"])
            ).otherwise(empty),
        )
    )
    return F.array_distinct(F.transform(F.concat(none, one, two), lambda d: d["rest"]))


def _segment(word: Column, length: Column, k: int, shift: Column | int = 0) -> Column:
    """Segment k of three even segments of a text of some length, read at a shifted place."""
    size = F.floor(length / _SEGMENTS).cast("int")
    start = size * k
    taken = size if k < _SEGMENTS - 1 else length - start
    start = start + (F.lit(shift) if isinstance(shift, int) else shift)
    # A segment that would begin before the word or end after it cannot be meant.
    return F.when(
        (start >= 0) & (start + taken <= F.length(word)),
        F.concat(F.concat_ws("/", F.lit("seg"), length, F.lit(k)), F.lit("/"), F.substring(word, start + 1, taken)),
    )


def vocabulary_keys(word: Column) -> Column:
    """Keys under which a vocabulary word is found."""
    segments = F.array(*[_segment(word, F.length(word), k) for k in range(_SEGMENTS)])
    return F.when(F.length(word) <= MAX_DELETION_LENGTH, deletions(word)).otherwise(segments)


def lookup_keys(word: Column) -> Column:
    """Keys under which all vocabulary words within two edits of a word are found.

    Deleting the letters that two edits touch leaves the same text on both sides, so near words share a
    deletion key. Two edits also leave one of three segments untouched, moved by at most two places.
    """
    empty = F.array().cast("array<string>")
    reach = fv.MAX_EDIT_DISTANCE
    by_deletion = F.when(F.length(word) <= MAX_DELETION_LENGTH + reach, deletions(word)).otherwise(empty)
    lengths = F.sequence(F.greatest(F.length(word) - reach, F.lit(MAX_DELETION_LENGTH + 1)), F.length(word) + reach)
    shifts = F.array(*[F.lit(s) for s in range(-reach, reach + 1)])
    by_segment = F.when(
        F.length(word) + reach > MAX_DELETION_LENGTH,
        F.flatten(
            F.transform(
                lengths,
                lambda n: F.flatten(
                    F.transform(shifts, lambda s: F.array(*[_segment(word, n, k, s) for k in range(_SEGMENTS)]))
                ),
            )
        ),
    ).otherwise(empty)
    return F.array_distinct(F.filter(F.concat(by_deletion, by_segment), lambda k: k.isNotNull()))


def _key_hashes(keys: Column) -> Column:
    """Keys as numbers: eight bytes each; a clash only adds a candidate that the distance check drops."""
    return F.transform(keys, lambda k: F.xxhash64(k))


def _best_short_words(known: DataFrame) -> DataFrame:
    """The most frequent known word of one and of two letters, under the empty key: two rows.

    Short words are all within two edits of each other. Where two of them share no letter the distance
    follows from their lengths alone, so only the best word of each length can win.
    """
    return (
        known.filter(F.length("word") <= fv.MAX_EDIT_DISTANCE)
        .groupBy(F.length("word").alias("n"))
        .agg(F.min_by(F.struct("word", "freq", "letters"), F.struct(-F.col("freq"), "word")).alias("best"))
        .select(
            F.col("best.word").alias("corrected"), "best.freq", F.col("best.letters").alias("corrected_letters"),
            F.xxhash64(F.lit("")).alias("key"),
        )
    )


def _fits_a_broadcast(known: DataFrame) -> bool:
    """Whether all keys of the known words, with the words, lie within both broadcast bounds."""
    n = F.length("word")
    keys = F.when(n <= MAX_DELETION_LENGTH, 1 + n + n * (n - 1) / 2).otherwise(_SEGMENTS)
    # A row has the word, its letters, and three numbers with their overhead.
    rows, size = known.agg(F.sum(keys), F.sum(keys * (2 * F.octet_length("word") + 40))).first()
    return (rows or 0) <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def corrections(words: DataFrame, vocabulary: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``word, corrected, distance`` for words outside a vocabulary (``word, freq``) with a near word in it.

    Nearest first, then most frequent, then first by name. Words of ``dictionary`` (``word``) are right too,
    but nothing is corrected to them.
    """
    # Both are read several times below, and finding the unknown words takes a pass over all texts.
    known = vocabulary.groupBy("word").agg(F.sum("freq").alias("freq"))
    known = written_once(known.withColumn("letters", letters(F.col("word"))), "known-words")
    unknown = words.select("word").distinct().join(known, "word", "left_anti")
    if dictionary is not None:
        unknown = unknown.join(dictionary.select("word").distinct(), "word", "left_anti")
    # The words are few bytes and much work: they are spread over all tasks.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unknown = unknown.repartition(tasks, "word").withColumn("word_letters", letters(F.col("word")))
    unknown = written_once(unknown, "unknown-words")

    def offered(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("word").alias("corrected"), "freq", F.col("letters").alias("corrected_letters"),
            F.explode(_key_hashes(F.filter(vocabulary_keys(F.col("word")), lambda k: k != ""))).alias("key"),
        )

    def wanted(rows: DataFrame) -> DataFrame:
        return rows.select("word", "word_letters", F.explode(_key_hashes(lookup_keys(F.col("word")))).alias("key"))

    offers = offered(known).unionByName(_best_short_words(known))
    if _fits_a_broadcast(known):
        near = wanted(unknown).join(F.broadcast(offers), "key")
    else:
        # Short keys are shared by many words on both sides.
        seen = wanted(unknown.sample(SKETCHED, 17)), offered(known.sample(SKETCHED, 17))
        near = join_both_hot(wanted(unknown), offers, ["key"], ["word"], ["corrected"], seen)
    distance = edits_up_to_two(*map(F.col, ("word", "corrected", "word_letters", "corrected_letters")))
    candidates = near.withColumn("distance", distance)
    # Pairs further apart have no distance and no order, and so are never the smallest.
    order = F.when(F.col("distance").isNotNull(), F.struct("distance", -F.col("freq"), "corrected"))
    return (
        candidates.groupBy("word")
        .agg(F.min_by(F.struct("corrected", "distance"), order).alias("best"))
        .filter(F.col("best").isNotNull())
        .select("word", "best.corrected", "best.distance")
    )


def correct_typos(texts: DataFrame, vocabulary: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Correct the words of ``text`` in a table ``title, text`` with distinct titles."""
    # Words go under a digest of their title: with the title itself a long text would be moved once per word.
    texts = written_once(texts.select("title", "text", F.unhex(F.md5("title")).alias("digest")), "texts")
    words = texts.select("digest", F.posexplode(split_words(F.col("text"))).alias("at", "word"))
    fixes = corrections(words, vocabulary, dictionary).select("word", "corrected")
    fixed = join_hot(words, fixes, ["word"], "left", spread=["digest", "at"])
    rebuilt = fixed.groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("corrected", "word").alias("word")))).alias("words")
    ).select("digest", F.array_join(F.col("words.word"), " ").alias("text"))
    # Titles without any word have no row above.
    return texts.select("title", "digest").join(rebuilt, "digest", "left").select(
        "title", F.coalesce("text", F.lit("")).alias("text")
    )
