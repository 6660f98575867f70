"""Match titles by the cosine of weighted sums of word vectors.

Word tables have the columns ``word, vec, idf``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.functions.text import split_words
from titleloom.functions.vectors import added, scaled, summed
from titleloom.operators.skew import Lookup, join_hot, join_lookup, written_lookup
from titleloom.session import written_once
from titleloom.sources.tables import constant_table

# Similarities are compared after rounding, so that the order of additions does not decide ties.
DIGITS = 9
# Rows of one block of texts or titles; a task compares one block of each.
BLOCK_ROWS = 8192
_CHUNK_ROWS = 256
# Pairs of a text and a block that a task hands over at once.
_PAIR_ROWS = 8192
# Pivots are fitted on the driver to a sample of so many titles each; more blocks than pivots are rings around them.
MOST_PIVOTS = 256
PIVOT_SAMPLE = 32
PIVOT_ROUNDS = 4
# Angles are widened by this much against rounding.
ANGLE_SLACK = 1e-6


def known_words(word_vectors: DataFrame | Lookup, texts: DataFrame, text: str) -> Lookup:
    """Words of the texts with a vector and a weight, written and measured once for all the joins below."""
    if isinstance(word_vectors, Lookup):
        return word_vectors
    known = word_vectors.filter(F.col("vec").isNotNull() & F.col("idf").isNotNull())
    # Written, so that a few words are seen to be few before the table of vectors is read.
    used = written_once(texts.select(F.explode(split_words(F.col(text))).alias("word")).distinct(), "used-words")
    known = known.join(used, "word", "left_semi")
    return written_lookup(known.select("word", F.col("vec").cast("array<double>"), F.col("idf").cast("double")))


def _named_texts(texts: DataFrame, text: str) -> DataFrame:
    """The distinct texts with a ``digest``, under which their words go: a long text is not moved with each of them."""
    distinct = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    return written_once(distinct.withColumn("digest", F.unhex(F.md5(text))), "named-texts")


def _joined_words(placed: DataFrame, words: Lookup, how: str) -> DataFrame:
    """A table of words too large to broadcast is not repeated, but for the words that stand most often."""
    if words.small:
        return join_lookup(placed, words, ["word"], how)
    return join_hot(placed, words.table, ["word"], how, spread=["digest", "at"])


def _fully_known(named: DataFrame, words: Lookup, text: str) -> DataFrame:
    """``digest, words``: texts all of whose words have a vector and a weight, with ``at, word, idf`` of each.

    No vector is moved to see that.
    """
    placed = named.select("digest", F.posexplode(split_words(F.col(text))).alias("at", "word"))
    found = _joined_words(placed, words.select("word", "idf"), "left")
    return (
        found.groupBy("digest")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "word", "idf"))).alias("words"),
            F.count_if(F.col("idf").isNull()).alias("unknown"),
        )
        .filter(F.col("unknown") == 0)
        .select("digest", "words")
    )


def _with_vectors(known: DataFrame, words: Lookup) -> DataFrame:
    """Texts of known words with an array ``words`` of ``at, word, vec, idf``."""
    placed = written_once(known.select("digest", F.inline("words")).drop("idf"), "placed-words")
    found = _joined_words(placed, words, "inner")
    return found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", "word", "vec", "idf"))).alias("words"))


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)


def title_embedding(titles: DataFrame, word_vectors: DataFrame | Lookup, title: str = "title") -> DataFrame:
    """``title, embedding, weight``: idf-weighted sum over the words, by the idf of the distinct words."""
    named = _named_texts(titles, title)
    words = known_words(word_vectors, named, title)
    known = _with_vectors(_fully_known(named, words, title), words)
    distinct = F.array_distinct(F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["idf"].alias("idf"))))
    weighted = known.select(
        "digest",
        summed(F.transform("words", lambda w: scaled(w["vec"], w["idf"]))).alias("total"),
        _total(F.transform(distinct, lambda w: w["idf"])).alias("weight"),
    )
    return weighted.filter(F.col("weight") != 0).join(named, "digest").select(
        title, scaled(F.col("total"), 1 / F.col("weight")).alias("embedding"), "weight"
    )


def title_spans(titles: DataFrame, word_vectors: DataFrame | Lookup, title: str = "norm_title") -> DataFrame:
    """``title, start, end, ngram`` for every word sequence of a title.

    A title with a word that has no embedding of its own gives no row at all.
    """
    named = _named_texts(titles, title)
    known = _fully_known(named, known_words(word_vectors, named, title), title)
    known = known.filter(~F.exists("words", lambda w: w["idf"] == 0)).join(named, "digest")
    return _spans(known.select(title, F.col("words.word").alias("words")), title)


def _spans(known: DataFrame, title: str) -> DataFrame:
    """``title, start, end, ngram`` from ``title, words``."""
    starts = known.select(title, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("start"))
    ends = starts.select(
        title, "words", "start", F.explode(F.sequence(F.col("start") + 1, F.size("words"))).alias("end")
    )
    part = F.slice("words", F.col("start") + 1, F.col("end") - F.col("start"))
    return ends.select(title, "start", "end", F.array_join(part, " ").alias("ngram"))


def running_sums(titles: DataFrame, word_vectors: DataFrame | Lookup, title: str = "norm_title") -> DataFrame:
    """``title, words, weights, sums``: the words of a title, their weights, and the sum of the vectors before each place.

    The vectors of any word sequence add up to the difference of two of the ``sums``, so a title moves one
    vector per word, however many sequences it has. Titles as in ``title_spans``.
    """
    named = _named_texts(titles, title)
    words = known_words(word_vectors, named, title)
    known = _fully_known(named, words, title)
    known = known.filter((F.size("words") > 0) & ~F.exists("words", lambda w: w["idf"] == 0))
    placed = _with_vectors(known, words).join(named, "digest")
    zero = F.array(F.transform(F.get("words", F.lit(0))["vec"], lambda x: F.lit(0.0)))
    sums = F.aggregate(
        "words", zero, lambda held, w: F.concat(held, F.array(added(F.element_at(held, -1), w["vec"])))
    )
    return placed.select(title, F.col("words.word").alias("words"), F.col("words.idf").alias("weights"), sums.alias("sums"))


def _span_vector(start: Column, end: Column) -> Column:
    """The vector of words ``start`` to ``end`` of a row of ``running_sums``: vectors over weights; null at weight 0."""
    weight = _total(F.slice("weights", start + 1, end - start))
    difference = F.zip_with(F.get("sums", end), F.get("sums", start), lambda a, b: a - b)
    return F.when(weight != 0, scaled(difference, 1 / weight))


def ngram_embedding(titles: DataFrame, word_vectors: DataFrame | Lookup, title: str = "norm_title") -> DataFrame:
    """``title, start, end, ngram, embedding`` for every word sequence of a title."""
    running = running_sums(titles, word_vectors, title)

    def span(start: Column, end: Column) -> Column:
        part = F.array_join(F.slice("words", start + 1, end - start), " ")
        return F.struct(
            start.alias("start"), end.alias("end"), part.alias("ngram"), _span_vector(start, end).alias("embedding")
        )

    # All sequences are made inside the row, so that the sums are not repeated with each of them.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 1),
            lambda start: F.transform(F.sequence(start + 1, F.size("words")), lambda end: span(start, end)),
        )
    )
    return running.select(title, F.inline(spans)).filter(F.col("embedding").isNotNull())


def distinct_ngram_vectors(spans: DataFrame, running: DataFrame, title: str = "norm_title") -> DataFrame:
    """``text, embedding``: the vector of each distinct ``ngram`` of ``spans``, made once, in one title that has it."""
    place = F.min(F.struct(title, "start", "end")).alias("place")
    chosen = spans.groupBy("ngram").agg(place).select("ngram", "place.*")
    places = chosen.groupBy(title).agg(F.collect_list(F.struct("start", "end", "ngram")).alias("places"))
    made = F.transform(
        "places", lambda p: F.struct(p["ngram"].alias("text"), _span_vector(p["start"], p["end"]).alias("embedding"))
    )
    return running.join(places, title).select(F.inline(made)).filter(F.col("embedding").isNotNull())


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), dtype=np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1, lengths)


class TitleBlocks(NamedTuple):
    """Titles dealt to blocks by their nearest pivot and their angle to it.

    ``table`` has ``title_block, matched_title, embedding``. Per block: its pivot, the least and the largest angle of its
    titles, and their number. A pivot of -1 stands for titles without direction, which no angle rules out.
    """

    table: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _pivots(titles: DataFrame, count: int) -> np.ndarray:
    """Directions that stand for the titles: spherical means of a bounded sample, found in a few rounds."""
    sample = titles.orderBy(F.xxhash64("matched_title"), "matched_title").limit(PIVOT_SAMPLE * count).toPandas()
    units = _unit_rows(sample["embedding"])
    units = units[np.linalg.norm(units, axis=1) > 0]
    pivots = units[:: max(1, len(units) // count)][:count]
    for _ in range(PIVOT_ROUNDS if len(pivots) else 0):
        owner = (units @ pivots.T).argmax(axis=1)
        sums = np.stack([units[owner == i].sum(axis=0) if (owner == i).any() else pivots[i] for i in range(len(pivots))])
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), pivots)
    return pivots


def title_blocks(titles: DataFrame, block_rows: int | None = None) -> TitleBlocks:
    """Blocks of about ``block_rows`` titles that lie near each other, from a written table ``matched_title, embedding``.

    A pivot's titles are cut into rings by angle, and a ring that is still too large by name. What comes to the driver is
    a few numbers per block.
    """
    size = block_rows or BLOCK_ROWS
    total = titles.count()
    wanted = min(MOST_PIVOTS, math.ceil(total / size))
    if wanted <= 1:
        one = titles.withColumn("title_block", F.lit(0))
        return TitleBlocks(one, np.zeros((0, 1)), np.array([-1]), np.zeros(1), np.zeros(1), np.array([total]))
    pivots = _pivots(titles, wanted)

    def place(batches):
        for rows in batches:
            units = _unit_rows(rows["embedding"])
            angles = _angles(units, pivots) if len(pivots) else np.zeros((len(rows), 1))
            pivot = angles.argmin(axis=1)
            rows["angle"] = angles[np.arange(len(rows)), pivot]
            rows["pivot"] = np.where((np.linalg.norm(units, axis=1) > 0) & (len(pivots) > 0), pivot, -1)
            yield rows

    kinds = "matched_title string, embedding array<double>"
    placed = written_once(titles.mapInPandas(place, f"{kinds}, angle double, pivot int"), "placed-titles")
    counts = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    rings = max(math.ceil(n / size) for n in counts.values())
    shares = F.array(*[F.lit(i / rings) for i in range(1, rings)]) if rings > 1 else F.array(F.lit(1.0))
    cuts = {
        r["pivot"]: r["cuts"]
        for r in placed.groupBy("pivot").agg(F.percentile_approx("angle", shares, F.lit(100 * rings)).alias("cuts")).collect()
    }
    limits = {}
    for pivot, n in counts.items():
        own = min(rings, math.ceil(n / size))
        limits[pivot] = sorted({cuts[pivot][round(i * rings / own) - 1] for i in range(1, own)})
    # One row per pivot, each with a few limits: pivots are bounded, rings are as many as blocks.
    table = constant_table(titles.sparkSession, "pivot int, limits array<double>", sorted(limits.items()))
    ring = F.size(F.filter("limits", lambda x: x < F.col("angle")))
    ringed = placed.join(F.broadcast(table), "pivot").withColumn("ring", ring)
    sizes = ringed.groupBy("pivot", "ring").agg(
        F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
    ).orderBy("pivot", "ring").collect()
    numbered, blocks = [], []
    for r in sizes:
        parts = math.ceil(r["n"] / (2 * size)) if r["n"] > 2 * size else 1
        numbered.append((r["pivot"], r["ring"], len(blocks), parts))
        blocks += [(r["pivot"], r["low"], r["high"], r["n"] // parts)] * parts
    first = constant_table(titles.sparkSession, "pivot int, ring int, first int, parts int", numbered)
    part = F.pmod(F.xxhash64("matched_title"), F.col("parts")).cast("int")
    done = ringed.join(F.broadcast(first), ["pivot", "ring"]).select(
        (F.col("first") + part).alias("title_block"), "matched_title", "embedding"
    )
    return TitleBlocks(done, pivots, *(np.array(c) for c in zip(*blocks, strict=True)))


def _reach(units: np.ndarray, index: TitleBlocks) -> np.ndarray:
    """The largest cosine that each text can have with any title of each block, by the angles of both to its pivot."""
    if not len(index.pivots):
        return np.ones((len(units), len(index.pivot)))
    angle = _angles(units, index.pivots)[:, np.maximum(index.pivot, 0)]
    gap = np.maximum(0, np.maximum(angle - index.high, index.low - angle) - ANGLE_SLACK)
    reach = np.cos(np.minimum(gap, np.pi))
    reach[:, index.pivot < 0] = 1
    reach[np.linalg.norm(units, axis=1) == 0] = 1
    return reach


def _home_blocks(reach: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Per text the blocks with the largest reach that together have k titles."""
    order = np.argsort(-reach, axis=1, kind="stable")
    before = np.cumsum(count[order], axis=1) - count[order]
    chosen = np.zeros(reach.shape, bool)
    np.put_along_axis(chosen, order, before < k, axis=1)
    return chosen


def block_pairs(texts: DataFrame, index: TitleBlocks, k: int, home: bool, least: str | None = None) -> DataFrame:
    """``title_block`` and the columns of ``texts`` for each block that a text has to be compared with.

    With ``home`` these are the first blocks to look at; else all others whose reach is not below the column ``least``
    (a cosine; null: all). Without a ``least`` no block counts as looked at before.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    # The numbers of the blocks go to the tasks, the table does not.
    index = index._replace(table=None)

    def pairs(batches):
        step = max(1, _PAIR_ROWS // len(index.pivot))
        for rows in batches:
            for begin in range(0, len(rows), step):
                part = rows.iloc[begin : begin + step]
                reach = _reach(_unit_rows(part["embedding"]), index)
                if home:
                    chosen = _home_blocks(reach, index.count, k)
                else:
                    limit = part[least].fillna(-2.0).to_numpy(np.float64)[:, None]
                    chosen = reach >= limit - 10.0**-DIGITS
                    if least == "found":
                        chosen &= ~_home_blocks(reach, index.count, k)
                text, block = np.nonzero(chosen)
                found = part.iloc[text].copy()
                found.insert(0, "title_block", block.astype(np.int32))
                yield found

    return texts.mapInPandas(pairs, f"title_block int, {kinds}")


def _compared(entries: DataFrame, index: TitleBlocks, parts: int, k: int, above: float | None) -> DataFrame:
    """``text, matched_title, similarity``: per text and block the k nearest titles of the block.

    ``entries`` has ``title_block, text, embedding``. The texts of a block are dealt to ``parts`` tasks; a block's titles go
    only where some text needs them.
    """

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("matched_title", ignore_index=True)
            names = right["matched_title"].to_numpy()
            against = _unit_rows(right["embedding"]).T
            for begin in range(0, len(left), _CHUNK_ROWS):
                part = left.iloc[begin : begin + _CHUNK_ROWS]
                similarity = np.round(_unit_rows(part["embedding"]) @ against, DIGITS)
                for text, row in zip(part["text"], similarity):
                    kept = np.arange(len(row)) if above is None else np.flatnonzero(row > above)
                    if len(kept) > k:
                        least = np.partition(row[kept], len(kept) - k)[len(kept) - k]
                        kept = kept[row[kept] >= least]
                    kept = kept[np.argsort(-row[kept], kind="stable")][:k]
                    found.extend((text, names[i], float(row[i])) for i in kept)
        return pd.DataFrame(found, columns=["text", "matched_title", "similarity"])

    keys = ["title_block", "part"]
    left = entries.select("title_block", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"), "text", "embedding")
    if parts == 1:
        right = index.table.withColumn("part", F.lit(0))
    else:
        needed = left.select(F.col("title_block").alias("needed"), F.col("part").alias("piece")).distinct()
        right = index.table.join(needed, F.col("title_block") == F.col("needed")).select(
            "title_block", F.col("piece").alias("part"), "matched_title", "embedding"
        )
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(nearest, "text string, matched_title string, similarity double")
    )


def nearest_titles(
    texts: DataFrame, titles: DataFrame, k: int = fv.SIMILAR_TITLES, above: float | None = None
) -> DataFrame:
    """``text, matched_title, similarity, rank``: the k titles nearest to each text by cosine.

    ``texts`` has ``text, embedding``, ``titles`` has ``matched_title, embedding``, both with distinct names. Titles lie
    in blocks around pivots (``title_blocks``). By the triangle inequality of angles a text can do without every
    block whose titles cannot be nearer than what it needs: ``above``, or the k-th nearest title of the blocks
    it looks at first. So the result is that of comparing all with all. A task compares some texts with one block;
    no list of all pairs exists anywhere. ``above`` leaves out titles that are not more similar than that.
    """
    # Counted to size the blocks and then read again: written once instead of computed twice.
    texts = written_once(texts.select("text", F.col("embedding").cast("array<double>").alias("embedding")), "texts")
    titles = written_once(
        titles.select("matched_title", F.col("embedding").cast("array<double>").alias("embedding")), "titles"
    )
    index = title_blocks(titles)
    parts = max(1, math.ceil(texts.count() / BLOCK_ROWS))
    if len(index.pivot) == 1:
        found = _compared(texts.withColumn("title_block", F.lit(0)), index, parts, k, above)
    elif above is not None:
        wanted = block_pairs(texts.withColumn("least", F.lit(float(above))), index, k, False, "least")
        found = _compared(wanted, index, parts, k, above)
    else:
        first = written_once(_compared(block_pairs(texts, index, k, True), index, parts, k, None), "first-titles")
        reached = first.groupBy("text").agg(F.sort_array(F.collect_list("similarity"), False).alias("best")).select(
            "text", F.get("best", F.lit(k - 1)).alias("found")
        )
        rest = block_pairs(texts.join(reached, "text", "left"), index, k, False, "found")
        found = first.unionByName(_compared(rest, index, parts, k, None))
    order = Window.partitionBy("text").orderBy(F.desc("similarity"), "matched_title")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top5_titles(texts: DataFrame, titles: DataFrame) -> DataFrame:
    return nearest_titles(texts, titles, fv.SIMILAR_TITLES)


def has_starting_word(text: Column) -> Column:
    return F.arrays_overlap(split_words(text), F.array(*[F.lit(w) for w in fv.STARTING_ROLE_WORDS]))


def starting_role_filter(candidates: DataFrame, title: str = "norm_title") -> DataFrame:
    """Drop candidates (``matched_title``) that are starting roles for titles that are not."""
    return candidates.filter(~has_starting_word(F.col("matched_title")) | has_starting_word(F.col(title)))


def best_similarity_fold(candidates: DataFrame, title: str = "norm_title") -> DataFrame:
    """``title, matched_title, similarity`` from candidates ``start, end, rank, matched_title, similarity``.

    Candidates are visited by start, end and rank. One is taken if it beats the one held by more than the
    tolerance, or if it is within the tolerance and stands for more words. As the one held can get less
    similar on the way, this is no maximum.
    """
    entry = F.struct(
        "start", "end", "rank", "similarity", "matched_title", (F.col("end") - F.col("start")).alias("words")
    )
    nothing = F.struct(
        F.lit(0.0).alias("similarity"), F.lit(None).cast("string").alias("matched_title"), F.lit(0).alias("words")
    )

    def step(held: Column, seen: Column) -> Column:
        gain = seen["similarity"] - held["similarity"]
        takes = (gain > fv.SIMILARITY_TOLERANCE) | (
            (F.abs(gain) <= fv.SIMILARITY_TOLERANCE) & (seen["words"] > held["words"])
        )
        return F.when(
            takes,
            F.struct(
                seen["similarity"].alias("similarity"),
                seen["matched_title"].alias("matched_title"),
                seen["words"].cast("int").alias("words"),
            ),
        ).otherwise(held)

    # A title has at most five candidates per word sequence.
    return (
        candidates.filter(F.col("similarity") > fv.MIN_SIMILARITY)
        .groupBy(title)
        .agg(F.aggregate(F.array_sort(F.collect_list(entry)), nothing, step).alias("best"))
        .select(title, "best.matched_title", "best.similarity")
    )


def match_embedding(titles: DataFrame, catalogue: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """``norm_title, matched_title, similarity`` for titles near enough to a catalogue title."""
    titles = written_once(titles.select("norm_title"), "titles")
    roles = written_once(catalogue.select(F.col("processed_title").alias("matched_title")), "roles")
    both = titles.toDF("text").unionByName(roles.toDF("text"))
    words = known_words(word_vectors, both, "text")
    # Read for the texts to compare, for their vectors and again for the titles they stand in.
    running = written_once(running_sums(titles, words), "running-sums")
    spans = _spans(running.select("norm_title", "words"), "norm_title")
    texts = distinct_ngram_vectors(spans, running)
    against = title_embedding(roles, words, "matched_title")
    near = nearest_titles(texts, against, above=fv.MIN_SIMILARITY)
    # A text has at most five near titles; one row per text keeps the join a lookup.
    per_text = near.groupBy(F.col("text").alias("ngram")).agg(
        F.collect_list(F.struct("rank", "matched_title", "similarity")).alias("near")
    )
    candidates = join_hot(spans, per_text, ["ngram"], "inner").select(
        "norm_title", "start", "end", F.inline("near")
    )
    return best_similarity_fold(starting_role_filter(candidates))
