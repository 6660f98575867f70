"""Repeated lines by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import join_counted, let, staged

WINDOW_LINES = 3


def lines_of(text: Column) -> Column:
    """Lines between line feeds; null is empty, and an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """``doc_id, text_key, windows``: per start line, two hashes of the lines from there; null where all are blank."""
    hashed = F.transform(
        lines_of(F.col("text")),
        lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), (F.trim(x) == "").alias("blank")),
    )

    def window(all_lines: Column, i: Column) -> Column:
        part = [F.get(all_lines, i + k) for k in range(lines)]
        blank = part[0]["blank"]
        for x in part[1:]:
            blank = blank & x["blank"]
        return F.when(
            ~blank,
            F.struct(
                F.xxhash64(*[x["h"] for x in part]).alias("h"),
                F.hash(*[x["g"] for x in part], *[x["h"] for x in part]).alias("g"),
            ),
        )

    def windows(all_lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(all_lines) - lines)
        return F.when(F.size(all_lines) >= lines, F.transform(starts, lambda i: window(all_lines, i)))

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), let(hashed, windows).alias("windows"))


def repeated_windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """``doc_id, text_key, starts``: first lines of the windows that stood somewhere before, in order.

    Before means a smaller doc_id, or the same document (then the same doc_id, a smaller text_key) further up.
    """
    occurrences = staged(
        _windows(docs, lines)
        .select("doc_id", "text_key", F.posexplode("windows").alias("at", "w"))
        .filter(F.col("w").isNotNull())
        .select("doc_id", "text_key", "at", "w.h", "w.g")
        .dropDuplicates(["doc_id", "text_key", "at"]),
        "windows",
    )
    repeated = staged(
        occurrences.groupBy("h", "g")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "at")).alias("first"))
        .filter("n > 1"),
        "repeated",
    )
    later = join_counted(occurrences, repeated, ["h", "g"], "n").filter(
        ~F.struct("doc_id", "text_key", "at").eqNullSafe(F.col("first"))
    )
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("starts"))


def without_covered(lines: Column, starts: Column, window: int) -> Column:
    """The lines that no window beginning at one of the sorted ``starts`` covers.

    Between two neighbouring starts the lines from the end of the first window to the second start are kept; where
    windows touch or overlap there are none. So covered positions merge without being listed.
    """

    def rest(every: Column, at: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(at)),
            lambda i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1) + window).alias("from"),
                F.when(i == F.size(at), F.size(every)).otherwise(F.get(at, i)).alias("to"),
            ),
        )
        kept = F.filter(gaps, lambda g: g["to"] > g["from"])
        return F.flatten(F.transform(kept, lambda g: F.slice(every, g["from"] + 1, g["to"] - g["from"])))

    return F.when(starts.isNull(), lines).otherwise(let(lines, lambda every: let(starts, lambda at: rest(every, at))))


def drop_repeated_windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with the ``text`` without later occurrences of three-line windows, ``n_lines`` and ``n_removed``.

    A window is three consecutive lines, equal when the lines are identical (96 bits of hash). Its first occurrence
    (smallest doc_id, then line) stays, every line that a later one covers goes. Windows of blank lines only, and
    documents of fewer lines than a window, are left alone. A null text stays null with no lines; a text whose lines
    all go becomes empty. Rows equal in doc_id and text are one document for the search and all keep the same lines.
    All columns of ``docs`` are kept.
    """
    found = repeated_windows(docs.select("doc_id", "text"), lines).select(
        F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"), F.col("starts").alias("__starts")
    )
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    joined = keyed.join(
        found, keyed["doc_id"].eqNullSafe(found["__doc_id"]) & (keyed["__key"] == found["__text_key"]), "left"
    )
    other = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    split = joined.select(*other, "text", "__starts", lines_of(F.col("text")).alias("__lines"))
    cleaned = split.withColumn("__kept", without_covered(F.col("__lines"), F.col("__starts"), lines))
    changed = cleaned.select(
        *other,
        F.when(F.col("__starts").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).alias("n_removed"),
    )
    return changed.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
