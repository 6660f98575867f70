"""Word frequencies that grow load by load: a load counts once however often it is added."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from titleloom.operators.vocabulary import merge_word_freq
from titleloom.sources.tables import constant_table

WORDS = "word string, freq bigint"
# One row per written part: the load it holds (null for a merged part), the parts it stands for, its rows.
PARTS = "part string, load string, replaces array<string>, rows bigint"


def _parts(spark: SparkSession, path: str) -> list:
    constant_table(spark, PARTS, []).write.mode("ignore").parquet(f"{path}/parts")
    return spark.read.schema(PARTS).parquet(f"{path}/parts").collect()


def _live(entries: list) -> list:
    gone = {part for entry in entries for part in entry["replaces"] or ()}
    return sorted((e for e in entries if e["part"] not in gone), key=lambda e: (-e["rows"], e["part"]))


def _write(spark: SparkSession, path: str, words: DataFrame, load: str | None, replaces: list[str]) -> None:
    """Write a part under a name that follows from what it holds, then enter it. Stopped before the entry, it is written anew."""
    named = "\n".join([load or "", *sorted(replaces)])
    part = hashlib.sha256(named.encode()).hexdigest()[:32]
    words.write.mode("overwrite").parquet(f"{path}/words/{part}")
    rows = spark.read.schema(WORDS).parquet(f"{path}/words/{part}").count()
    constant_table(spark, PARTS, [(part, load, replaces, rows)]).coalesce(1).write.mode("append").parquet(f"{path}/parts")


def add_word_load(spark: SparkSession, path: str, load: str, words: DataFrame) -> bool:
    """Add the ``word, freq`` rows of a load; False, and nothing done, if the load was added before.

    Only the load is written. Parts are merged once the smaller ones have together as many rows as the largest, so a word
    is rewritten a number of times that grows with the logarithm of the vocabulary, not with the loads. One writer at a
    time; the list of parts, two rows a load at most, comes to the driver.
    """
    if any(entry["load"] == load for entry in _parts(spark, path)):
        return False
    _write(spark, path, merge_word_freq(words.select("word", "freq")), load, [])
    compact_word_loads(spark, path)
    return True


def compact_word_loads(spark: SparkSession, path: str, always: bool = False) -> bool:
    """Merge the live parts into one, if the smaller ones weigh as much as the largest or if asked to."""
    live = _live(_parts(spark, path))
    if len(live) < 2 or not (always or sum(e["rows"] for e in live[1:]) >= live[0]["rows"]):
        return False
    _write(spark, path, read_word_freq(spark, path), None, [e["part"] for e in live])
    return True


def read_word_freq(spark: SparkSession, path: str) -> DataFrame:
    """``word, freq`` over all loads."""
    live = [f"{path}/words/{e['part']}" for e in _live(_parts(spark, path))]
    if not live:
        return constant_table(spark, WORDS, [])
    words = spark.read.schema(WORDS).parquet(*live)
    return words if len(live) == 1 else merge_word_freq(words)
