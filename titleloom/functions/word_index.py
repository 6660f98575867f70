"""Constant look-up of words inside an expression, at the same cost for any number of words."""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class WordIndex:
    """A constant table ``word -> value`` in buckets by checksum: a word is compared with the few of its bucket only.

    A map literal would be searched entry by entry.
    """

    def __init__(self, values: Mapping[str, object], kind: str):
        self.buckets = 1 << max(0, len(values) - 1).bit_length()
        held: list[list[dict]] = [[] for _ in range(self.buckets)]
        for word, value in sorted(values.items()):
            held[zlib.crc32(word.encode("utf-8")) % self.buckets].append({"word": word, "value": value})
        self.table = F.from_json(F.lit(json.dumps(held)), f"array<array<struct<word:string,value:{kind}>>>")

    def get(self, word: Column) -> Column:
        """The value of a word, or null."""
        bucket = F.get(self.table, F.pmod(F.crc32(word.cast("binary")), F.lit(self.buckets)).cast("int"))
        return F.get(F.filter(bucket, lambda entry: entry["word"] == word), 0)["value"]

    def holds(self, word: Column) -> Column:
        bucket = F.get(self.table, F.pmod(F.crc32(word.cast("binary")), F.lit(self.buckets)).cast("int"))
        return F.exists(bucket, lambda entry: entry["word"] == word)
