"""Fill-in-middle documents: cuts at token boundaries, which are kept as a compressed set and found by rank."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import let

# Positions of one container of the set.
SPAN = 1 << 16
ARRAY_MOST = 4096
WORDS = SPAN // 64
# Marks of the prefix, the suffix and the middle: fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ArrayContainer:
    """Up to 4,096 positions, in order."""

    def __init__(self, low):
        self.low = low

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapContainer:
    """Many positions: one bit each, and the number of bits before each word."""

    def __init__(self, low):
        import numpy as np

        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, rank: int) -> int:
        import numpy as np

        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        word = int(self.words[at])
        for _ in range(rank - int(self.before[at])):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """Positions that follow each other: first position of each run, and the number of positions before it."""

    def __init__(self, first, before):
        self.first, self.before = first, before

    def select(self, rank: int) -> int:
        import numpy as np

        at = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.first[at]) + rank - int(self.before[at])


def container(low):
    """The smallest container of sorted distinct positions below ``SPAN``: two bytes each, four a run, or 8 KB of bits."""
    import numpy as np

    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(low), 8 * WORDS):
        return RunContainer(low[starts], starts)
    return ArrayContainer(low.astype(np.uint16)) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """Sorted positions in containers of 65,536, with the number of positions before each container."""

    def __init__(self, parts: Iterator):
        self.bases: list[int] = []
        self.before: list[int] = []
        self.containers: list = []
        self.count = 0
        for base, low in parts:
            if len(low):
                self.bases.append(base)
                self.before.append(self.count)
                self.containers.append(container(low))
                self.count += len(low)

    def select(self, rank: int) -> int:
        """The position that ``rank`` others stand before: the container by its cumulative count, then inside it."""
        at = bisect_right(self.before, rank) - 1
        return self.bases[at] + self.containers[at].select(rank - self.before[at])


def word_boundaries(text: str) -> Iterator:
    """``base, positions - base`` per container: 0 and the end of every token, in code points.

    A token is white space and the word behind it, or the white space at the end.
    """
    import numpy as np

    size = len(text)
    for base in range(0, size + 1, SPAN):
        part = text[max(0, base - 1) : base + SPAN].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, np.uint32)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        if base == 0:
            blank = np.concatenate(([True], blank))
        if base + SPAN > size:
            blank = np.concatenate((blank, [True]))
        ends = ~blank[:-1] & blank[1:]
        ends[0] |= base == 0
        if base + SPAN > size:
            ends[size - base] = True
        yield base, np.flatnonzero(ends)


def character_boundaries(text: str) -> Iterator:
    """As ``word_boundaries``, each code point a token."""
    import numpy as np

    for base in range(0, len(text) + 1, SPAN):
        yield base, np.arange(min(SPAN, len(text) + 1 - base))


UNITS = {"word": word_boundaries, "character": character_boundaries}


def _cuts(unit: str):
    """Column function ``text, one, two, wanted`` to tokens and both offsets (null where not wanted)."""

    @F.arrow_udf("struct<n:long,first:long,second:long>")
    def cuts(text, one, two, wanted):
        import pyarrow as pa

        tokens, low, high = [], [], []
        for value, a, b, cut in zip(text, one.to_pylist(), two.to_pylist(), wanted.to_pylist(), strict=True):
            ends = BoundarySet(UNITS[unit](value.as_py()))
            tokens.append(ends.count - 1)
            a, b = a % ends.count, b % ends.count
            low.append(ends.select(min(a, b)) if cut else None)
            high.append(ends.select(max(a, b)) if cut else None)
        columns = [pa.array(c, pa.int64()) for c in (tokens, low, high)]
        return pa.StructArray.from_arrays(columns, ["n", "first", "second"])

    return cuts


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits that the seed and the doc_id decide (a null one counts as an empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, unit: str = "word"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: documents cut in three at token boundaries and reordered.

    ``n`` counts the tokens of the text. ``percent`` of the documents are cut, of these ``suffix_first`` percent in
    the order suffix, prefix, middle (``spm``), the others prefix, suffix, middle (``psm``). A text that is null, empty
    or holds a mark stays ``plain`` with null lengths. Draws depend on the seed and the doc_id alone, so rows that repeat
    a doc_id draw alike; a null doc_id draws for an empty string. ``output`` is never null. Extra columns are not read.
    """
    h = draws(seed, F.col("doc_id"))
    held = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(held, F.lit(mark))
    form = F.when((held == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", held.alias("text"), form.alias("form"), h[0].alias("one"), h[1].alias("two"))
    found = rows.withColumn("cut", _cuts(unit)("text", "one", "two", F.col("form") != "plain"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substring(F.col("text"), F.lit(1), first)
    middle = F.substring(F.col("text"), first + 1, second - first)
    suffix = F.substring(F.col("text"), second + 1, F.lit((1 << 31) - 1))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return found.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.col("cut.first").alias("prefix_chars"),
        (F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Its marks stand once each, as a text that holds one is never cut."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).otherwise(
        let(parts, lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    )
