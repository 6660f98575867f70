"""Packing token pieces into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import bucket_of, shuffle_partitions, staged, with_prefix_sum

# Ids of a word are kept for its next occurrence in the same worker, for at most this many words.
KEPT_WORDS = 800_000
# Bytes of text whose words are looked up together, and words per call of the tokenizer.
TOGETHER = 8 << 20
PER_CALL = 2000
# Words of these characters normalize to their lower case, and their pieces are found by CUT: it is the tokenizer's own
# pattern on this alphabet.
PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
WORD_END = "</w>"


class WordIds:
    """Token ids per word of one vocabulary, little-endian unsigned 32-bit numbers; kept within a worker."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same model for pieces that are normalized and cut already.
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.kept: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        import numpy as np

        plain, cuts, other = [], [], []
        for word in words:
            text = word.decode("utf-8")
            if PLAIN.fullmatch(text) and "<|" not in text:
                plain.append(word)
                cuts.append(CUT.findall(text.lower()))
            else:
                other.append((word, text))
        for begin in range(0, len(plain), PER_CALL):
            part = cuts[begin : begin + PER_CALL]
            joined = " ".join([piece for pieces in part for piece in pieces])
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            stops = np.cumsum([len(pieces) for pieces in part])
            if len(ends) != stops[-1]:
                raise ValueError("the vocabulary does not end every piece with " + WORD_END)
            data, last = ids.tobytes(), 0
            for word, stop in zip(plain[begin : begin + PER_CALL], (4 * ends[stops - 1]).tolist(), strict=True):
                self.kept[word] = data[last:stop]
                last = stop
        if other:
            codes = self.whole.encode_batch_fast([text for _, text in other], add_special_tokens=False)
            for (word, _), code in zip(other, codes, strict=True):
                self.kept[word] = np.array(code.ids, "<u4").tobytes()

    def encode(self, texts, closing: bytes) -> Iterator[bytes]:
        """Ids per text of an Arrow string array: distinct words are looked up once, then spread over the texts."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.kept.get, distinct))
        new = [w for w, ids in zip(distinct, found, strict=True) if ids is None]
        if new:
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept.clear()
                new = distinct
            self.learn(new)
            found = list(map(self.kept.__getitem__, distinct))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = pa.array(np.frombuffer(b"".join(found), "<u4"))
        of_word = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths)))), ids)
        spread = of_word.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths[coded.indices.to_numpy()])))
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        data = memoryview(np.ascontiguousarray(spread, "<u4")).cast("B")
        for begin, end in zip(bounds, bounds[1:], strict=False):
            yield b"".join((data[4 * begin : 4 * end], closing))


_WORKER: dict[str, WordIds] = {}


def token_bytes(texts, path: str, end_id: int) -> Iterator[bytes]:
    """Per text of an Arrow string array its token ids and the closing id, as little-endian unsigned 32-bit numbers.

    The tokenizer cuts at white space before anything else and its normalizer acts inside words, so the ids of
    a text are those of its words in order. A worker encodes a word once as long as it is kept. Texts are taken
    together up to ``TOGETHER`` bytes.
    """
    import numpy as np
    import pyarrow.compute as pc

    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield from _WORKER[path].encode(texts.slice(begin, stop - begin), end_id.to_bytes(4, "little"))
        begin = stop


def cut_tokens(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document's ids in pieces of ``capacity``, the last shorter."""

    def work(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for at, data in enumerate(token_bytes(batch.column("text"), path, end_id)):
                for begin in range(0, len(data), 4 * capacity):
                    piece = data[begin : begin + 4 * capacity]
                    rows.append((at, begin // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(columns[0]), *columns[1:]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns and how many packs each has; a pattern lists ``(length, times)``, longest first.

    Lengths are placed from the longest, each piece into a pack with the smallest sum, or a new one if it does not fit
    there. Packs of one pattern move together: one step places a length into as many packs as both counts allow.
    """
    heap: list[tuple[int, tuple[tuple[int, int], ...], int]] = []
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and heap[0][0] + length <= capacity:
                total, pattern, packs = heapq.heappop(heap)
                take = min(packs, left)
                if pattern and pattern[-1][0] == length:
                    grown = (*pattern[:-1], (length, pattern[-1][1] + 1))
                else:
                    grown = (*pattern, (length, 1))
                if packs > take:
                    heapq.heappush(heap, (total, pattern, packs - take))
                if total + length == capacity:
                    done.append((grown, take))
                else:
                    heapq.heappush(heap, (total + length, grown, take))
                left -= take
            else:
                # A new pack has the smallest sum until this length no longer fits, so it takes as many as it holds.
                most = capacity // length
                for times, packs in ((most, left // most), (left % most, 1)):
                    if times and packs:
                        pattern = ((length, times),)
                        if times * length == capacity:
                            done.append((pattern, packs))
                        else:
                            heapq.heappush(heap, (times * length, pattern, packs))
                left = 0
    return done + [(pattern, packs) for _, pattern, packs in heap]


def placements(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, last_rank + 1, first_sequence, offset)``: ranks of a length, their sequences in a row."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                begin = used.get(length, 0)
                rows.append((length, begin, begin + packs, sequence, offset))
                used[length] = begin + packs
                offset += length
        sequence += packs
    return rows


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A document is the ids of its text (null:
    none) and ``end_id``, cut at multiples of ``capacity``. Full pieces are sequences of their own; for the others
    the counts per length, at most ``capacity`` numbers, go to the driver, which packs the histogram. A piece finds
    its place by its rank among the pieces of its length. Rows that repeat a doc_id are packed each; extra columns are
    not read.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    pieces = staged(cut_tokens(docs, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = placements(shortest_pack_first(histogram, capacity))
    order = ["doc_id", "start", "ids_crc32"]
    ranked = with_prefix_sum(
        pieces.withColumn("bucket", bucket_of(F.col("doc_id"), F.col("start"), buckets=buckets)),
        ["length"], "bucket", order, F.lit(1).cast("long"), "rank",
    ).drop("bucket")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        # Length and first rank in one number; a rank stays far below 2 ** 48.
        table = np.array(sorted(places), np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            found = [table[at, 3] + rank - table[at, 1], table[at, 4]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], *[pa.array(x, pa.int64()) for x in found]],
                [*names, "sequence_id", "offset"],
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        work,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
