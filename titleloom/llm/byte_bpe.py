"""Byte-level BPE by rank files: a queue of merge ranks over a hierarchical bitmap, and decoding by table look-up."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame

# Characters of a text that are cut into pre-tokens at a time; a window grows where a pre-token does not fit.
WINDOW = 1 << 20
# Pre-tokens at the end of a window that may end elsewhere once more text is seen: a contraction has three characters.
UNSURE = 3
# Characters of texts that are answered together: their new pre-tokens share one queue.
TOGETHER = 4 << 20
# Ids of a pre-token are kept for its next occurrence in the same worker: so many pre-tokens of so many characters.
KEPT = 600_000
KEPT_LENGTH = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by rank, in buckets of arrays. Levels of 64-bit words mark the ranks that have any.

    A bit of a level says that the word below it is not zero, so the least rank is found by one find-first-set per
    level, whatever the number of positions.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels: list[list[int]] = []
        words = max(1, ranks)
        while True:
            words = (words + 63) >> 6
            self.levels.append([0] * words)
            if words == 1:
                break

    def push(self, ranks, positions) -> None:
        """Each of the positions under its rank."""
        import numpy as np

        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        ends = [*cuts[1:].tolist(), len(ranks)]
        for rank, begin, end in zip(ranks[cuts].tolist(), cuts.tolist(), ends, strict=True):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[begin:end])
                continue
            self.buckets[rank] = [positions[begin:end]]
            at = rank
            for level in self.levels:
                word = at >> 6
                held = level[word]
                level[word] = held | 1 << (at & 63)
                if held:
                    break
                at = word

    def pop(self) -> tuple[int, list] | None:
        """The least rank and its bucket; none if the queue is empty."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | ((word & -word).bit_length() - 1)
        below = at
        for level in self.levels:
            word = below >> 6
            level[word] &= ~(1 << (below & 63))
            if level[word]:
                break
            below = word
        return at, self.buckets.pop(at)


class ByteBpe:
    """Ids of texts by the ranks of one file; ids of short pre-tokens are kept, as little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks = read_ranks(path)
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that together is a token.
        pairs = [
            (ranks[token[:cut]] * self.size + ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.joined = table[:, 0].copy(), table[:, 1].copy()
        # Tokens that make a pair of a lower rank than their own: their merges cannot be done all at once.
        self.reviving = np.zeros(self.size, bool)
        for part in (self.pairs // self.size, self.pairs % self.size):
            self.reviving[part[self.joined < part]] = True
        self.kept: dict[str, bytes] = {}

    def windows(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, window by window. A match looks only forward, so each may start a window."""
        begin, size = 0, WINDOW
        while begin < len(text):
            end = begin + size
            found = self.pattern.findall(text, begin, end)
            if end < len(text):
                if len(found) <= UNSURE:
                    size *= 2
                    continue
                del found[-UNSURE:]
            begin += sum(map(len, found))
            size = WINDOW
            yield found

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        held: list[list[list[str]]] = []
        size = 0
        for text in texts:
            parts: list[list[str]] = []
            done: list[bytes] = []
            for found in self.windows(text):
                parts.append(found)
                size += sum(map(len, found))
                if size >= TOGETHER:
                    *whole, last = self._answer([*held, parts])
                    yield from whole
                    done.append(last)
                    held, parts, size = [], [], 0
            if done:
                # The start of this text is answered already.
                yield b"".join([*done, *self._answer([parts])])
                size = 0
            else:
                held.append(parts)
        yield from self._answer(held)

    def _answer(self, held: list[list[list[str]]]) -> list[bytes]:
        known = self.kept
        new = list(set(chain.from_iterable(chain.from_iterable(held))).difference(known))
        known.update(zip(new, self.merge([piece.encode("utf-8") for piece in new]), strict=True))
        answers = [b"".join(map(known.__getitem__, chain.from_iterable(parts))) for parts in held]
        for piece in new:
            if len(piece) > KEPT_LENGTH:
                del known[piece]
        if len(known) > KEPT:
            known.clear()
        return answers

    def pair_ranks(self, left, right):
        import numpy as np

        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined[at], -1)

    def _behind_a_revival(self, rank: int, places, ids, after, before, piece_of):
        """Which of the places to be joined stand behind one, in the same piece, whose joining makes a lower rank.

        When a place is joined, a place just before it has been, one just behind it has not.
        """
        import numpy as np

        none = len(ids) - 1
        gone, left = after[places], before[places]
        right = after[gone]
        left_id = ids[left]
        left_id[np.append(False, gone[:-1] == left[1:])] = rank
        revives = np.zeros(len(places), bool)
        for ranks, beyond in (
            (self.pair_ranks(left_id, rank), left == none),
            (self.pair_ranks(np.full(len(places), rank), ids[right]), right == none),
        ):
            revives |= (ranks >= 0) & (ranks < rank) & ~beyond
        earlier = np.cumsum(revives) - revives
        first = np.flatnonzero(np.diff(piece_of[places], prepend=-1))
        return earlier > np.repeat(earlier[first], np.diff(np.append(first, len(places))))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens: in each the pair with the least rank, the leftmost of these, is joined until none has one.

        All pieces lie in one linked list of parts, named by their first byte, and share one queue: the least
        rank of all is the least of each piece that has it. An entry is stale if its part is gone or makes a pair of
        another rank by now. Positions of a rank are joined at once, of a run of overlapping ones every other from the
        left; those behind one that makes a pair of a lower rank wait until that pair has been joined.
        """
        import numpy as np

        whole = [self.ranks.get(piece) for piece in pieces]
        open_pieces = [piece for piece, rank in zip(pieces, whole, strict=True) if rank is None and piece]
        answers = iter(())
        if open_pieces:
            ends = np.cumsum([len(piece) for piece in open_pieces])
            size = int(ends[-1])
            ids = np.append(self.of_byte[np.frombuffer(b"".join(open_pieces), np.uint8)], 0)
            # Place ``size`` stands for no part.
            after, before = np.arange(1, size + 2), np.arange(-1, size)
            after[ends - 1] = size
            before[0] = size
            before[ends[:-1]] = size
            piece_of = np.repeat(np.arange(len(open_pieces)), np.diff(ends, prepend=0))
            alive = np.ones(size + 1, bool)
            pair = np.full(size + 1, -1)
            queue = RankQueue(self.size)

            def look(places) -> None:
                right = after[places]
                ranks = self.pair_ranks(ids[places], ids[right])
                ranks[right == size] = -1
                pair[places] = ranks
                hit = ranks >= 0
                if hit.any():
                    queue.push(ranks[hit], places[hit])

            look(np.arange(size))
            while (entry := queue.pop()) is not None:
                rank, bucket = entry
                places = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
                places = np.unique(places[pair[places] == rank])
                if not len(places):
                    continue
                found = places
                begins = np.append(True, after[places[:-1]] != places[1:])
                if not begins.all():
                    index = np.arange(len(places))
                    places = places[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
                if len(places) > 1 and self.reviving[rank]:
                    waits = self._behind_a_revival(rank, places, ids, after, before, piece_of)
                    if waits.any():
                        places = places[~waits]
                        rest = np.setdiff1d(found, places, assume_unique=True)
                        queue.push(np.full(len(rest), rank), rest)
                gone = after[places]
                end = after[gone]
                ids[places] = rank
                after[places] = end
                before[end] = places
                alive[gone] = False
                pair[gone] = -1
                left = before[places]
                look(np.concatenate((places, left[left < size])))
            alive[size] = False
            data = ids[:size][alive[:size]].astype("<i4").tobytes()
            stops = (4 * np.cumsum(alive[:size])[ends - 1]).tolist()
            answers = iter([data[a:b] for a, b in zip([0, *stops], stops, strict=False)])
        return [
            rank.to_bytes(4, "little") if rank is not None else next(answers) if piece else b""
            for piece, rank in zip(pieces, whole, strict=True)
        ]


_CODERS: dict[tuple[str, str], ByteBpe] = {}
_TOKENS: dict[str, object] = {}


def _others(docs: DataFrame, *replaced: str) -> tuple[list[str], str]:
    """Columns that are passed through, and their types as the start of a schema."""
    kept = [f for f in docs.schema if f.name not in replaced]
    return [f.name for f in kept], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``: each match of ``pattern`` encoded on its own.

    ``path`` names a file of base64 tokens and ranks that every executor can read. There are no special tokens: their
    strings are ordinary text. Null and empty texts have no ids. One row per row, repeated ones too; other columns are
    passed through, but for one named ``ids``. A task holds one batch; a text is cut into pre-tokens by windows, and a
    pre-token of n bytes takes n log n steps at most.
    """
    kept, kinds = _others(docs, "text", "ids")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if (path, pattern) not in _CODERS:
            _CODERS[path, pattern] = ByteBpe(path, pattern)
        coder = _CODERS[path, pattern]
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column("text"))
            begin, held, size = 0, [], 0
            for at, ids in enumerate(coder.encode(texts), 1):
                held.append(ids)
                size += len(ids)
                if size >= TOGETHER or at == batch.num_rows:
                    ends = np.cumsum([0, *[len(x) // 4 for x in held]]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<i4")))
                    part = batch.slice(begin, at - begin)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], [*kept, "ids"])
                    begin, held, size = at, [], 0

    return docs.select(*kept, "text").mapInArrow(work, f"{kinds}ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded`` (binary): the bytes of ``ids`` in a row. An id without a token is an error; null gives none."""
    kept, kinds = _others(rows, "decoded")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if path not in _TOKENS:
            ranks = read_ranks(path)
            tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                tokens[rank] = token
            _TOKENS[path] = pa.array(tokens, pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten()
            spread = _TOKENS[path].take(ids)
            if spread.null_count:
                raise ValueError("an id that the rank file does not have")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(counts)))
            bounds = np.frombuffer(spread.buffers()[1], np.int64)[spread.offset :][ends] if len(ids) else ends * 0
            data = memoryview(spread.buffers()[2] or b"") if len(ids) else memoryview(b"")
            texts = [bytes(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            column = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], [*kept, "decoded"])

    return rows.mapInArrow(work, f"{kinds}decoded binary")
