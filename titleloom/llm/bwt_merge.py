"""Repeated byte strings across documents by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import staged

LENGTH = 50
GRAM = 16
# Strings whose transforms are merged at once (few enough for a core's cache), and strings of one shard.
MERGED = 2048
SHARD = 64
# Contexts that are cut out of texts at once.
TOGETHER = 32_768
# Texts whose anchors are taken at once.
TEXTS = 1024
# Rows of one anchor that are held to look for partners; of an anchor with more all are taken.
HELD = 1_000_000
# A spot is an anchor's hash with this number of lower bits replaced by those of its place.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """``(positions, hashes)`` of the grams that are the least by hash in some window of ``length`` bytes.

    Every string of ``length`` bytes holds one, at a place that the string alone decides. So two equal strings share
    the hash of an anchor at the same place inside.
    """
    import numpy as np

    n = len(data) - gram + 1
    wide = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    value = (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)

    def sliding(x, best):
        reach = 1
        while 2 * reach <= wide:
            x, reach = best(x[: len(x) - reach], x[reach:]), 2 * reach
        rest = wide - reach
        return best(x[: len(x) - rest], x[rest:]) if rest else x

    least = sliding(value, np.minimum)
    padded = np.concatenate((np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)))
    at = np.flatnonzero(sliding(padded, np.maximum) == value)
    return at, value[at].view(np.int64)


def shard_transform(strings: list[bytes], width: int):
    """The sorted suffixes of a shard as ``(string, offset, symbol before, next row)``.

    Bytes are raised by one, 0 ends a string; equal suffixes stand in any order. ``next row`` is the row of the
    suffix that begins one symbol earlier, and the row of the string's end for a whole string.
    """
    import numpy as np

    n = len(strings)
    lengths = np.array([len(s) for s in strings])
    grid = np.zeros((n, 2 * width + 1), np.uint8)
    for i, s in enumerate(strings):
        grid[i, : len(s)] = np.frombuffer(s, np.uint8) + 1
    views = np.lib.stride_tricks.sliding_window_view(grid, width + 1, axis=1)[:, : width + 1]
    string, offset = np.nonzero(np.arange(width + 1)[None, :] <= lengths[:, None])
    suffixes = np.ascontiguousarray(views[string, offset]).view(f"S{width + 1}").ravel()
    order = np.argsort(suffixes)
    string, offset = string[order], offset[order]
    row = np.zeros((n, width + 1), np.int64)
    row[string, offset] = np.arange(len(string))
    before = np.where(offset > 0, grid[string, np.maximum(offset, 1) - 1], 0).astype(np.uint8)
    following = np.where(offset > 0, row[string, np.maximum(offset, 1) - 1], row[string, lengths[string]])
    return string, offset, before, following


def merged_intervals(strings: list[bytes], length: int, shard: int = SHARD):
    """``(string, offset, block)`` of all suffixes: equal blocks have equal first ``length`` bytes.

    Suffixes of repeated blocks come first, in merged order, then those that are alone in theirs.

    The transforms of the shards are merged by refining their interleave: each round deals the rows out by the two
    symbols before them, in order, which sorts the rows of all shards by two symbols more. A block holds the rows that
    agree so far, so its bounds are the common prefixes shorter than the symbols dealt. Suffixes are sorted within
    shards only. A row that has met the end of its string is a block of its own. A row alone in its block stays alone
    whatever stands before it, so it is not dealt again.
    """
    import numpy as np

    width = max(map(len, strings))
    parts, base = [], 0
    for begin in range(0, len(strings), shard):
        string, offset, before, following = shard_transform(strings[begin : begin + shard], width)
        parts.append((string + begin, offset, before.astype(np.uint16), (following + base).astype(np.int32)))
        base += len(string)
    string, offset, one, step = (np.concatenate(x) for x in zip(*parts, strict=True))
    two = np.where(offset == 1, 0, one[step] * 256 + one).astype(np.uint16)
    order, block = np.arange(base, dtype=np.int32), np.zeros(base, np.int32)
    for before, following in [(two, step[step])] * (length // 2) + [(one, step)] * (length % 2):
        symbol = before[order]
        dealt = np.argsort(symbol, kind="stable")
        symbol, block = symbol[dealt], block[dealt]
        order = following[order[dealt]]
        new = (symbol & 255) == 0
        new[:1] = True
        new[1:] |= (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        repeated = ~(new & np.append(new[1:], True))
        order, block = order[repeated], np.cumsum(new, dtype=np.int32)[repeated]
    alone = np.ones(base, bool)
    alone[order] = False
    order = np.concatenate((order, np.flatnonzero(alone)))
    block = np.concatenate((block, base + np.arange(len(order) - len(block))))
    return string[order], offset[order], block


def first_holders(strings: list[bytes], holders: list[int], length: int):
    """``(string, begin, end, holder)``: runs of offsets of whole windows, by string and offset.

    The holder of a run is the smallest holder of any string that has the window at each of its offsets.
    """
    import numpy as np

    string, offset, block = merged_intervals(strings, length)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    least = np.minimum.reduceat(np.array(holders, np.int64)[string], starts)
    windows = np.array([len(s) - length + 1 for s in strings])
    found = np.zeros((len(strings), max(map(len, strings)) + 1), np.int64)
    found[string, offset] = np.repeat(least, np.diff(np.append(starts, len(block))))
    string, offset = np.nonzero(np.arange(found.shape[1])[None, :] < windows[:, None])
    holder = found[string, offset]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (holder[1:] != holder[:-1])
    begins = np.flatnonzero(new)
    ends = offset[np.append(begins[1:], len(string)) - 1] + 1
    return string[begins], offset[begins], ends, holder[begins]


def sides(data: bytes, at, length: int = LENGTH, gram: int = GRAM):
    """Hashes of 32 bits of the bytes before (lower half) and behind the grams at ``at``, 0 where the text is too short.

    A string of ``length`` bytes around a gram holds half of the bytes beside the gram on one side at least. So where two texts
    share such a string, they share a gram and the hash of one side.
    """
    import numpy as np

    half = (length - gram + 1) // 2
    wide = 8 if half >= 8 else 1
    words = np.ndarray((len(data) - wide + 1,), f"<u{wide}", data, strides=(1,))
    steps = [*range(0, half - wide, wide), half - wide]

    def hashed(begin, inside):
        value, begin = np.zeros(len(at), np.uint64), np.where(inside, begin, 0)
        for step in steps:
            value = (value ^ words[np.where(inside, begin + step, 0)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return np.where(inside, (value >> np.uint64(32)) | np.uint64(1), np.uint64(0))

    left, right = hashed(at - half, at >= half), hashed(at + gram, at + gram + half <= len(data))
    return (left | right << np.uint64(32)).view(np.int64)


def _spots(texts: DataFrame, length: int) -> DataFrame:
    """``spot, sides, far, key_text`` per anchor: 40 bits of its hash and 24 of its place, the sides, the rest of the place."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            # Copies that are read together say the same.
            once = np.unique(batch.column("key_text").to_numpy(zero_copy_only=False), return_index=True)[1]
            batch = batch.take(pa.array(once))
            contents = batch.column("content").to_pylist()
            found = [anchors(x, length) for x in contents]
            rows = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            at, value = (np.concatenate(x) for x in zip(*found, strict=True))
            beside = [sides(x, p, length) for x, (p, _) in zip(contents, found, strict=True) if len(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value & ~PLACE | at & PLACE), pa.array(np.concatenate(beside) if beside else [], pa.int64()),
                 pa.array(at >> PLACE_BITS), batch.column("key_text").take(pa.array(rows))],
                ["spot", "sides", "far", "key_text"],
            )

    return texts.select("key_text", "content").mapInArrow(work, "spot long, sides long, far long, key_text long")


def _with_partner(spots: DataFrame, held: int = HELD) -> DataFrame:
    """``key_text, pos`` of the anchors that another text holds with the same bytes on one side, so with an equal hash of them.

    Rows of an anchor stand together. Those that only look alike are found out later, as contexts are compared by bytes.
    """

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(spot, far, text) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(text), pa.array(spot & PLACE | far << PLACE_BITS)], ["key_text", "pos"])

        def partnered(spot, side, far, text):
            group = np.cumsum(np.append(False, spot[1:] >> PLACE_BITS != spot[:-1] >> PLACE_BITS)).astype(np.int64)
            found = np.zeros(len(spot), bool)
            for value in (side & 0xFFFFFFFF, side >> 32 & 0xFFFFFFFF):
                key = group << 32 | value
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                many = np.minimum.reduceat(text[order], starts) < np.maximum.reduceat(text[order], starts)
                found[order] |= np.repeat(many, np.diff(np.append(starts, len(order)))) & (value[order] != 0)
            return spot[found], far[found], text[found]

        waiting, flooded = None, None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("spot", "sides", "far", "key_text")]
            # Copies of a text say the same.
            new = np.append(True, np.any([x[1:] != x[:-1] for x in (rows[0], rows[2], rows[3])], axis=0))[: len(rows[0])]
            rows = [x[new] for x in rows]
            if waiting is not None:
                rows = [np.concatenate(x) for x in zip(waiting, rows, strict=True)]
            if not len(rows[0]):
                continue
            anchor = rows[0] >> PLACE_BITS
            if flooded is not None:
                more = int(np.searchsorted(anchor != flooded, True))
                yield out(rows[0][:more], rows[2][:more], rows[3][:more])
                rows, anchor = [x[more:] for x in rows], anchor[more:]
                if not len(anchor):
                    waiting = None
                    continue
                flooded = None
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                yield out(*partnered(*[x[:last] for x in rows]))
            waiting = [x[last:] for x in rows]
            if len(waiting[0]) > held:
                yield out(waiting[0], waiting[2], waiting[3])
                waiting, flooded = None, int(anchor[-1])
        if waiting is not None:
            yield out(*partnered(*waiting))

    anchor = F.shiftright("spot", PLACE_BITS)
    return (
        spots.repartition(anchor).sortWithinPartitions("spot", "key_text", "far").mapInArrow(work, "key_text long, pos long")
    )


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """``key_id, key_text, pos, context``: the bytes in which a window around a shared anchor can lie."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            content, hits = batch.column("content").to_pylist(), batch.column("hits")
            doc = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy(zero_copy_only=False))
            pos = hits.flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(doc), TOGETHER):
                rows, places = doc[at : at + TOGETHER], pos[at : at + TOGETHER]
                begins, ends = np.maximum(places - (length - GRAM), 0), places + length
                cut = [content[i][b:e] for i, b, e in zip(rows.tolist(), begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(rows)) for c in ("key_id", "key_text")],
                     pa.array(places), pa.array(cut, pa.binary())],
                    ["key_id", "key_text", "pos", "context"],
                )

    return docs.select("key_id", "key_text", "content", "hits").mapInArrow(
        work, "key_id long, key_text long, pos long, context binary"
    )


RUNS = "array<struct<begin:int,end:int,holder:long>>"
COVERS = "array<struct<begin:long,end:long>>"


def _decided(contexts: DataFrame, length: int) -> DataFrame:
    """``anchor, context_key, runs``: per window of a context the smallest doc that holds it, in runs.

    Contexts of one anchor lie together; those of many anchors are merged at once, up to ``MERGED`` contexts, more only
    where one anchor has more.
    """

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(rows: list) -> pa.RecordBatch:
            string, begin, end, holder = first_holders(
                [r["context"] for r in rows], [r["first"] for r in rows], length
            )
            runs = pa.StructArray.from_arrays(
                [pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(holder, pa.int64())],
                ["begin", "end", "holder"],
            )
            bounds = np.searchsorted(string, np.arange(len(rows) + 1))
            return pa.RecordBatch.from_arrays(
                [*[pa.array([r[c] for r in rows], pa.int64()) for c in ("anchor", "context_key")],
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)],
                ["anchor", "context_key", "runs"],
            )

        waiting: list = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(waiting) >= MERGED and waiting[-1]["anchor"] != row["anchor"]:
                    yield flush(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield flush(waiting)

    return contexts.mapInArrow(work, f"anchor long, context_key long, runs {RUNS}")


def _cut(docs: DataFrame) -> DataFrame:
    """Documents without their covered bytes; covers are sorted and may overlap."""

    def work(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out, covers = [], batch.column("covers")
            begins, ends = (x.to_pylist() for x in covers.flatten().flatten())
            bounds = np.append(0, np.cumsum(covers.value_lengths().to_numpy(zero_copy_only=False))).tolist()
            for data, a, b in zip(batch.column("content").to_pylist(), bounds, bounds[1:], strict=False):
                kept, end, spans, removed = [], 0, 0, 0
                for start, stop in zip(begins[a:b], ends[a:b], strict=True):
                    if start > end or not spans:
                        kept.append(data[end:start])
                        spans += 1
                    removed += max(0, stop - max(end, start))
                    end = max(end, stop)
                kept.append(data[end:])
                out.append((len(data), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return docs.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: documents without bytes that an earlier one holds in a run.

    Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id goes; strings
    are judged on the input and never cross documents. A null text is empty. Rows equal in doc_id and text are one
    document and give one row; rows that share a doc_id do not count for each other. A null doc_id is before all
    others. Extra columns are not read.
    """
    none = F.lit(-(1 << 63)).cast("long")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), none).alias("key_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    ).withColumn("key_text", F.xxhash64("content"))
    keys = ["key_id", "key_text"]
    # Of equal texts the first document is searched; the others go whole if they have a window.
    firsts = staged(texts.groupBy("key_text").agg(F.min("key_id").alias("key_id")), "firsts", drop_shuffles=True)
    hits = staged(
        _with_partner(_spots(texts, length))
        .repartition("key_text")
        .groupBy("key_text")
        .agg(F.sort_array(F.collect_set("pos")).alias("hits")),
        "hits", drop_shuffles=True,
    )
    # The rest of a member's columns follows from these four; neighbouring contexts overlap, so they are packed well.
    cut = staged(_contexts(texts.join(firsts.join(hits, "key_text"), keys), length), "contexts", "zstd", drop_shuffles=True)
    before = F.least("pos", F.lit(length - GRAM))
    members = cut.select(
        *keys,
        (F.col("pos") - before).alias("begin"),
        F.xxhash64(F.substring("context", before.cast("int") + 1, F.lit(GRAM))).alias("anchor"),
        F.xxhash64("context").alias("context_key"),
        "context",
    )
    distinct = (
        members.select("anchor", "context", "key_id")
        .repartition("anchor")
        .groupBy("anchor", "context")
        .agg(F.min("key_id").alias("first"))
        .withColumn("context_key", F.xxhash64("context"))
    )
    decided = staged(
        _decided(distinct.sortWithinPartitions("anchor", "context"), length), "decided", "zstd", drop_shuffles=True
    )
    # One decided row per key, so a key with many members is only streamed past it.
    found = members.drop("context").join(decided, ["anchor", "context_key"])
    later = F.filter("runs", lambda r: r["holder"] < F.col("key_id"))
    cover = F.transform(
        later,
        lambda r: F.struct((F.col("begin") + r["begin"]).alias("begin"), (F.col("begin") + r["end"] + length - 1).alias("end")),
    )
    covers = staged(
        found.select(*keys, cover.alias("cover"))
        .filter(F.size("cover") > 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.flatten(F.collect_list("cover"))).alias("covers")),
        "covers", "zstd", drop_shuffles=True,
    )
    none_covered = F.array().cast(COVERS)
    searched = firsts.join(covers, keys, "left").select(*keys, F.coalesce("covers", none_covered).alias("covers"))
    n_bytes = F.octet_length("content").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), n_bytes.alias("end")))
    copied = F.when(n_bytes >= length, whole).otherwise(none_covered)
    whole_texts = texts.repartition(*keys).dropDuplicates(keys).join(searched, keys, "left")
    return _cut(whole_texts.select("doc_id", "content", F.coalesce("covers", copied).alias("covers")))
