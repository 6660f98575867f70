"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import join_counted, staged

BITS = 64
SEED = 42
# Fingerprints of one bucket meet pairwise up to this many; larger buckets are searched by looking up neighbours.
PAIRED = 128
UNDER = (1 << 64) - 1


def simhash(text: str | None, shingle: int) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it; 0 without words.

    A-Z are lower-cased, words lie between ASCII white space, a shingle is ``shingle`` words with one space between
    them, repeats included. Fewer words are one shingle.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if count == 1:
        hashes = [digest(join(words), SEED)]
    elif shingle == 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(join(words[i : i + shingle]), SEED) for i in range(count)]
    ones = np.zeros(BITS, np.int64)
    # Parts of fixed size, so that a text of any length needs the same memory for its bits.
    for begin in range(0, count, 8192):
        part = np.array(hashes[begin : begin + 8192], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    chosen = np.packbits(ones * 2 > count, bitorder="little")
    return int(chosen.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` as a signed long."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints = [_signed(simhash(x.as_py(), shingle)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(prints, pa.int64())], [*kept, "fingerprint"]
            )

    kept = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(work, f"{kinds}, fingerprint long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks such that any two numbers that differ in at most ``radius`` bits agree under one of them.

    Each bit position holds a vector of ``radius + 1`` bits that is not zero; a mask belongs to each such vector v and
    has the positions whose vector has an odd product with v. Of ``radius`` differing positions, some v other
    than zero has an even product with all, as there is one dimension more than positions. So none of them is in
    the mask of v.
    """
    vectors = (1 << (radius + 1)) - 1
    held = [1 + i % vectors for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(held) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(prints: DataFrame, radius: int, paired: int = PAIRED) -> DataFrame:
    """``a, b`` with ``a < b``: all pairs of distinct fingerprints (column ``fingerprint``) within ``radius`` bits.

    ``prints`` is read several times. Every pair within the radius shares the bucket of one mask. Buckets of
    at most ``paired`` fingerprints are compared inside; for the fingerprints of a larger one, every number that
    differs from them in up to ``radius`` bits outside its mask is looked up, so the work stays in proportion to the
    fingerprints. Nothing is left out.
    """
    spark = prints.sparkSession
    masks = covering_masks(radius)
    table = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for i, m in enumerate(masks)
        ])
    )
    entries = prints.select("fingerprint", table.alias("e")).select("e.t", "e.key", "fingerprint")
    sizes = staged(entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    met = staged(join_counted(staged(entries, "keys"), sizes, ["t", "key"], "n"), "entries")
    small = met.filter(F.col("n") <= paired)
    left = small.select("t", "key", F.col("fingerprint").alias("a"))
    right = small.select("t", "key", F.col("fingerprint").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    large = met.filter(F.col("n") > paired)
    if not large.isEmpty():
        flips = spark.createDataFrame(
            [(i, _signed(x)) for i, m in enumerate(masks) for x in _flips(~m & UNDER, radius)], "t int, flip long"
        )
        around = large.join(F.broadcast(flips), "t").select(
            F.col("fingerprint").alias("a"), F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("b")
        ).filter(F.col("a") < F.col("b")).distinct()
        pairs = pairs.unionByName(
            around.join(prints.select(F.col("fingerprint").alias("b")), "b").select("a", "b")
        )
    return pairs.distinct()


def _flips(free: int, radius: int) -> list[int]:
    """Numbers with 1 to ``radius`` bits, all inside ``free``."""
    from itertools import combinations

    places = [1 << i for i in range(BITS) if free >> i & 1]
    return [sum(c) for r in range(1, radius + 1) for c in combinations(places, r)]


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, root``: for every node (column ``node``, longs) the smallest node that it is linked to by any path.

    Each round a node takes the smallest root among its neighbours and then its root's root; rounds end when none
    changes. Neighbours of a node are few (bounded by the radius), roots may be shared by many: their join has one
    row per root on its other side and no sort by a hot key is needed beyond what adaptive skew handling splits.
    """
    both = staged(
        pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
            pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
        ),
        "links",
    )
    linked = both.select(F.col("src").alias("node")).distinct()
    labels = staged(linked.withColumn("root", F.col("node")), "labels")
    while True:
        offered = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("offer"))
        taken = staged(
            labels.join(offered, labels["node"] == offered["src"])
            .select("node", F.least("root", "offer").alias("root"), (F.col("offer") < F.col("root")).alias("moved")),
            "offers",
        )
        if taken.filter("moved").isEmpty():
            break
        roots = taken.select(F.col("node").alias("at"), F.col("root").alias("above"))
        used = taken.groupBy("root").agg(F.count("*").alias("users"))
        jumps = staged(
            used.join(roots, used["root"] == roots["at"]).select("root", "above", "users"), "jumps"
        )
        labels = staged(
            join_counted(taken.select("node", "root"), jumps, ["root"], "users").select(
                "node", F.col("above").alias("root")
            ),
            "labels",
        )
    return nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keys`` and ``fingerprint, component_id, root``: documents linked by fingerprints at most ``radius`` bits apart.

    ``component_id`` is the smallest doc_id that can be reached over links, the own included; ``root`` names the
    component also where doc_ids repeat. Documents of equal
    fingerprint are linked, also those without words (fingerprint 0; null text: no words). Work on pairs is done once per distinct
    fingerprint. One row per input row; rows that repeat a doc_id are linked only if their texts are; a
    null doc_id counts for a component only if it has no other. Extra columns are not read; further ``keys`` are
    passed through.
    """
    printed = staged(fingerprints(docs.select(*dict.fromkeys([*keys, "doc_id", "text"])), shingle), "fingerprints")
    distinct = staged(
        printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct"
    )
    pairs = staged(close_pairs(distinct.select("fingerprint"), radius), "pairs")
    rooted = components(distinct.select(F.col("fingerprint").alias("node")), pairs)
    named = staged(
        distinct.join(rooted, distinct["fingerprint"] == rooted["node"]).select(
            "fingerprint", "first", "copies", "root"
        ),
        "rooted",
    )
    groups = staged(
        named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints")), "groups"
    )
    classes = staged(join_counted(named, groups, ["root"], "prints"), "classes").select(
        "fingerprint", "copies", "component_id", "root"
    )
    return join_counted(printed, classes, ["fingerprint"], "copies").select(*keys, "fingerprint", "component_id", "root")
