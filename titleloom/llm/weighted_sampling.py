"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import shuffle_partitions, staged

SAMPLES = 64
# Samples that one row of the drawing step takes: few, so that the generated code of that step stays small.
LANES = 4
# ln(a) is kept in steps of 2 ** -25 between -64 and 64.
STEPS = float(1 << 25)
# The least a of a text is exponential with the sum of its weights as rate: beyond REACH over that sum once in e ** 24 samples.
REACH = 24.0
WHITE_SPACE = "[ \t\n\r\f\u000b]+"


def _product(bits: Column) -> Column:
    """The product of two uniform numbers of 25 bits in (0, 1], from the lower 50 bits."""

    def uniform(shift: int) -> Column:
        return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0x1FFFFFF)) + 1

    return uniform(0) * uniform(25) / float(1 << 50)


def _exponential(product: Column) -> Column:
    """A draw from Gamma(2, 1): minus the logarithm of a product of two uniform numbers."""
    # Two uniforms of 1 stand for the least positive number.
    return F.greatest(-F.log(product), F.lit(1e-9))


def word_counts(rows: DataFrame, keys: list[str], pieces: list[tuple[Column, tuple[str, ...]]]) -> DataFrame:
    """``keys, h`` and a count per name: words (lower case, between white space) by hash.

    Each piece is a text with the names of those it is part of, so what several texts share is split once. Pieces of
    one text meet at white space.
    """
    names = sorted({name for _, of in pieces for name in of})
    texts = F.array(
        *[F.struct(text.alias("text"), *[F.lit(int(n in of)).alias(n) for n in names]) for text, of in pieces]
    )
    words = rows.select(*keys, F.explode(texts).alias("piece")).select(
        *keys, *[F.col(f"piece.{n}").alias(n) for n in names],
        F.explode(F.split(F.lower("piece.text"), WHITE_SPACE)).alias("word"),
    )
    return words.filter("word != ''").groupBy(*keys, F.xxhash64("word").alias("h")).agg(
        *[F.sum(n).alias(n) for n in names]
    )


def draws(terms: DataFrame, names: list[str], keys: list[str], reach: float | None) -> DataFrame:
    """``keys, h, g``, the logarithms of the weights, ``limit_name`` and per lane ``r, c, b``, null where no log is needed.

    With weight w a term's a is c * exp(-r * (t - b + 1)), so at least c * exp(-r) / w. As c = -ln p and r = -ln q, where p and
    q are products of two uniforms, that is at least (1 - p) * q / w: no logarithm. Terms for which this is beyond
    ``reach`` over the sum of the weights are not drawn for any of the texts. A sample whose least step is
    within the text's limit is that of all terms.
    """
    weight = {n: 1 + F.log(F.col(n).cast("double")) for n in names}
    if reach is None:
        cut, limits = F.lit(None).cast("double"), [F.lit((1 << 63) - 1).alias(f"limit_{n}") for n in names]
    else:
        same = Window.partitionBy(*keys)
        terms = terms.select("*", *[F.sum(weight[n]).over(same).alias(f"sum_{n}") for n in names])
        # A little more, against rounding. Nothing is beyond 1.
        cut = F.greatest(*[weight[n] / F.col(f"sum_{n}") * (reach * (1 + 1e-6)) for n in names], F.lit(0.0))
        limits = [
            F.when(F.col(f"sum_{n}") < reach, F.lit((1 << 63) - 1))
            .otherwise(F.floor((F.log(reach / F.col(f"sum_{n}")) + 64) * STEPS) - 1)
            .alias(f"limit_{n}")
            for n in names
        ]
    split = terms.select(
        *keys, "h", *[F.log(weight[n]).alias(f"w_{n}") for n in names], *limits, cut.alias("cut"),
        F.explode(F.array(*[F.lit(g) for g in range(SAMPLES // LANES)])).alias("g"),
    )
    hashed = split.select(
        "*",
        *[F.xxhash64("h", "g", F.lit(2 * k)).alias(f"x{k}") for k in range(LANES)],
        *[F.xxhash64("h", "g", F.lit(2 * k + 1)).alias(f"y{k}") for k in range(LANES)],
    )
    products = hashed.select(
        "*",
        *[_product(F.col(f"x{k}")).alias(f"q{k}") for k in range(LANES)],
        *[_product(F.col(f"y{k}")).alias(f"p{k}") for k in range(LANES)],
    )

    def needed(k: int, value: Column) -> Column:
        return value if reach is None else F.when((1 - F.col(f"p{k}")) * F.col(f"q{k}") < F.col("cut"), value)

    return products.select(
        *keys, "h", "g", *[f"w_{n}" for n in names], *[f"limit_{n}" for n in names],
        *[needed(k, _exponential(F.col(f"q{k}"))).alias(f"r{k}") for k in range(LANES)],
        *[needed(k, F.log(_exponential(F.col(f"p{k}")))).alias(f"c{k}") for k in range(LANES)],
        # The 14 upper bits that neither gamma draw has read, from both hashes.
        *[
            ((F.shiftrightunsigned(f"x{k}", 50) * 16384 + F.shiftrightunsigned(f"y{k}", 50)) / float(1 << 28)).alias(f"b{k}")
            for k in range(LANES)
        ],
    )


def signatures(
    rows: DataFrame, keys: list[str], pieces: list[tuple[Column, tuple[str, ...]]], reach: float | None = None
) -> DataFrame:
    """``keys`` and per name of the ``pieces`` an array: ``SAMPLES`` samples of that text, none without words.

    ``keys`` name a row and are not null. Where the rows already lie together by them, nothing is shuffled.

    A word that occurs n times is a term of weight 1 + ln n. For each sample k, every term draws r and c from
    Gamma(2, 1) and b from the unit interval, all from hashes of the term and k, so the draws of two samples are
    independent and those of a term are the same in all texts. With weight w it is quantised to
    t = floor(ln w / r + b) and gets a, where ln a = ln c - r * (t - b + 1). The (term, t) with the smallest a is
    sample k: two texts have the same one with a probability equal to their generalised Jaccard similarity, the sum
    of the smaller weights over that of the larger. A sample is kept as ``k * 2 ** 24`` plus 24 bits of its name.

    With ``reach`` terms that can hardly be a sample are left out, and ``sure`` says whether all samples of a row are
    those of all terms; a row that is not sure has to be drawn without ``reach``.
    """
    names = sorted({name for _, of in pieces for name in of})
    drawn = draws(word_counts(rows, keys, pieces), names, keys, reach)

    def packed(name: str, k: int) -> Column:
        r, c, b = F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"b{k}")
        t = F.floor(F.col(f"w_{name}") / r + b)
        step = F.floor(F.least(F.greatest(c - r * (t - b + 1) + 64, F.lit(0.0)), F.lit(127.999999)) * STEPS)
        # In one number, value first: the smallest number has the smallest value. Without the word it is null.
        value = F.shiftleft(step, 24).bitwiseOR(F.col("h").bitwiseXOR(t * 0x9E3779).bitwiseAND(F.lit(0xFFFFFF)))
        return value if reach is None else F.when(r.isNotNull(), value)

    limits = [] if reach is None else [F.max(f"limit_{n}").alias(f"limit_{n}") for n in names]
    least = drawn.groupBy(*keys, "g").agg(
        *[F.min(packed(n, k)).alias(f"{n}_{k}") for n in names for k in range(LANES)], *limits
    )

    def sample(name: str, k: int) -> Column:
        place = F.shiftleft(F.col("g") * LANES + k, 24)
        return place.bitwiseOR(F.col(f"{name}_{k}").bitwiseAND(F.lit(0xFFFFFF)).cast("int"))

    lanes = least.select(
        *keys, "g", *[F.array(*[sample(n, k) for k in range(LANES)]).alias(n) for n in names],
        *([] if reach is None else [_sure(names).alias("sure")]),
    )
    sure = [] if reach is None else [F.bool_and("sure").alias("sure")]
    found = lanes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", *names))).alias("lanes"), *sure)
    return found.select(
        *keys, *[F.filter(F.flatten(F.col(f"lanes.{n}")), lambda x: x.isNotNull()).alias(n) for n in names],
        *([] if reach is None else ["sure"]),
    )


def _sure(names: list[str]) -> Column:
    """Whether the least steps of a row are within its limits; a text without words has no limit."""
    held = [
        F.coalesce(F.shiftrightunsigned(f"{n}_{k}", 24) <= F.col(f"limit_{n}"), F.lit(False))
        for n in names
        for k in range(LANES)
    ]
    empty = [F.col(f"limit_{n}").isNull() for n in names for _ in range(LANES)]
    every = F.lit(True)
    for inside, none in zip(held, empty, strict=True):
        every = every & (none | inside)
    return every


def fingerprints(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, samples``: the signature of one text per row; rows without words are left out."""
    return signatures(rows, keys, [(text, ("samples",))])


def fingerprint_text(samples: Column) -> Column:
    """Eight hexadecimal digits per sample; empty without terms."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """The share of samples in which two fingerprints agree; two empty ones: 1, an empty one and another: 0."""
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left, right)) / SAMPLES
    )


def neighbours_by_id(docs: DataFrame) -> DataFrame:
    """``key_id, key_null, key_text``, the same of ``prev``, ``prev_chars, rows``: the document before each one, by doc_id, in a ring.

    Ids are sorted by ranges; only the last document of each range is carried to the next range.
    """
    order = [F.col("key_null").desc(), F.col("key_id"), F.col("key_text")]
    me = F.struct("known", "key_id", "key_text", "n_chars")
    ids = (
        docs.groupBy("key_id", "key_null", "key_text")
        .agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("rows"))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    )
    ranges = staged(ids.withColumn("range", F.spark_partition_id()).withColumn("known", ~F.col("key_null")), "ids")
    # One row per range.
    edges = ranges.groupBy("range").agg(F.max(me).alias("last"))
    by_range = Window.orderBy("range")
    all_ranges = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        F.col("range").alias("to_range"),
        F.coalesce(F.lag("last").over(by_range), F.last("last").over(all_ranges)).alias("carried"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    linked = ranges.withColumn("prev", F.lag(me).over(inside)).join(
        F.broadcast(carried), F.col("range") == F.col("to_range")
    )
    prev = F.coalesce("prev", "carried")
    return linked.select(
        "key_id", "key_null", "key_text", prev["key_id"].alias("prev_id"), (~prev["known"]).alias("prev_null"),
        prev["key_text"].alias("prev_text"), prev["n_chars"].alias("prev_chars"), "rows",
    )


def fingerprint_documents(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    document is that of the next larger doc_id; after the last comes the first. In the edited text the last quarter of
    the code points is replaced by as many of the next document's first, or all it has. A null text is empty; an
    empty fingerprint is like another empty one (1.0) and unlike any other (0.0). Rows equal in doc_id and text are
    fingerprinted once, as one document in the order, and each comes back; rows that share a doc_id alone follow each
    other. A null doc_id comes first. Extra columns are not read. ``reach`` decides the work, not the result: texts whose samples
    are not sure with it are drawn again in full.
    """
    # All uses of the texts need these columns and no others, so that they read one exchange.
    keys = ["key_id", "key_null", "key_text"]
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        F.coalesce("doc_id", zero).alias("key_id"),
        F.col("doc_id").isNull().alias("key_null"),
        F.xxhash64("text").alias("key_text"),
        "text",
    )
    ring = staged(
        neighbours_by_id(texts.select(*keys, F.char_length("text").alias("n_chars"))), "ring"
    )
    repeated = not ring.filter("rows > 1").isEmpty()
    if repeated:
        texts = texts.dropDuplicates(keys)
    # The texts move once, to where their keys lie; words and samples are counted there.
    placed = texts.join(ring, keys)
    nothing = F.array().cast("array<int>")
    previous = [F.col(f"prev_{k}").alias(f"key_{k}") for k in ("id", "null", "text")]
    heads = placed.select(
        *previous, F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head")
    )
    n_chars = F.char_length("text")
    body = F.substring("text", F.lit(1), n_chars - F.floor(n_chars / 4).cast("int"))
    # What both texts begin with, up to white space: its words are split and drawn once.
    common = F.regexp_extract(body, r"(?s)^(.*[ \t\n\r\f\x0B])", 1)
    edited = placed.join(heads, keys).select(
        *keys, "prev_id", "prev_null", "prev_text", "rows", "text", n_chars.cast("long").alias("n_chars"),
        F.concat(body, F.col("head")).alias("edited"), common.alias("common"),
    )
    behind = F.char_length("common") + 1

    def printed(part: DataFrame, reach: float | None) -> DataFrame:
        prints = signatures(
            part,
            keys,
            [
                (F.col("common"), ("own", "changed")),
                (F.substring("text", behind, F.lit(2**31 - 1)), ("own",)),
                (F.substring("edited", behind, F.lit(2**31 - 1)), ("changed",)),
            ],
            reach,
        )
        return staged(
            part.select(
                *keys, "prev_id", "prev_null", "prev_text", "rows", "n_chars",
                F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            )
            .join(prints, keys, "left")
            .withColumn("own", F.coalesce("own", nothing))
            .withColumn("changed", F.coalesce("changed", nothing)),
            "prints",
        )

    done = printed(edited, reach)
    unsure = done.filter(~F.col("sure"))
    if not unsure.isEmpty():
        exact = printed(edited.join(unsure.select(*keys), keys, "left_semi"), None)
        done = done.filter(F.coalesce("sure", F.lit(True))).drop("sure").unionByName(exact)
    else:
        done = done.drop("sure")
    paired = done.drop("prev_id", "prev_null", "prev_text").join(
        done.select(*previous, F.col("own").alias("next_own")), keys
    )
    if repeated:
        paired = paired.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return paired.select(
        F.when(~F.col("key_null"), F.col("key_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
