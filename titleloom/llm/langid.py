"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import staged

DIMENSIONS = 4096
CENTROIDS = 4
# Rows per language that the centroids are fitted on; statistics of n-grams come from all labelled rows.
FITTED_ROWS = 400
UNDETERMINED = "und"
# A document is rejected below this share of the median cosine of fitted texts of like length.
SHARE = 0.5
# Length classes: powers of two of the number of n-grams.
CLASSES = 24
ROUNDS = 12


_LETTERS: list = []


def _letters():
    """Which code points of the basic plane are letters."""
    import numpy as np

    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    return _LETTERS[0]


def ngram_counts(text: str | None):
    """Hashed counts of letter n-grams (1 to 3, word ends marked) as a vector, or None without letters.

    Runs of other characters are one word end. Letters beyond the basic plane count as one further letter.
    """
    import numpy as np

    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return None
    wide = code >= 1 << 16
    if wide.any():
        astral = np.array([chr(c).isalpha() for c in code[wide]])
        code = code.copy()
        code[wide] = np.where(astral, 0xAC00, 0x20)
    letter = _letters()[code]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    word = np.where(letter, code, 0)[kept]
    code = np.zeros(len(word) + 2, np.uint32)
    code[1:-1] = word
    mix = np.uint32(0x9E3779B1)
    one = code * mix
    two = (one[:-1] ^ code[1:]) * mix
    three = (two[:-1] ^ code[2:]) * mix
    grams = np.concatenate((one, two, three)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    return np.bincount(grams, minlength=DIMENSIONS).astype(np.float32)


def _unit(counts, weights):
    import numpy as np

    vector = np.log1p(counts) * weights
    length = float(np.sqrt(vector @ vector))
    return vector / length if length else vector


@dataclass
class Model:
    """Inverse document frequencies, unit centroids with their language, and the least cosine of each language by length."""

    languages: list[str]
    weights: object
    centroids: object
    owner: object
    least: object


def _document_frequencies(labelled: DataFrame):
    """Documents with each hashed n-gram, and the number of documents: summed per task, then over all."""
    import numpy as np

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for value in batch.column("text"):
                counts = ngram_counts(value.as_py())
                if counts is not None:
                    seen[:-1] += counts > 0
                    seen[-1] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["gram", "n"])

    sums = labelled.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = np.zeros(DIMENSIONS + 1)
    for row in sums.collect():
        found[row["gram"]] = row["n"]
    return found[:-1], found[-1]


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """Up to ``rows`` rows per language, those with the smallest hash; found among a fraction that surely holds them."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # One number per class of the model, as the model itself has its centroids on the driver.
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, (2.0 * rows + 200) / n)])
    draw = (F.xxhash64("doc_id", F.lit(3)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("__draw")
    few = labelled.select("doc_id", "text", "lang", draw)
    if not counts:
        return few.select("lang", "text")
    rank = Window.partitionBy("lang").orderBy("__draw", "doc_id", F.xxhash64("text"))
    return (
        few.filter(F.col("__draw") < F.element_at(shares, F.col("lang")))
        .withColumn("__rank", F.row_number().over(rank))
        .filter(F.col("__rank") <= rows)
        .select("lang", "text")
    )


def _cluster(vectors, count: int):
    """Spherical k-means from farthest points; empty clusters vanish."""
    import numpy as np

    chosen = [vectors.mean(axis=0)]
    while len(chosen) < min(count, len(vectors)):
        nearest = (vectors @ np.stack([c / max(np.linalg.norm(c), 1e-12) for c in chosen]).T).max(axis=1)
        chosen.append(vectors[int(nearest.argmin())])
    centers = np.stack([c / max(np.linalg.norm(c), 1e-12) for c in chosen])
    for _ in range(ROUNDS):
        owner = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[owner == k].sum(axis=0) for k in np.unique(owner)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def _windows(text: str) -> Iterator[str]:
    """The text, and of each power of two below its length the first characters and those in its middle."""
    yield text
    size = 1
    while size < len(text):
        yield text[:size]
        yield text[(len(text) - size) // 2 :][:size]
        size *= 2


def _least(texts: list[str], weights, centers):
    """Per length class the share of the median cosine of texts of that length, linear in between."""
    import numpy as np

    found: dict[int, list[float]] = {}
    for text in texts:
        for counts in map(ngram_counts, _windows(text)):
            if counts is not None:
                cosine = float((centers @ _unit(counts, weights)).max())
                found.setdefault(int(np.rint(np.log2(counts.sum()))), []).append(cosine)
    classes = sorted(found)
    return np.interp(np.arange(CLASSES), classes, [SHARE * float(np.median(found[c])) for c in classes])


def fit(labelled: DataFrame, rows: int = FITTED_ROWS, centroids: int = CENTROIDS) -> Model:
    """A model from ``text, lang`` (``doc_id`` only spreads the sample). Rows without language or letters teach nothing.

    The inverse document frequencies count all rows. The centroids of a language are clusters of a bounded sample of
    its rows, fitted in one task per language, and are all that comes to the driver.
    """
    import numpy as np

    known = labelled.filter(F.col("lang").isNotNull())
    frequency, documents = _document_frequencies(known)
    weights = (np.log((1 + documents) / (1 + frequency)) + 1).astype(np.float32)

    def cluster(rows):
        import pandas as pd

        counted = [(t, c) for t, c in zip(rows["text"], map(ngram_counts, rows["text"]), strict=True) if c is not None]
        if not counted:
            return pd.DataFrame({"lang": [], "centers": [], "least": []})
        centers = _cluster(np.stack([_unit(c, weights) for _, c in counted]), centroids)
        least = _least([t for t, _ in counted], weights, centers)
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[:1], "centers": [[c.tolist() for c in centers]], "least": [least.tolist()]}
        )

    learned = sorted(
        _sample(known, rows)
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, centers array<array<float>>, least array<double>")
        .collect(),
        key=lambda r: r["lang"],
    )
    languages = [r["lang"] for r in learned]
    owner = [i for i, r in enumerate(learned) for _ in r["centers"]]
    return Model(
        languages,
        weights,
        np.array([c for r in learned for c in r["centers"]], np.float32).reshape(-1, DIMENSIONS),
        np.array(owner, np.int64),
        np.array([r["least"] for r in learned], np.float64).reshape(-1, CLASSES),
    )


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless it is to be kept, with ``lang_pred, score, rejected``.

    The language of the centroid with the largest cosine; ties go to the first language by name. ``score`` is that
    cosine, 0 to 1. A document is rejected if it has no letters (then ``und`` and 0), or if its cosine is less than
    the least of its language: ``SHARE`` of the median over fitted texts, whole and cut, with as many n-grams. Short
    texts have smaller cosines, so each length has its own bound. Without any language all are ``und``.
    """
    dropped = {"lang_pred", "score", "rejected"} | (set() if keep_text else {"text"})
    kept = [c for c in docs.columns if c not in dropped]

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names, scores, out = [], [], []
            for value in batch.column("text"):
                counts = ngram_counts(value.as_py())
                if counts is None or not model.languages:
                    names.append(UNDETERMINED), scores.append(0.0), out.append(True)
                    continue
                cosines = model.centroids @ _unit(counts, model.weights)
                at = int(cosines.argmax())
                language = int(model.owner[at])
                score = min(1.0, max(0.0, float(cosines[at])))
                bound = np.interp(np.log2(counts.sum()), np.arange(CLASSES), model.least[language])
                names.append(model.languages[language]), scores.append(score), out.append(bool(score < bound))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(out, pa.bool_())],
                [*kept, "lang_pred", "score", "rejected"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(
        work, f"{kinds}{', ' if kinds else ''}lang_pred string, score double, rejected boolean"
    )


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: those whose doc_id as text has a CRC-32 of remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` per row, by a model of the rows that are not held out.

    Null or letterless texts are ``und`` with score 0 and rejected. A null doc_id is not held out. Rows that repeat are
    predicted alike. Only ``doc_id, text, lang`` are read, ``lang`` for learning alone.
    """
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
