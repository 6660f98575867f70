"""The corpus operators against brute force, and on nulls, empty and repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleloom.llm import (
    block_names, bwt_merge, covering, langid, line_windows, mixing, packing, rendezvous, secrets, weighted_sampling,
)
from titleloom.llm.queries import operators as Q

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, n_removed int, "
    "fingerprint string, spans string, name string, size long"
)
LONG = "\n".join(f"line {i % 700} of a very long text with token = abcDEF123456{i}" for i in range(3000))
ROWS = [
    (1, "Hello there, dear world.\na\nb\nc", "en"), (2, "hello there, dear world.\na\nb\nc", "en"), (3, None, None),
    (4, "", "en"), (5, "\n\n\n", None), (6, LONG, "en"), (7, LONG, "en"), (8, "x", "fr"), (8, "x", "fr"),
    (9, "12345 !!", "fr"), (None, "no id at all, but text", None), (10, "ΣΑΣ é ñ \U0001d400 ́ ok go", None),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, f"s{i % 3}" if i % 4 else None, None, 9, 0.5, 3, "f", "s", "n", 7) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


TOKENIZER = Q.tokenizer_path()
OPERATORS = {
    "secrets": secrets.scan_secrets,
    "sampling": weighted_sampling.fingerprint_documents,
    "shards": lambda d: rendezvous.assign_shards(d, [1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.0, 1.0, 1.0]),
    "names": lambda d: block_names.exact_duplicates(d, 64),
    "bytes": bwt_merge.drop_repeated_bytes,
    "packing": lambda d: packing.pack_documents(d, TOKENIZER, 64),
    "language": langid.identify_language,
    "covering": covering.near_duplicates,
    "lines": line_windows.drop_repeated_windows,
    "mixing": lambda d: mixing.mix_sources(d, F.length("text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(edge, name):
    found = OPERATORS[name](edge).collect()
    if name != "packing":
        assert {r["doc_id"] for r in found} == {r[0] for r in ROWS}
    else:
        assert sum(r["length"] for r in found if r["start"] + r["length"] == r["doc_tokens"]) > 0
    assert OPERATORS[name](edge.limit(0)).collect() == []


def test_secrets_link_only_with_counterpart(spark):
    texts = [
        "host: db.example.org\npassword: hunter2", "password: hunter2", "see 10.20.30.40 for more",
        "client_id = abcd1234 and secret = s3cr3t", "host: db.example.org" + " x" * 400 + "\npassword: hunter2",
        "host: db.example.org\n\npassword: hunter2",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_secrets(rows).collect()}
    assert kinds == {0: [5, 4], 1: [], 2: [], 3: [3, 4], 4: [5, 4], 5: []}
    near = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_secrets(rows, reach=200).collect()}
    assert near == kinds | {4: []}


def test_secret_base_spans(spark, documents):
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
                   ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for row in Q.op1_secret_scan(spark, SMALL).collect():
        text = documents[row["doc_id"]]["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def _weights(text):
    return {k: 1 + math.log(n) for k, n in Counter(text.lower().split()).items()}


def _generalised_jaccard(a, b):
    words = {*a, *b}
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in words) / sum(max(a.get(w, 0), b.get(w, 0)) for w in words)


def test_weighted_sampling_estimates_generalised_jaccard(spark, documents):
    ids, errors, prints = sorted(documents), [], defaultdict(set)
    found = {r["doc_id"]: r for r in Q.op2_weighted_sampling(spark, SMALL).collect()}
    for at, i in enumerate(ids):
        text, following = documents[i]["text"], documents[ids[(at + 1) % len(ids)]]["text"]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(found[i]["fingerprint"])
        errors.append(found[i]["near_edited"] - _generalised_jaccard(_weights(text), _weights(edited)))
    assert max(map(len, prints.values())) == 1
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_collision_rate_has_no_bias_on_short_texts_and_unequal_weights(spark):
    """Pairs of 5 to 80 words, one text repeating some words of the other up to 30 times."""
    draw, rows = np.random.default_rng(7), []
    for pair in range(1200):
        words = [f"w{pair}x{k}" for k in range(int(draw.choice([5, 10, 20, 40, 80])))]
        left = [w for w in words if draw.random() < 0.8]
        right = [w for w in words if draw.random() < 0.7 for _ in range(int(draw.choice([1, 1, 2, 5, 30])))]
        rows.append((pair, " ".join(left or words), " ".join(right or words)))
    table = spark.createDataFrame(rows, "id long, a string, b string")
    found = weighted_sampling.signatures(table, ["id"], [(F.col("a"), ("a",)), (F.col("b"), ("b",))])
    rates = {r["id"]: r["rate"] for r in found.select("id", weighted_sampling.likeness(F.col("a"), F.col("b")).alias("rate")).collect()}
    true = np.array([_generalised_jaccard(_weights(a), _weights(b)) for _, a, b in rows])
    errors = np.array([rates[i] for i, _, _ in rows]) - true
    # Independent draws: the spread is that of SAMPLES coins.
    expected = np.sqrt(np.mean(true * (1 - true)) / weighted_sampling.SAMPLES)
    assert abs(errors.mean()) < 0.006 and abs(errors.std() / expected - 1) < 0.1
    for low, high in ((0, 0.25), (0.25, 0.5), (0.5, 1)):
        inside = errors[(true >= low) & (true < high)]
        assert len(inside) < 50 or abs(inside.mean()) < 0.012


def test_weighted_sampling_gives_every_repeated_row(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b"), (2, None), (None, "x y z w"), (None, "x y z w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(r["doc_id"] for r in weighted_sampling.fingerprint_documents(docs).collect())
    assert found == {1: 3, 2: 2, None: 2}


def test_shards_move_only_to_the_new_one(spark, documents):
    rows = Q.op3_rendezvous(spark, SMALL).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 40)
        content = documents[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(content) + 16, zlib.crc32(content))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    shares = rendezvous.assign_shards(keys, [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs(next(r["count"] for r in shares if r["shard"] == 1) / 20_000 - 0.75) < 0.02


def test_shards_against_all_scores(spark, documents):
    """Equal weights: the shard with the largest draw of 13 hexadecimal digits wins."""

    def best(doc_id, shards):
        draws = [int(hashlib.md5(f"{doc_id}:{s}".encode()).hexdigest()[:13], 16) for s in range(shards)]
        return draws.index(max(draws))

    found = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in Q.op3_rendezvous(spark, SMALL).collect()}
    assert found == {i: (best(i, 40), best(i, 41)) for i in documents}


def test_block_names_of_long_texts(spark):
    texts = ["a" * 1000, "A" * 1000, "a" * 999, "a" * 999 + "b", "b" + "a" * 999, "", None, "a" * 64, "a" * 128]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in block_names.exact_duplicates(rows, 64).collect()}
    assert found == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2), 7: (7, 1), 8: (8, 1)}


def test_bytes_against_brute_force(spark, documents):
    first = {}
    contents = {i: documents[i]["text"].encode() for i in sorted(documents)}
    for i, data in contents.items():
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for row in Q.op5_bwt_merge(spark, SMALL).collect():
        data = contents[row["doc_id"]]
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < row["doc_id"]:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        runs = len(re.findall(b"\1+", bytes(gone)))
        digest = hashlib.sha256(kept).hexdigest()
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(data), sum(gone), runs, digest)


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 7, 12])
def test_merged_intervals_of_any_length(length):
    draw = np.random.default_rng(length)
    strings = [bytes(draw.integers(97, 99, n).tolist()) for n in draw.integers(0, 14, 40)]
    string, offset, block = bwt_merge.merged_intervals(strings, length, shard=3)
    assert len(string) == sum(len(s) + 1 for s in strings)
    found = defaultdict(set)
    for s, o, b in zip(string.tolist(), offset.tolist(), block.tolist(), strict=True):
        if o + length <= len(strings[s]):
            found[strings[s][o : o + length]].add(b)
    blocks = [b for x in found.values() for b in x]
    assert all(len(x) == 1 for x in found.values()) and len(set(blocks)) == len(blocks)


def test_merged_intervals_are_the_sorted_windows():
    strings = [b"abracadabra", b"cadabra", b"", b"\x00\xfe\x00\xfe\x00", b"abracadabra"]
    string, offset, block = bwt_merge.merged_intervals(strings, 4, shard=2)
    windows = defaultdict(set)
    for s, o, b in zip(string.tolist(), offset.tolist(), block.tolist(), strict=True):
        if o + 4 <= len(strings[s]):
            windows[b].add((strings[s][o : o + 4], s, o))
    expected = defaultdict(set)
    for s, x in enumerate(strings):
        for o in range(len(x) - 3):
            expected[x[o : o + 4]].add((x[o : o + 4], s, o))
    assert sorted(map(sorted, windows.values())) == sorted(map(sorted, expected.values()))


def test_packing_holds_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces, totals = defaultdict(list), defaultdict(list)
    for r in Q.op6_shortest_pack_first(spark, SMALL).collect():
        pieces[r["doc_id"]].append(r)
        totals[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, doc in documents.items():
        ids = np.array([*tokenizer.encode(doc["text"], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in totals.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= Q.CAPACITY


def test_words_give_the_ids_of_their_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [LONG[:5000], "It's we'll 12,5 «Ça» ÉTÉ İ ΣΑΣ x́ a b\x1cc <|endoftext|>   𝐀 '''s don't.", None, "", " \n"]
    for text, data in zip(texts, packing.token_bytes(pa.array(texts), TOKENIZER, 1), strict=True):
        expected = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(data, "<u4").tolist() == expected


def test_shortest_pack_first_places_all():
    histogram = {2048: 3, 1500: 7, 700: 20, 548: 6, 33: 100, 1: 5}
    patterns = packing.shortest_pack_first(histogram, 2048)
    placed = Counter()
    for pattern, packs in patterns:
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            placed[n] += k * packs
    assert placed == histogram


def test_language_of_held_out_rows(spark, documents):
    rows = [r for r in Q.op7_nearest_centroid(spark, SMALL).collect() if r["held_out"]]
    assert len(rows) > 30
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in rows) / len(rows) > 0.97
    assert not any(r["rejected"] for r in rows)


def test_language_rejects_far_text(spark):
    rows = [(i, ("the cat and the dog went to the house of the man " * 3)[i:], "en") for i in range(30)]
    rows += [(100 + i, ("der hund und die katze gehen in das haus des mannes " * 3)[i:], "de") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probes = [(0, "the dog went to the house"), (1, "zzqxj kvwpp qqzx " * 30), (2, "1234"), (3, None)]
    found = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(probes, "doc_id long, text string"), model).collect()}
    assert found[0]["lang_pred"] == "en" and not found[0]["rejected"]
    assert all(found[i]["rejected"] for i in (1, 2, 3)) and found[3]["lang_pred"] == "und"


@pytest.mark.parametrize("paired", [1, 128])
def test_close_pairs_against_brute_force(spark, paired):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    numbers = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centers for a, b in rng.integers(0, 64, (25, 2))} | {0}
    signed = [x - (1 << 64) if x >> 63 else x for x in numbers]
    found = covering.close_pairs(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 2, paired)
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & covering.UNDER).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in found.collect()} == expected


def test_components_of_a_chain(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    links = spark.range(49).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = {r["node"]: r["root"] for r in covering.components(nodes, links).collect()}
    assert roots == {i: 0 if i < 50 else i for i in range(60)}


def test_simhash_bits():
    import xxhash

    words = "the quick brown fox jumps over the lazy dog the quick brown fox".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert covering.simhash("The  QUICK brown\tfox jumps over\nthe lazy dog the quick brown fox ", 3) == bits
    assert covering.simhash(" \n", 3) == covering.simhash(None, 3) == 0
    assert covering.simhash("One two", 3) == xxhash.xxh64_intdigest("one two", 42)


def test_lines_keep_the_first_occurrence(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nz"), (4, "q\nq\nq\nq\nq"), (5, "\n\n\n\n")]
    found = line_windows.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: "a\nb\nc\nd", 2: "x\ny", 3: "a\nb\nz", 4: "q", 5: "\n\n\n\n"}


def test_mixture_meets_its_targets(spark, documents):
    rows = Q.op10_entropy_balancing(spark, SMALL).collect()
    taken, target, sizes = Counter(), {}, Counter()
    for r in rows:
        source = documents[r["doc_id"]]["source"]
        assert r["size"] == len((documents[r["doc_id"]]["text"] or "").encode().split()) and r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
        sizes[source] += r["size"]
        target[source] = r["target"]
    names = sorted(sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        unit = (total - sum(2 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in names if s not in capped and weights[s] * unit > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in names:
        assert target[s] == pytest.approx(2 * sizes[s] if s in capped else weights[s] * unit)
        assert abs(taken[s] - target[s]) <= 1


def test_tilts_under_priors(spark):
    cells = spark.createDataFrame([("a", 0.5, 100), ("a", 3.0, 50), ("b", 1.0, 10)], "source string, prior double, tokens long")
    targets = spark.createDataFrame([("a", 150, 200.0), ("b", 10, 20.0)], "source string, source_size long, target double")
    tilt = {r["source"]: r["tilt"] for r in mixing.balanced_tilts(cells, targets, 2.0).collect()}
    mass = sum(n * min(2.0, p * math.exp(tilt["a"])) for p, n in ((0.5, 100), (3.0, 50)))
    assert mass == pytest.approx(200.0) and 10 * min(2.0, math.exp(tilt["b"])) == pytest.approx(20.0)
