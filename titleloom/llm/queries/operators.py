"""One query per operator on the whole ``documents`` table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.llm import (
    block_names, bwt_merge, byte_bpe, conversations, covering, fill_middle, langid, line_windows, mixing, packing, rendezvous, secrets, weighted_sampling,
)
from titleloom.llm.common import read_documents

SHARDS = 40
CAPACITY = 2048
# Words between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """The number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def tokenizer_path() -> str:
    """Where this machine keeps the vocabulary that the query packs with; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_documents(read_documents(spark, sf_dir))


def op3_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rendezvous.assign_shards(read_documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(read_documents(spark, sf_dir))


def op5_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.drop_repeated_bytes(read_documents(spark, sf_dir))


def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), tokenizer_path(), CAPACITY)


def op7_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(read_documents(spark, sf_dir))


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering.near_duplicates(read_documents(spark, sf_dir), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_windows.drop_repeated_windows(read_documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_documents(spark, sf_dir), word_count())
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def rank_path() -> str:
    """Where this machine keeps the ranks that the query encodes with; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    coded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, rank_path(), public_tokenizers.PATTERN), rank_path())
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(read_documents(spark, sf_dir))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.summarize(conversations.repair_conversations(damaged))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op3_rendezvous": op3_rendezvous,
    "op4_block_naming": op4_block_naming,
    "op5_bwt_merge": op5_bwt_merge,
    "op6_shortest_pack_first": op6_shortest_pack_first,
    "op7_nearest_centroid": op7_nearest_centroid,
    "op8_covering_simhash": op8_covering_simhash,
    "op9_line_windows": op9_line_windows,
    "op10_entropy_balancing": op10_entropy_balancing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {
    "op4_block_naming": """
        WITH texts AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY t)
    """,
    "op9_line_windows": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        windows AS (
            SELECT doc_id, pos, line AS a, lead(line) OVER rest AS b, lead(line, 2) OVER rest AS c
            FROM lines WINDOW rest AS (PARTITION BY doc_id ORDER BY pos)),
        marked AS (
            SELECT doc_id, pos,
                   row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1 AS later
            FROM windows
            WHERE c IS NOT NULL AND NOT (trim(a, ' ') = '' AND trim(b, ' ') = '' AND trim(c, ' ') = '')),
        covered AS (
            SELECT DISTINCT doc_id, pos + step AS pos
            FROM marked, (SELECT unnest([0, 1, 2]) AS step) AS steps WHERE later)
        SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
        FROM lines AS l LEFT JOIN covered AS c ON l.doc_id = c.doc_id AND l.pos = c.pos
        GROUP BY l.doc_id
    """,
    "op12_fill_in_middle": r"""
        WITH held AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
        tokens AS (SELECT doc_id, text,
            regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
            CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
            CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM held),
        cuts AS (SELECT doc_id, text, t, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a,
            greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
            THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
        parts AS (SELECT doc_id, text, n, form, coalesce(array_to_string(t[1:a], ''), '') AS prefix,
            coalesce(array_to_string(t[a + 1:b], ''), '') AS middle, coalesce(array_to_string(t[b + 1:], ''), '') AS suffix FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM parts
    """,
}
