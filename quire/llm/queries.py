"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, exact_dedup, langid, licenses, mpeg_audio, ngram_join, packing, toxicity, warc
from quire.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(
        "select -7L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)"
    )
    return chat.read_formatted(chat.format_conversations(rows.unionByName(tricky), chat.production()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 90 % of three-word shingles."""
    return ngram_join.components_of(_table(spark, sf_dir, "documents"), ngram_join.Rule(3, 90))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the documents that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs.filter(~held_out())))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens; one row per piece."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, text_sha256 FROM r
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder, and what is read back of them."""
    rows = warc.with_revisits(_table(spark, sf_dir, "pages"))
    folder = warc.shared_folder(rows, "warc")
    return warc.page_records(warc.read_archives(warc.write_archives(rows, folder), folder))


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _disguised() -> list[tuple[int, str]]:
    """Known licences in other spellings, with ids from -1 downwards: no document of the tables is a licence as a whole."""
    out = []
    for i, (_, text) in enumerate(sorted(licenses.KNOWN.items()), 1):
        text = text.replace("Copyright (c) <year>", "  COPYRIGHT (C) 1999-2024").replace("NONINFRINGEMENT", "non-infringement")
        out.append((-i, text.replace(", ", " ,  ").replace("sublicense", "sub-license").replace('"', "``")))
    return out


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and disguised copies of the known licences, looked up by canonical digest."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(rows.unionByName(spark.createDataFrame(_disguised(), "doc_id bigint, text string")))


OP8_SQL = f"""
WITH known AS (
  SELECT min(license_id) AS license_id, sha256({licenses.canonical_sql("body")}) AS canonical_sha256
  FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in licenses.KNOWN.items())}) t(license_id, body) GROUP BY 2
), d AS (
  SELECT doc_id, sha256({licenses.canonical_sql("text")}) AS canonical_sha256
  FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {", ".join(f"({i}, {_sql_text(t)})" for i, t in _disguised())}) u
)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known USING (canonical_sha256)
"""


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an MPEG audio stream and read back, as digests and features."""
    read = mpeg_audio.decode_media(mpeg_audio.encode_media(_table(spark, sf_dir, "documents")))
    tail = F.substring("payload", -32, 32)
    feature = F.concat_ws(
        ";", "seek_table", "frames", "table_frames", "sample_rate", "samples", "duration_us", "checked", "bad_checks", "skipped_bytes",
        F.element_at("frame_offsets", 1), F.element_at("frame_offsets", -1), F.element_at("tags", "TIT2"),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "frames",
        "duration_us",
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_toxicity": op2_toxicity,
        "op3_ngram_join": op3_ngram_join,
        "op4_language_id": op4_language_id,
        "op5_packing": op5_packing,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_warc": op7_warc,
        "op8_license_scan": op8_license_scan,
        "op9_mpeg_audio": op9_mpeg_audio,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op8_license_scan": OP8_SQL}
