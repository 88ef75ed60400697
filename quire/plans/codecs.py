"""Codecs, digests and encryption; per-row and per-group extension points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.codecs import decode_with, encode_with
from quire.plans.registry import query, table


def _roundtrip(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    df = df.withColumn("coded", encode_with(names, F.col("data")))
    back = decode_with(names, F.col("coded"))
    return df.select("doc_id", F.octet_length("data").cast("bigint").alias("n_bytes"), (back == F.col("data")).alias("same"))


_SAME = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS same FROM documents"


@query(_SAME)
def runlength_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, ["RunLengthDecode"])


@query(_SAME)
def ascii85_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, ["ASCII85Decode"])


@query(_SAME)
def lzw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, ["LZWDecode"])


@query(_SAME)
def filter_chain_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of filters, applied in reverse when encoding."""
    return _roundtrip(spark, sf_dir, ["ASCII85Decode", "FlateDecode", "RunLengthDecode"])


@query()
def flate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated size of each text; kept only where it is smaller, as a size optimiser does."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")).withColumn("coded", encode_with(["FlateDecode"], F.col("data")))
    size, packed = F.octet_length("data").cast("bigint"), F.octet_length("coded").cast("bigint")
    return df.select("doc_id", size.alias("n_bytes"), packed.alias("packed_bytes"), (packed + 20 < size).alias("keep"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, text AS plain, true AS hidden FROM documents")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-CBC with a 16-byte key derived from the document's number."""
    key = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)
    df = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), "text")
    secret = F.aes_encrypt("text", "key", F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit("00" * 16)))
    df = df.withColumn("secret", secret)
    return df.select("doc_id", F.aes_decrypt("secret", "key", F.lit("CBC"), F.lit("PKCS")).cast("string").alias("plain"), (F.col("secret") != F.col("text").cast("binary")).alias("hidden"))


@query(
    """SELECT conv_id, CAST(sum(CASE role WHEN 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS asked,
    CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS answered FROM conversations GROUP BY conv_id"""
)
def op_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callbacks by kind of row, over each group's ordered rows: streamed in sort order, so a long group needs no memory."""
    from quire.operators.handlers import process

    def asked(state: dict, row: dict) -> None:
        state["asked"] += len(row["text"] or "")

    def answered(state: dict, row: dict) -> None:
        state["answered"] += len(row["text"] or "")

    return process(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", ["turn"], "role",
        {"user": asked, "assistant": answered}, {"asked": 0, "answered": 0}, "conv_id bigint, asked bigint, answered bigint",
    )


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS result, CAST(NULL AS VARCHAR) AS error FROM documents WHERE length(text) >= 20 UNION ALL SELECT doc_id, NULL, 'too short' FROM documents WHERE length(text) < 20")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external scorer over batches: input order kept, errors kept with their rows."""
    from quire.operators.handlers import score_batches

    def scorer(text: str | None) -> int:
        if len(text or "") < 20:
            raise ValueError("too short")
        return len(text or "")

    return score_batches(table(spark, sf_dir, "documents"), "doc_id", "text", scorer)

