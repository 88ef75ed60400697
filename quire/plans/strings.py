"""Text decoding, colours, dates and fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.registry import query, table


@query(r"SELECT doc_id, text AS decoded, CAST(2 + 2 * length(text) + 2 * length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS n_bytes, text = text AS same FROM documents")
def decode_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to UTF-16BE with a byte-order mark, and back by the mark."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", T.text_to_utf16(F.col("text")).alias("raw"))
    return df.select("doc_id", T.decoded(F.col("raw")).alias("decoded"), F.octet_length("raw").cast("bigint").alias("n_bytes"), (T.decoded(F.col("raw")) == F.col("text")).alias("same"))


@query(
    """SELECT * FROM (VALUES ('fef', 'A odd'), ('pdf', '• “x” fi €'), ('latin', 'café')) t(name, decoded)"""
)
def decode_pdfdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String objects in both encodings; an odd UTF-16 length is padded with a zero byte."""
    rows = [("fef", "FEFF0041002000" + "6F00640064"), ("pdf", "80208D788E2093" + "20A0"), ("latin", "636166E9")]
    df = spark.createDataFrame(rows, "name string, hex string").withColumn("raw", F.unhex("hex"))
    return df.select("name", T.expand_ligatures(T.decoded(F.col("raw"))).alias("decoded"))


@query("SELECT doc_id, upper(hex(encode(text))) AS encoded, text AS back FROM documents")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal text of bytes, and back."""
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(data).alias("encoded"), F.decode(F.unhex(F.hex(data)), "UTF-8").alias("back"))


@query("SELECT * FROM (VALUES ('48656C6C6F>', 'Hello'), ('4 8 6 5 >', 'He'), ('414>', 'A@'), ('>', '')) t(source, decoded)")
def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCIIHex with white space and an odd number of digits, which is padded on the right."""
    from quire.functions.codecs import ascii_hex_decode

    df = spark.createDataFrame([("48656C6C6F>",), ("4 8 6 5 >",), ("414>",), (">",)], "source string")
    return df.select("source", F.decode(ascii_hex_decode(F.col("source")), "UTF-8").alias("decoded"))


@query(
    """SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[֐-ࣿ]') THEN 0 ELSE 1 END) AS BIGINT) AS ltr
    FROM (SELECT lang, text FROM documents UNION ALL VALUES ('he', 'שלום'), ('ar', 'مرحبا'), ('en', 'hello')) GROUP BY lang"""
)
def text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without right-to-left letters, by language."""
    extra = spark.createDataFrame([("he", "שלום"), ("ar", "مرحبا"), ("en", "hello")], "lang string, text string")
    df = table(spark, sf_dir, "documents").select("lang", "text").unionByName(extra)
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.left_to_right(F.col("text")).cast("bigint")).alias("ltr"))


@query("SELECT * FROM (VALUES ('ﬁne', 'fine'), ('aﬄuent', 'affluent'), ('oﬀ', 'off'), ('plain', 'plain')) t(source, expanded)")
def ligature_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures as their letters."""
    df = spark.createDataFrame([("ﬁne",), ("aﬄuent",), ("oﬀ",), ("plain",)], "source string")
    return df.select("source", T.expand_ligatures(F.col("source")).alias("expanded"))


@query(
    """WITH c AS (SELECT page_id, '#' || substr(md5(url), 1, 6) AS color FROM pages)
    SELECT page_id, color, CAST(('0x' || substr(color, 2, 2))::INT AS INT) AS r, CAST(('0x' || substr(color, 4, 2))::INT AS INT) AS g,
    CAST(('0x' || substr(color, 6, 2))::INT AS INT) AS b,
    CAST((299 * ('0x' || substr(color, 2, 2))::INT + 587 * ('0x' || substr(color, 4, 2))::INT + 114 * ('0x' || substr(color, 6, 2))::INT) // 1000 AS INT) AS gray FROM c"""
)
def hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of hexadecimal colours, and their integer luminance."""
    color = F.concat(F.lit("#"), F.substring(F.md5("url"), 1, 6))
    df = table(spark, sf_dir, "pages").select("page_id", color.alias("color"))
    r, g, b = (T.hex_channel(F.col("color"), i) for i in range(3))
    gray = F.call_function("div", 299 * r + 587 * g + 114 * b, F.lit(1000)).cast("int")
    return df.select("page_id", "color", r.alias("r"), g.alias("g"), b.alias("b"), gray.alias("gray"))


@query("SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '+00''00''' AS pdf_date FROM orders")
def format_doc_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as document dates."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_document_date(F.col("o_orderdate")).alias("pdf_date"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderdate - INTERVAL 90 MINUTE AS parsed FROM orders
    UNION ALL SELECT * FROM (VALUES ('no seconds', TIMESTAMP '2024-02-29 12:30:00'), ('no prefix', TIMESTAMP '2024-01-02 03:04:05'), ('west', TIMESTAMP '2024-01-02 08:04:05'), ('bad', NULL), ('bad month', NULL)) t(k, parsed)"""
)
def parse_doc_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document dates with offsets, without seconds, without prefix, and malformed ones."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'30'")).alias("t"))
    rows = [("no seconds", "D:202402291230"), ("no prefix", "20240102030405Z"), ("west", "D:20240102030405-05'00'"), ("bad", "yesterday"), ("bad month", "D:20241301000000")]
    df = own.unionByName(spark.createDataFrame(rows, "k string, t string"))
    return df.select("k", T.parse_document_date(F.col("t")).alias("parsed"))


@query("SELECT * FROM (VALUES ('Helvetica', true), ('Times-Roman', true), ('Arial', false), ('Symbol', true)) t(name, standard)")
def standard_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in the standard fonts."""
    df = spark.createDataFrame([("Helvetica",), ("Times-Roman",), ("Arial",), ("Symbol",)], "name string")
    return df.select("name", T.is_standard_font(F.col("name")).alias("standard"))
