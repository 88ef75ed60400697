"""Scans, lookups and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query, table

#: Granted operations as bits.
PRINT, MODIFY, COPY, ANNOTATE = 4, 8, 16, 32


@query("SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 UNION ALL SELECT role, CAST(count(*) AS BIGINT) FROM conversations GROUP BY 1")
def inspect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by type."""
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query("SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars FROM pages WHERE page_id BETWEEN 5 AND 20")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from 5 to 20; an error if there are fewer."""
    from quire.operators.pages import page_range as pick

    return pick(table(spark, sf_dir, "pages"), "page_id", 5, 20).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup by key, pushed into the scan."""
    return table(spark, sf_dir, "lineitem").filter("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT l_orderkey AS obj_num FROM lineitem")
def object_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object numbers, sorted."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obj_num")).distinct().orderBy("obj_num")


@query("SELECT c_custkey, (c_custkey & 12) = 12 AS may_edit, (c_custkey & 16) = 16 AS may_copy FROM customer")
def perm_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission masks."""
    k = F.col("c_custkey")
    allowed = lambda mask: k.bitwiseAND(F.lit(mask)) == mask
    return table(spark, sf_dir, "customer").select("c_custkey", allowed(PRINT | MODIFY).alias("may_edit"), allowed(COPY).alias("may_copy"))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS r FROM events
    UNION ALL SELECT * FROM (VALUES ('a', 12, NULL), ('b', NULL, -0.5), ('c', NULL, 4.0), ('d', NULL, NULL), ('e', -7, NULL)) t(k, i, r)"""
)
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer and real literals; null for anything else."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("k"), F.get_json_object("props", "$.k").alias("t"))
    df = own.unionByName(spark.createDataFrame([("a", "+12"), ("b", "-.5"), ("c", "4."), ("d", "4x"), ("e", "-7")], "k string, t string"))
    whole, real = F.col("t").rlike(r"^[-+]?\d+$"), F.col("t").rlike(r"^[-+]?(\d+\.\d*|\.\d+)$")
    return df.select("k", F.when(whole, F.col("t").try_cast("bigint")).alias("i"), F.when(real, F.col("t").try_cast("double")).alias("r"))


@query("SELECT doc_id, encode(text)[11:20]::BLOB AS part FROM documents WHERE strlen(text) >= 20")
def read_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte range of each text."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return df.filter(F.octet_length("data") >= 20).select("doc_id", F.substring("data", 11, 10).alias("part"))


@query("SELECT page_id, regexp_extract(html, '^<!DOCTYPE ([a-z]+)>', 1) AS version, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each page's header."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "^<!DOCTYPE ([a-z]+)>", 1).alias("version"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query(
    """SELECT p_partkey, regexp_matches(p_name, '\\s') AS has_space, regexp_matches(p_name, '^[\\x21-\\x7e ]*$') AS printable, regexp_matches(p_brand, '[0-9]') AS has_digit,
    abs(p_retailprice - 1000) <= 50 AS near FROM part"""
)
def character_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character classes, and equality within a tolerance."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").rlike(r"\s").alias("has_space"), F.col("p_name").rlike(r"^[\x21-\x7e ]*$").alias("printable"),
        F.col("p_brand").rlike("[0-9]").alias("has_digit"), (F.abs(F.col("p_retailprice") - 1000) <= 50).alias("near"),
    )


@query("SELECT c_custkey, c_nationkey = s_nationkey AS same, c_nationkey IS NULL AS none FROM customer JOIN supplier ON c_custkey = s_suppkey")
def equal_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep equality of structs, null-safe."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = c.join(s, F.col("c_custkey") == F.col("s_suppkey"))
    return j.select("c_custkey", F.struct(F.col("c_nationkey").alias("n")).eqNullSafe(F.struct(F.col("s_nationkey").alias("n"))).alias("same"), F.col("c_nationkey").isNull().alias("none"))
