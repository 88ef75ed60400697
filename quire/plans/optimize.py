"""De-duplication, clean-up and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import optimize as O
from quire.plans.registry import query, table


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("obj_num"), F.col("doc_id").alias("seq"), "text", "lang")


@query("SELECT doc_id AS obj_num, first_value(doc_id) OVER (PARTITION BY md5(text), lang ORDER BY doc_id) AS survivor FROM documents")
def combine_duplicate_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream with the first one of equal content and dictionary."""
    return O.combine_duplicates(_objects(spark, sf_dir), ["text", "lang"])


@query(
    "SELECT p_partkey AS obj_num, CASE WHEN p_size < 5 THEN p_partkey ELSE first_value(p_partkey) OVER (PARTITION BY p_size < 5, p_brand, p_type ORDER BY p_partkey) END AS survivor FROM part"
)
def combine_identical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical dictionaries share one object; exempt ones (small parts here) don't."""
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj_num"), F.col("p_partkey").alias("seq"), "p_brand", "p_type", "p_size")
    return O.combine_duplicates(objects, ["p_brand", "p_type"], "p_size < 5")


@query(
    """WITH d AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS survivor FROM documents)
    SELECT l.doc_id AS src, 'label' AS key, survivor AS dst FROM labels l JOIN d USING (doc_id)"""
)
def rewire_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to duplicates point to the survivors."""
    edges = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("src"), F.lit("label").alias("key"), F.col("doc_id").alias("dst"))
    return O.rewire(edges, O.combine_duplicates(_objects(spark, sf_dir), ["text"]))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS used FROM customer")
def clean_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that an order refers to, and the others."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    on = c.c_custkey == o.o_custkey
    used = c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("used"))
    return used.unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit(False).alias("used")))


@query(
    """SELECT source, CAST((rn - 1) // 16 AS BIGINT) AS container, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first, max(doc_id) AS last
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t GROUP BY 1, 2 HAVING count(*) > 1"""
)
def object_stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 16 objects by source."""
    return O.object_streams(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("obj_num"), "source"), 16, "source")


@query("SELECT min(doc_id) AS obj_num, lang, CAST(count(*) AS BIGINT) AS merged FROM documents WHERE lang <> 'es' GROUP BY text, lang HAVING length(text) > 0")
def optimizer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of passes in which one fails: its input goes on."""

    def broken(df: DataFrame) -> DataFrame:
        return df.select("no_such_column")

    chain = O.Chain(
        [
            ("drop_language", lambda df: df.filter("lang <> 'es'")),
            ("broken", broken),
            ("combine", lambda df: df.groupBy(F.sha2("text", 256).alias("h"), "lang").agg(F.min("obj_num").alias("obj_num"), F.count(F.lit(1)).alias("merged"), F.max(F.length("text")).alias("size"))),
        ]
    ).append("clean", lambda df: df.filter("size > 0").select("obj_num", "lang", "merged"))
    return chain.optimize(_objects(spark, sf_dir))


@query("SELECT * FROM (VALUES (1, 'm', '1.5 20'), (3, 'l', '3 4.25')) t(seq, operand, params)")
def clean_contentstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-content operators dropped, numbers shortened."""
    rows = [(1, "m", "1.500 20.0"), (2, "BDC", "/Span"), (3, "l", "3.00 4.250"), (4, "EMC", "")]
    return O.clean_operations(spark.createDataFrame(rows, "seq int, operand string, params string"), ("BMC", "BDC", "EMC", "MP", "DP"))
