"""Histograms, thresholds, bits and symbol classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import raster as R
from quire.plans.registry import query, table


@query("SELECT event_type, CAST(floor(value) AS BIGINT) % 256 AS bin, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def gray_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(table(spark, sf_dir, "events"), F.floor("value") % 256, ["event_type"])


@query(
    """WITH h AS (SELECT event_type, CAST(floor(value) AS BIGINT) % 256 AS bin, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2),
    p AS (SELECT *, first_value(bin) OVER w AS p, first_value(n) OVER w AS h, min(bin) OVER (PARTITION BY event_type) AS lo, max(bin) OVER (PARTITION BY event_type) AS hi FROM h WINDOW w AS (PARTITION BY event_type ORDER BY n DESC, bin)),
    e AS (SELECT *, hi - p >= p - lo AS r, CASE WHEN hi - p >= p - lo THEN hi ELSE lo END AS e FROM p),
    b AS (SELECT *, max(CASE WHEN bin = e THEN n END) OVER (PARTITION BY event_type) AS base FROM e),
    g AS (SELECT event_type, bin, coalesce(round(h + (base - h) * (bin - p) / CAST(CASE WHEN e <> p THEN e - p END AS DOUBLE) - n, 6), 0.0) AS gap FROM b WHERE CASE WHEN r THEN bin >= p ELSE bin <= p END)
    SELECT event_type, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gap DESC, bin) AS rn FROM g) x WHERE rn = 1"""
)
def triangle_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from histograms by the triangle method."""
    return R.triangle_threshold(gray_histogram(spark, sf_dir), ["event_type"])


@query("SELECT p_size AS height, CAST(count(*) AS BIGINT) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members, round(avg(p_retailprice), 6) AS centroid FROM part GROUP BY p_size")
def symbol_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items grouped by height, with their members and mean place."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("height")).agg(F.count(F.lit(1)).alias("n"), members.alias("members"), F.round(F.avg("p_retailprice"), 6).alias("centroid"))


@query(
    """WITH b AS (SELECT vec_id, label, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN list_sum(a.v) * list_sum(b.v) > 0 THEN power(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 2) / (list_sum(a.v) * list_sum(b.v)) END, 6) AS score
    FROM b a JOIN b b ON a.label = b.label AND b.vec_id = a.vec_id + 1"""
)
def bitmap_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring bitmaps with one label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", R.signature_bits(F.col("embedding")).alias("bits"))
    a = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), "label", F.col("bits").alias("x"))
    b = e.select(F.col("vec_id").alias("b"), "label", F.col("bits").alias("y"))
    return a.join(b, ["b", "label"]).select("a", "b", F.round(R.correlation(F.col("x"), F.col("y")), 6).alias("score"))


@query("SELECT event_id, true AS same, 8 AS n FROM events")
def resample_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to 2-bit samples and back."""
    data = F.array((F.col("event_id") % 256).cast("int"), (F.col("user_id") % 256).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", data.alias("d")).withColumn("s", R.unpack(F.col("d"), 2))
    return df.select("event_id", (R.pack(F.col("s"), 2) == F.col("d")).alias("same"), F.size("s").alias("n"))


@query(
    """SELECT p_partkey, CAST(power(2, ceil(log2(p_size))) AS BIGINT) AS next_power, (p_size & (p_size - 1)) = 0 AS is_power FROM part"""
)
def powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.pow(F.lit(2.0), F.ceil(F.log2(size))).cast("bigint").alias("next_power"), (size.bitwiseAND(size - 1) == 0).alias("is_power"))


@query("SELECT label, CAST(min(vec_id) AS BIGINT) AS class_id, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label")
def symbol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols put in one class by equal shape key; the first stands for the class."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
