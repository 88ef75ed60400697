"""Affine transforms, boxes and colours over positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.layout import MARKS_SQL, marks
from quire.plans.registry import query, table


@query(f"WITH {MARKS_SQL} SELECT doc_id, line_no, word_no, round(0.5 * llx - 0.25 * lly + 10, 6) AS x, round(0.25 * llx + 0.5 * lly - 20, 6) AS y FROM marks")
def affine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mark's corner through an affine matrix."""
    x, y = G.apply(G.matrix(0.5, 0.25, -0.25, 0.5, 10, -20), F.col("llx"), F.col("lly"))
    return marks(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "word_no", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(
    """SELECT p_partkey, round(CASE WHEN abs(p_size * 2.0 - 4.0) > 1e-10 THEN 2.0 / (p_size * 2.0 - 4.0) END, 6) AS a,
    round(CASE WHEN abs(p_size * 2.0 - 4.0) > 1e-10 THEN (2 * 5 - 2.0 * 3) / (p_size * 2.0 - 4.0) END, 6) AS tx,
    CASE WHEN abs(p_size * 2.0 - 4.0) > 1e-10 THEN true END AS identity FROM part"""
)
def affine_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverses; null where the matrix is singular; the product with the inverse is the identity."""
    m = G.matrix(F.col("p_size"), 2, 2, 2, 3, 5)
    df = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), G.inverse(m).alias("i"))
    one = G.multiply(F.col("m"), F.col("i"))
    near = F.lit(True)
    for name, value in (("a", 1), ("b", 0), ("c", 0), ("d", 1), ("tx", 0), ("ty", 0)):
        near = near & (F.abs(one.getField(name) - value) < 1e-6)
    return df.select("p_partkey", F.round("i.a", 6).alias("a"), F.round("i.tx", 6).alias("tx"), F.when(F.col("i").isNotNull(), near).alias("identity"))


@query(
    """SELECT p_partkey, round((360 - p_size * 7 % 360) % 360, 4) AS angle, round(CAST(1 + p_size % 3 AS DOUBLE), 6) AS sx, CAST(2 AS DOUBLE) AS sy FROM part"""
)
def affine_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle and scaling factors of a scaled rotation."""
    turn = G.rotation(F.radians((F.col("p_size") * 7).cast("double")))
    m = G.multiply(G.scale(1 + F.col("p_size") % 3, 2), turn)
    sx, sy = G.scaling(m)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.angle(m), 4).alias("angle"), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


@query(f"WITH {MARKS_SQL} SELECT doc_id, min(llx) AS llx, min(lly) AS lly, max(urx) AS urx, max(ury) AS ury, CAST(count(*) AS BIGINT) AS n FROM marks GROUP BY doc_id")
def bbox_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of each document's marks."""
    return marks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(
        F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), F.count(F.lit(1)).alias("n")
    )


@query(
    f"""WITH {MARKS_SQL}, b AS (SELECT doc_id, min(llx) AS x0, min(lly) AS y0, max(urx) AS x1, max(ury) AS y1 FROM marks GROUP BY doc_id)
    SELECT doc_id, doc_id % 4 * 90 AS rotate, CASE WHEN doc_id % 2 = 0 THEN x1 - x0 ELSE y1 - y0 END AS width, CASE WHEN doc_id % 2 = 0 THEN y1 - y0 ELSE x1 - x0 END AS height FROM b"""
)
def normalize_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their rotation taken out and their origin moved to (0, 0)."""
    from quire.operators.layout import normalized_size

    boxes = bbox_per_page(spark, sf_dir).withColumn("rotate", F.col("doc_id") % 4 * 90)
    width, height = normalized_size(F.col("llx"), F.col("lly"), F.col("urx"), F.col("ury"), F.col("rotate"))
    return boxes.select("doc_id", "rotate", width.alias("width"), height.alias("height"))


@query(
    """SELECT page_id, round(0.3 * r + 0.59 * g + 0.11 * b, 6) AS gray, round(1 - least(1.0, 0.3 * r + 0.59 * g + 0.11 * b + 0.25), 6) AS from_cmyk
    FROM (SELECT page_id, page_id % 11 / 10.0 AS r, page_id % 7 / 6.0 AS g, page_id % 5 / 4.0 AS b FROM pages)"""
)
def grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance of RGB and CMYK colours."""
    r, g, b = F.col("page_id") % 11 / 10.0, F.col("page_id") % 7 / 6.0, F.col("page_id") % 5 / 4.0
    return table(spark, sf_dir, "pages").select("page_id", F.round(G.rgb_to_gray(r, g, b), 6).alias("gray"), F.round(G.cmyk_to_gray(r, g, b, 0.25), 6).alias("from_cmyk"))


@query(
    """SELECT event_id, round(10 + (value - 0) * (20 - 10) / (100 - 0), 6) AS mapped, round(sqrt((value - 3) * (value - 3) + 16), 6) AS dist,
    round(round(value / 0.25) * 0.25, 6) AS quarter FROM events"""
)
def lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, distances and rounding to a multiple."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(G.remap(v, 0, 100, 10, 20), 6).alias("mapped"), F.round(G.distance(v, 4, 3, 0), 6).alias("dist"), F.round(G.round_to(v, 0.25), 6).alias("quarter"))


@query("SELECT k, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (VALUES (1, 0.0, 10.0), (2, -0.3849, 0.3849), (3, 0.0, 7.5)) t(k, low, high)")
def curve_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of cubic curves from the roots of the derivative."""
    df = spark.createDataFrame([(1, 0.0, 1.0, 9.0, 10.0), (2, 0.0, 4 / 3, -4 / 3, 0.0), (3, 0.0, 10.0, 10.0, 0.0)], "k int, p0 double, p1 double, p2 double, p3 double")
    low, high = G.cubic_bounds(*(F.col(f"p{i}") for i in range(4)))
    return df.select("k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
