"""Points and vectors, further calculator operators, fitting and direction of text, table placement, symbol clusters, keys of 256 bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.functions.postscript import compile_program
from quire.operators import layout as L
from quire.operators import raster as R
from quire.operators import structure as S
from quire.plans.registry import query, table


@query(
    """SELECT event_id, round(value / 3, 9) AS third, floor(value) AS low, value >= 50 AS high, abs(value - 50) >= 1e-6 AS other, round(power(1.5, floor(value) / 10), 6) AS raised, CAST(user_id AS DOUBLE) AS real FROM events"""
)
def ps_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division, floor, the remaining comparisons, powers and conversion to a real."""
    program = "{ cvr exch dup 3 div exch dup floor exch dup 50 ge exch dup 50 ne exch floor 10 div 1.5 exch exp }"
    out = compile_program(program, [(F.col("value"), "double"), (F.col("user_id"), "bigint")])
    names = ["real", "third", "low", "high", "other", "raised"]
    df = table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for c, n in zip(out, names, strict=True)))
    return df.withColumns({"third": F.round("third", 9), "raised": F.round("raised", 6)})


@query(
    """SELECT event_id, round(value * cos(radians(30)) - 2 * sin(radians(30)), 6) AS rx, round(value * sin(radians(30)) + 2 * cos(radians(30)), 6) AS ry, value + 3 AS dx, -4.0::DOUBLE + 2 AS dy,
    round(sqrt(value * value + 4), 6) AS length, round(atan2(2.0, value), 6) AS angle, value * 2.5 AS sx, round(value * cos(0.5), 6) AS px, round(value + 0.25 * (10 - value), 6) AS part,
    value + 7 + 0.5 * 2 AS tx, 2 - 7 + 0.25 * (value + 7) AS ty, round(round(value / 0.25) * 0.25, 6) AS cell, round(value, 1) AS digit FROM events"""
)
def points_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned and moved; vectors' lengths, angles, multiples and polar forms; translation, then shear; rounding of matrices and to digits."""
    v = F.col("value")
    rx, ry = G.rotate_point(v, 2, 30)
    dx, dy = G.displace(v, -4, 3, 2)
    px, _ = G.from_polar(v, 0.5)
    moved = G.apply(G.translation(7, -7), v, 2)
    x, y = moved[0] + 0.5 * F.lit(2.0), G.apply(G.shear(0.5, 0.25), moved[0], 2.0 - 7.0)[1]
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), dx.alias("dx"), dy.alias("dy"), F.round(G.magnitude(v, 2), 6).alias("length"), F.round(G.polar_angle(v, 2), 6).alias("angle"),
        G.scale_vector(v, 0, 2.5)[0].alias("sx"), F.round(px, 6).alias("px"), F.round(G.lerp(v, 10, 0.25), 6).alias("part"), x.alias("tx"), y.alias("ty"),
        F.round(G.round_matrix(G.matrix(v, 0, 0, 1, 0, 0), 0.25).getField("a"), 6).alias("cell"), F.round(v, 1).alias("digit"),
    )


@query(
    """SELECT p_partkey, round(CAST(length(p_name) * 7.2 AS DOUBLE), 6) AS fixed, round(CAST((length(p_name) * 500.0 + (length(p_name) - length(replace(p_name, ' ', ''))) * (250.0 - 500) + (length(p_name) - length(replace(p_name, 'i', ''))) * (220.0 - 500)) * 12 / 1000 AS DOUBLE), 6) AS proportional FROM part"""
)
def text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of texts from their characters' widths."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(L.width(name, 12, {}, 600), 6).alias("fixed"), F.round(L.width(name, 12, {" ": 250, "i": 220}, 500), 6).alias("proportional"))


@query()
def fit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits into three lines of 60 characters, and what remains."""
    first, rest = L.fit(F.col("text"), 60, 3)
    return table(spark, sf_dir, "benchmark").select("item_id", first.alias("fitted"), rest.alias("rest"))


@query(
    """SELECT doc_id, true AS ltr, text AS shown FROM documents UNION ALL
    SELECT * FROM (VALUES (-1, false, 'אבג abc 12'), (-2, false, 'ד 3.5'), (-3, true, 'abc')) t(doc_id, ltr, shown)"""
)
def direction_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the order that they are shown in."""
    extra = spark.createDataFrame([(-1, "abc 12 גבא"), (-2, "3.5 ד"), (-3, "abc")], "doc_id bigint, text string")
    df = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(extra)
    ltr = T.left_to_right(F.col("text"))
    return df.select("doc_id", ltr.alias("ltr"), L.visual_order(F.col("text"), ltr).alias("shown"))


@query(
    """WITH c AS (SELECT o_custkey AS table_id, CAST((rn - 1) // 3 AS INT) AS y, CAST((rn - 1) % 3 AS INT) AS x, CAST(o_orderkey AS VARCHAR) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t),
    moved AS (SELECT table_id, CASE WHEN y > 0 THEN y + 2 ELSE y END AS y, x, text FROM c), inner_cells AS (SELECT DISTINCT table_id, y, 1 AS x, 'inner' || y AS text FROM c, (VALUES (1), (2)) v(yy) WHERE y <= 3)
    SELECT * FROM moved m WHERE NOT EXISTS (SELECT 1 FROM inner_cells i WHERE i.table_id = m.table_id AND i.y = m.y AND i.x = m.x) UNION ALL SELECT * FROM inner_cells"""
)
def table_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows skipped after the first one, and a table of one column laid over the second column."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), "o_orderkey", F.col("o_orderkey").cast("string").alias("text"))
    cells = S.row_major(cells, ["table_id"], ["o_orderkey"], 3).select("table_id", "y", "x", "text")
    inner = cells.filter("y <= 3").select("table_id", "y", F.lit(0).alias("x"), F.concat(F.lit("inner"), "y").alias("text")).distinct()
    return S.add_subtable(S.skip_rows(cells, 0, 2), inner, 0, 1)


@query(
    """WITH RECURSIVE b AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << CAST(64 - i AS INT) ELSE 0 END))::HUGEINT AS v FROM (SELECT vec_id + k * 100000 AS vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= k THEN 1 - x * 0 ELSE x END) AS embedding FROM embeddings, (VALUES (0), (2)) t(k)) x),
    c AS (SELECT vec_id, v, bit_count(v) AS n FROM b), l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM c a JOIN c b ON a.n > 0 AND b.n > 0 AND power(CAST(bit_count(a.v & b.v) AS DOUBLE), 2) >= 0.95::DOUBLE * a.n * b.n),
    r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT vec_id, coalesce((SELECT min(y) FROM r WHERE x = vec_id), vec_id) AS class_id FROM b"""
)
def symbol_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of vectors' signs, and copies with two pixels set, put in one class where they are alike, directly or through others."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    again = e.select((F.col("vec_id") + 200000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i < 2, F.lit(1.0).cast("float")).otherwise(x)).alias("embedding"))
    return R.cluster(e.unionByName(again).select("vec_id", R.signature_bits(F.col("embedding")).alias("bits")), "vec_id", "bits")


@query("SELECT doc_id, text AS plain, true AS hidden, CAST(16 + 16 * (strlen(text) // 16 + 1) AS BIGINT) AS n_bytes FROM documents")
def aes256_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-CBC with a key of 256 bits; the vector that it starts from is derived from key and text and stored in front."""
    key = F.unhex(F.sha2(F.concat(F.lit("key"), F.col("doc_id").cast("string")), 256))
    start = F.substring(F.unhex(F.sha2(F.concat(F.hex("key"), F.lit("|"), "text"), 256)), 1, 16)
    df = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), "text").withColumn("secret", F.aes_encrypt("text", "key", F.lit("CBC"), F.lit("PKCS"), start))
    back = F.aes_decrypt("secret", "key", F.lit("CBC"), F.lit("PKCS")).cast("string")
    return df.select("doc_id", back.alias("plain"), (F.col("secret") != F.col("text").cast("binary")).alias("hidden"), F.octet_length("secret").cast("bigint").alias("n_bytes"))
