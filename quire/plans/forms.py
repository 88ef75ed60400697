"""Forms, JSON, maps and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.cmap import decode as cmap_decode_rows
from quire.operators import forms as O
from quire.operators import pages as P
from quire.plans.registry import query, table


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("name"), F.get_json_object("props", "$.k").alias("value"),
        F.array(F.lit("Off"), F.col("event_type")).alias("options"),
    )


_FIELDS_SQL = "(SELECT user_id, 'f' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS name, json_extract_string(props, '$.k') AS value, ['Off', event_type] AS options FROM events)"


@query(f"SELECT user_id, CAST(count(*) AS BIGINT) AS n, string_agg(name || '=' || coalesce(value, ''), ';' ORDER BY name) AS shown FROM {_FIELDS_SQL} f GROUP BY user_id")
def fields_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as a JSON array, read back."""
    back = O.to_json(_fields(spark, sf_dir), "user_id").select("user_id", O.from_json(F.col("json")).alias("f"))
    shown = F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ";")
    return back.select("user_id", F.size("f").cast("bigint").alias("n"), shown.alias("shown"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS none FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lookups in JSON; an absent key is null."""
    v = F.parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").isNull().alias("none"))


@query(
    """SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 25 THEN 'large' ELSE p_type END AS kind, p_name AS name, 3 AS n FROM part"""
)
def dict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps merged, set and conditionally set; the last value wins."""
    m = O.merge(F.create_map(F.lit("brand"), F.lit("x"), F.lit("kind"), F.col("p_type")), F.create_map(F.lit("brand"), F.col("p_brand")))
    m = O.put_if_not_null(O.put(m, "name", F.col("p_name")), "kind", F.when(F.col("p_size") > 25, "large"))
    df = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return df.select("p_partkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("brand", "kind", "name")), F.size("m").alias("n"))


@query("SELECT p_partkey, 'brand,type' AS keys, p_brand AS brand FROM part")
def dict_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys removed; the others keep their order."""
    m = O.remove(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type")), "name", "none")
    df = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return df.select("p_partkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.col("m")["brand"].alias("brand"))


@query(
    """SELECT l_orderkey, l_linenumber, 4 AS n, l_partkey AS first, CAST(NULL AS BIGINT) AS beyond, l_suppkey AS at1, -1::BIGINT AS replaced, CAST(NULL AS BIGINT) AS no_such,
    CAST(l_quantity AS BIGINT) AS number FROM lineitem"""
)
def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays: append, get (null beyond the end), replace, typed conversion."""
    a = F.array_append(F.array("l_partkey", "l_suppkey", "l_orderkey"), F.col("l_quantity").cast("bigint"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"))
    typed = F.transform(F.transform("a", lambda x: x.cast("string")), lambda x: x.try_cast("bigint"))
    return df.select(
        "l_orderkey", "l_linenumber", F.size("a").alias("n"), F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(9)).alias("beyond"), F.get("a", F.lit(1)).alias("at1"),
        F.get(O.set_at(F.col("a"), 2, F.lit(-1).cast("bigint")), F.lit(2)).alias("replaced"), F.get(O.set_at(F.col("a"), 7, F.lit(0).cast("bigint")), F.lit(7)).alias("no_such"),
        F.get(typed, F.lit(3)).alias("number"),
    )


@query(f"SELECT user_id, CAST(count(DISTINCT name) AS BIGINT) AS n FROM {_FIELDS_SQL} f WHERE value IS NOT NULL AND value <> '' GROUP BY user_id")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a value, as a map."""
    fields = _fields(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("name", "value", "options")).alias("f"))
    return fields.select("user_id", F.size(O.values(F.col("f"))).cast("bigint").alias("n")).filter("n > 0")


_FORM_A = "(SELECT 'c' || c_custkey AS name, c_mktsegment AS value FROM customer)"


@query(
    f"""SELECT name, CASE WHEN CAST(substr(name, 2) AS BIGINT) % 2 = 0 AND CAST(substr(name, 2) AS BIGINT) % 3 <> 0 THEN 'new' || substr(name, 2) ELSE value END AS value FROM {_FORM_A} f"""
)
def fill_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields filled by name; empty values change nothing."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey"))
    fields = c.select(name.alias("name"), F.col("c_mktsegment").alias("value"))
    new = c.filter("c_custkey % 2 = 0").select(name.alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("new"), F.col("c_custkey"))).alias("value"))
    return O.fill(fields, new)


@query(f"SELECT name, value FROM {_FORM_A} f UNION ALL SELECT 'doc2.' || name, value FROM {_FORM_A} f UNION ALL SELECT 'doc3.' || name, 'x' FROM {_FORM_A} f WHERE name = 'c1'")
def merge_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of several documents: later ones' names come under a parent of their own."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("value"))
    return P.merge_fields([c, c, c.filter("name = 'c1'").withColumn("value", F.lit("x"))])


@query(
    """WITH c AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part)
    SELECT p_partkey, string_agg(CASE WHEN substr(p_name, i, 1) BETWEEN 'a' AND 'z' THEN upper(substr(p_name, i, 1)) WHEN substr(p_name, i, 1) BETWEEN '0' AND '9' THEN substr(p_name, i, 1) ELSE chr(65533) END, '' ORDER BY i) AS text,
    CAST(sum(CASE WHEN substr(p_name, i, 1) BETWEEN 'a' AND 'z' OR substr(p_name, i, 1) BETWEEN '0' AND '9' THEN 0 ELSE 1 END) AS BIGINT) AS misses FROM c GROUP BY p_partkey"""
)
def cmap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to text through a character map given by ranges; misses are counted."""
    ranges = [(0x61, 0x7A, 0x41), (0x30, 0x39, 0x30)]
    return cmap_decode_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", ranges)


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 1000 AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(floor(x / 10) AS INT) AS cell_x, CAST(floor(y / 25) AS INT) AS cell_y FROM m WHERE x < 50 AND y < 100"""
)
def cell_of_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table cell that holds each point: a range join turned into an equi-join by grid."""
    from quire.operators.spatial import in_cells

    marks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 1000).alias("y"))
    cells = spark.range(20).select((F.col("id") % 5).cast("int").alias("cell_x"), F.floor(F.col("id") / 5).cast("int").alias("cell_y"))
    cells = cells.withColumns({"llx": F.col("cell_x") * 10.0, "lly": F.col("cell_y") * 25.0, "urx": F.col("cell_x") * 10.0 + 10, "ury": F.col("cell_y") * 25.0 + 25})
    return in_cells(marks, cells, 20.0).select("l_orderkey", "l_linenumber", "cell_x", "cell_y")
