"""Operations beyond the surveyed engine, for tables of events: windows, sessions, cubes, sketches, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.asof import as_of_join
from quire.plans.registry import query, table


@query("SELECT date_trunc('day', ts) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 day")
    return table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS started, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours of silence."""
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "started", "n")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT n_regionkey, n_nationkey, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).rollup("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts, within a tenth of the exact ones."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("e"))
    return g.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("close"))


@query(
    """SELECT e.event_id, max(p.ts) AS purchase_ts FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts GROUP BY 1"""
)
def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's newest purchase before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    p = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("purchase_ts"))
    return as_of_join(e, p, ["user_id"], "ts", ["purchase_ts"]).select("event_id", "purchase_ts")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each priority (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice")
