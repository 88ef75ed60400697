"""Lists, tables, tag streams, numbering, wrapping and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import structure as S
from quire.plans.registry import query, table

_OPS_SQL = r"""ops AS (
  SELECT page_id, CAST(i - 1 AS INT) AS seq, lower(regexp_extract(t[i], '<(/?)([A-Za-z!][A-Za-z0-9]*)([^>]*)>', 1) || regexp_extract(t[i], '<(/?)([A-Za-z!][A-Za-z0-9]*)([^>]*)>', 2)) AS operand,
         trim(regexp_extract(t[i], '<(/?)([A-Za-z!][A-Za-z0-9]*)([^>]*)>', 3)) AS params
  FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(/?)([A-Za-z!][A-Za-z0-9]*)([^>]*)>') AS t FROM pages) a) b
)"""
_STEP_SQL = "CASE WHEN operand IN ('meta','br','hr','img','input','link','!doctype') THEN 0 WHEN operand LIKE '/%' THEN -1 ELSE 1 END"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(f"WITH {_OPS_SQL} SELECT * FROM ops")
def content_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as a stream of operations."""
    return S.html_ops(_pages(spark, sf_dir))


@query(f"WITH {_OPS_SQL} SELECT page_id, seq, CAST(sum({_STEP_SQL}) OVER (PARTITION BY page_id ORDER BY seq) AS INT) AS depth FROM ops")
def operation_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the stack at every operation."""
    return S.with_depth(S.html_ops(_pages(spark, sf_dir))).select("page_id", "seq", "depth")


@query(f"WITH {_OPS_SQL} SELECT page_id, sum({_STEP_SQL}) > 0 AS unclosed FROM ops GROUP BY page_id UNION ALL VALUES (-1, true), (-2, false)")
def unbalanced_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stream leaves something open."""
    extra = spark.createDataFrame([(-1, "<q><b></b>"), (-2, "<q></q>")], "page_id bigint, html string")
    ops = S.html_ops(_pages(spark, sf_dir).select("page_id", "html").unionByName(extra))
    return ops.groupBy("page_id").agg((F.sum(S.step(F.col("operand"))) > 0).alias("unclosed"))


@query(f"WITH {_OPS_SQL} SELECT page_id, string_agg(CASE WHEN params <> '' THEN params || ' ' || operand ELSE operand END, chr(10) ORDER BY seq) AS content FROM ops GROUP BY page_id")
def operations_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams serialised again."""
    return S.bytes_of(S.html_ops(_pages(spark, sf_dir)))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script|style)[^>]*>[^<]*(?:<[^/][^<]*|</p>[^<]*)*</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a page."""
    return _pages(spark, sf_dir).select("page_id", S.plain_text(F.col("html")).alias("text"))


@query(
    """SELECT page_id, CAST(i - 1 AS INT) AS item, regexp_replace(t[i], '<[^>]*>', '', 'g') AS text
    FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>[^\\n]*?</li>') AS t FROM pages) a) b"""
)
def bullet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items in order."""
    items = F.regexp_extract_all("html", F.lit(r"<li>[^\n]*?</li>"), F.lit(0))
    return _pages(spark, sf_dir).select("page_id", F.posexplode(items).alias("item", "raw")).select("page_id", "item", F.regexp_replace("raw", "<[^>]*>", "").alias("text"))


@query("SELECT * FROM (VALUES (1, '• one'), (2, '  – inner'), (3, '  – inner 2'), (4, '• two')) t(line_no, shown)")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulleted lines with their nesting level, printed again with two spaces a level."""
    df = spark.createDataFrame([(1, "* one"), (2, "    - inner"), (3, "    - inner 2"), (4, "* two")], "line_no int, text string")
    indent = F.length(F.regexp_extract("text", r"^( *)[-*•]", 1))
    level = F.call_function("div", indent, F.lit(4)).cast("int")
    body = F.regexp_extract("text", r"^ *[-*•] *(.*)$", 1)
    return df.filter(F.col("text").rlike(r"^ *[-*•]")).select("line_no", F.concat(F.repeat(F.lit("  "), level), F.when(level == 0, "•").otherwise("–"), F.lit(" "), body).alias("shown"))


@query(
    """SELECT o_custkey AS table_id, CAST((rn - 1) // 3 AS INT) AS y, CAST((rn - 1) % 3 AS INT) AS x, CAST(o_orderkey AS VARCHAR) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t"""
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables with three columns, filled row by row."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), "o_orderkey", F.col("o_orderkey").cast("string").alias("text"))
    return S.row_major(cells, ["table_id"], ["o_orderkey"], 3).select("table_id", "y", "x", "text")


@query(
    """WITH c AS (SELECT o_custkey AS table_id, (rn - 1) // 3 AS y, (rn - 1) % 3 AS x, CAST(o_orderkey AS VARCHAR) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t)
    SELECT table_id, CAST(y AS INT) AS y, max(CASE WHEN x = 0 THEN text END) AS c0, max(CASE WHEN x = 1 THEN text END) AS c1, max(CASE WHEN x = 2 THEN text END) AS c2 FROM c GROUP BY table_id, y"""
)
def table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables with a column for each x."""
    wide = table_cells(spark, sf_dir).groupBy("table_id", "y").pivot("x", [0, 1, 2]).agg(F.max("text"))
    return wide.select("table_id", "y", F.col("0").alias("c0"), F.col("1").alias("c1"), F.col("2").alias("c2"))


@query(
    """WITH h AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END AS level FROM customer),
    a AS (SELECT *, sum(CASE level WHEN 1 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS one FROM h)
    SELECT c_nationkey, c_custkey, CASE level WHEN 1 THEN CAST(CAST(one AS BIGINT) AS VARCHAR) ELSE CAST(CAST(one AS BIGINT) AS VARCHAR) || '.' ||
    CAST(CAST(sum(CASE level WHEN 2 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey, one ORDER BY c_custkey) AS BIGINT) AS VARCHAR) END AS number FROM a"""
)
def toc_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical numbers of a table of contents."""
    heads = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(2).alias("level"))
    return S.numbering(heads, ["c_nationkey"], "c_custkey", "level").select("c_nationkey", "c_custkey", "number")


@query()
def wrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped at 72 characters: lines, and the longest one."""
    df = table(spark, sf_dir, "benchmark").select("item_id", L.wrap(F.col("text"), 72).alias("l"))
    return df.select("item_id", F.posexplode("l").alias("line_no", "text"))


@query(
    """SELECT doc_id, source, CAST(floor((sum(length(text) - length(replace(text, chr(10), '')) + 1) OVER (PARTITION BY source ORDER BY doc_id) - 1e-9) / 50) AS INT) AS page FROM documents"""
)
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source below one another, 50 lines a page."""
    df = table(spark, sf_dir, "documents").select("doc_id", "source", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("height"))
    return L.paginate(df, ["source"], ["doc_id"], "height", 50).select("doc_id", "source", "page")


@query(
    """SELECT p_partkey, CAST((rn - 1 + 2) // 4 AS INT) AS y, CAST((rn - 1 + 2) % 4 AS INT) AS x, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS colspan
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) t"""
)
def table_skip_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each brand, whose first two cells are skipped; cells carry spans."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1 + 2
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(n / 4).cast("int").alias("y"), (n % 4).cast("int").alias("x"), F.when(F.col("p_size") > 25, 2).otherwise(1).alias("colspan"))


_PRICE, _NET, _GROSS = "CAST(l_extendedprice AS DECIMAL(12,2))", "(1 - CAST(l_discount AS DECIMAL(4,2)))", "(1 + CAST(l_tax AS DECIMAL(4,2)))"
_TOTALS = [f"CAST(sum({_PRICE}) AS DOUBLE) AS subtotal", f"CAST(sum({_PRICE} * {_NET}) AS DOUBLE) AS net", f"CAST(sum({_PRICE} * {_NET} * {_GROSS}) AS DOUBLE) AS total"]


@query(f"SELECT l_orderkey, {', '.join(_TOTALS)} FROM lineitem GROUP BY 1")
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total lines of invoices, in exact decimals."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*map(F.expr, _TOTALS))
