"""References, closures and revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import pages as P
from quire.operators import revision as R
from quire.plans.registry import query, table


@query("SELECT l.doc_id, d.lang, coalesce(d.source, 'null') AS source FROM (SELECT doc_id FROM labels UNION ALL SELECT -5) l LEFT JOIN documents d USING (doc_id)")
def resolve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to documents; one is dangling."""
    edges = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dst")).unionByName(spark.createDataFrame([(-5,)], "dst bigint"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return G.resolve(edges, d, "doc_id").select(F.col("dst").alias("doc_id"), "lang", F.coalesce("source", F.lit("null")).alias("source"))


@query("SELECT r_regionkey AS root, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def resolve_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that a region reaches through nations."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = nations.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    edges = edges.unionByName(customers.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    found = G.reachable(edges, roots, 3).filter(F.col("node").startswith("c"))
    return found.groupBy(F.substring("root", 2, 10).cast("int").alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, CAST(floor((p_partkey - 1) / 50) AS BIGINT) * 50 + p_partkey * 7 % 50 + 1 AS dst FROM part),
    w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT root, dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 12)
    SELECT root, node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1, 2"""
)
def reachable_with_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures over a cyclic graph from every part: each node once, at its least depth. A part's edge leads to one of its fifty."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    fifty = F.floor((F.col("p_partkey") - 1) / 50) * 50
    edges = parts.select(F.col("p_partkey").alias("src"), (fifty + F.col("p_partkey") * 7 % 50 + 1).alias("dst"))
    return G.reachable(edges, parts.select(F.col("p_partkey").alias("root")), 12)


@query(
    """SELECT conv_id, turn AS revision, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE turn <= 2) t WHERE n = 1"""
)
def revision_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version up to revision 2."""
    return R.as_of(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 2).select("conv_id", F.col("turn").alias("revision"), "text")


_REV = "(SELECT conv_id, role, text FROM conversations WHERE turn = {k})"


@query(f"SELECT b.conv_id, b.role FROM {_REV.format(k=2)} b LEFT JOIN {_REV.format(k=0)} a ON a.conv_id = b.conv_id WHERE a.conv_id IS NULL OR a.text IS DISTINCT FROM b.text")
def updated_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a revision that are new or changed."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    old, new = c.filter("turn = 0"), c.filter("turn = 2")
    return R.updated(new, old, ["conv_id"], "text").select("conv_id", "role")


_OLD, _NEW = "(SELECT conv_id, role FROM conversations WHERE turn = 1)", "(SELECT conv_id, role FROM conversations WHERE turn = 2)"
_DIFF_SQL = f"""SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CASE WHEN a.conv_id IS NULL THEN 'added' WHEN b.conv_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {_OLD} a FULL JOIN {_NEW} b ON a.conv_id = b.conv_id WHERE a.conv_id IS NULL OR b.conv_id IS NULL OR a.role IS DISTINCT FROM b.role"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.diff(c.filter("turn = 1"), c.filter("turn = 2"), ["conv_id"], "role")


@query(_DIFF_SQL)
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed objects between two revisions."""
    return _diff(spark, sf_dir)


@query(
    f"""SELECT level, kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS errors, sum(CASE WHEN ok THEN 0 ELSE 1 END) = 0 AS permitted FROM (
    SELECT level, kind, CASE kind WHEN 'field' THEN CASE WHEN change = 'removed' THEN level = 'no_restrictions' ELSE level <> 'no_changes' END
      WHEN 'annotation' THEN level IN ('no_restrictions', 'fill_forms_and_annots') ELSE false END AS ok
    FROM (SELECT change, CASE conv_id % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'annotation' ELSE 'page' END AS kind FROM ({_DIFF_SQL}) d) k,
    (VALUES ('no_changes'), ('fill_forms'), ('fill_forms_and_annots'), ('no_restrictions')) l(level)) x GROUP BY level, kind"""
)
def diff_permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each permission level allows the changes, by kind of object."""
    kind = F.when(F.col("conv_id") % 3 == 0, "field").when(F.col("conv_id") % 3 == 1, "annotation").otherwise("page")
    levels = F.explode(F.array(*(F.lit(x) for x in (R.NO_CHANGES, R.FILL_FORMS, R.FILL_FORMS_AND_ANNOTATIONS, R.NO_RESTRICTIONS))))
    d = _diff(spark, sf_dir).select(kind.alias("kind"), "change", levels.alias("level"))
    bad = (R.severity(F.col("kind"), F.col("change"), F.col("level")) == "error").cast("bigint")
    return d.groupBy("level", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("errors"), (F.sum(bad) == 0).alias("permitted"))


@query("SELECT CAST(page_id % 3 + 1 AS INT) AS source_idx, page_id FROM pages")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three documents in input order; every page is in one of them."""
    p = table(spark, sf_dir, "pages").select("page_id")
    return P.merge([p.filter(f"page_id % 3 = {k}") for k in range(3)])


@query(f"SELECT a.conv_id FROM {_OLD} a ANTI JOIN {_NEW} b ON a.conv_id = b.conv_id")
def except_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the older revision that the newer lacks."""
    c = table(spark, sf_dir, "conversations")
    return c.filter("turn = 1").select("conv_id").join(c.filter("turn = 2").select("conv_id"), "conv_id", "left_anti")
