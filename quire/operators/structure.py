"""Structure in tag streams and lists: operator streams, depth, lists, tables, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.layout import running_sums

#: Tags that never close.
VOID = ("meta", "br", "hr", "img", "input", "link", "!doctype")
TAG = r"<(/?)([A-Za-z!][A-Za-z0-9]*)([^>]*)>"


def html_ops(pages: DataFrame) -> DataFrame:
    """(page_id, seq, operand, params): tags as an ordered stream of operations; operand is 'name' or '/name'."""
    tags = F.regexp_extract_all("html", F.lit(TAG), F.lit(0))
    ops = pages.select("page_id", F.posexplode(tags).alias("seq", "tag"))
    name = F.lower(F.concat(F.regexp_extract("tag", TAG, 1), F.regexp_extract("tag", TAG, 2)))
    return ops.select("page_id", "seq", name.alias("operand"), F.trim(F.regexp_extract("tag", TAG, 3)).alias("params"))


def step(operand: Column) -> Column:
    """1 where an operation pushes, -1 where it pops."""
    return F.when(operand.isin(*VOID), 0).when(operand.startswith("/"), -1).otherwise(1)


def with_depth(ops: DataFrame) -> DataFrame:
    """Adds depth: the height of the stack after each operation, as a running sum."""
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("depth", F.sum(step(F.col("operand"))).over(w).cast("int"))


def bytes_of(ops: DataFrame) -> DataFrame:
    """Operations serialised in order, one in a line."""
    line = F.concat_ws(" ", F.when(F.col("params") != "", F.col("params")), F.col("operand"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return ops.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))


def plain_text(html: Column) -> Column:
    """Text without tags, scripts and styles; white space is single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)(?:[\s/][^>]*)?>.*?</\1(?:[\s/][^>]*)?>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def row_major(cells: DataFrame, keys: list[str], order: list[str], columns: int) -> DataFrame:
    """Adds y and x of a table with so many columns, filled row by row."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return cells.withColumn("_n", n).withColumns({"y": F.floor(F.col("_n") / columns).cast("int"), "x": (F.col("_n") % columns).cast("int")}).drop("_n")


def numbering(headings: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """Adds number: hierarchical ('2.1'), from heading levels 1 and 2 in order."""
    df = running_sums(headings, keys, [order], {"_one": F.when(F.col(level) == 1, 1).otherwise(0), "_two": F.when(F.col(level) == 2, 1).otherwise(0)})
    # The headings of a chapter are few, so what came before it is found among them: at its own heading, or nothing before the first one.
    inner = Window.partitionBy(*keys, "_one")
    first = F.min(F.when(F.col(level) == 1, F.col("_two"))).over(inner)
    two = F.col("_two") - F.coalesce(first, F.lit(0))
    return df.withColumn("number", F.when(F.col(level) == 1, F.col("_one").cast("string")).otherwise(F.concat_ws(".", F.col("_one"), two))).drop("_one", "_two")


def skip_rows(cells: DataFrame, after: int, n: int) -> DataFrame:
    """Cells (y, x) below row ``after`` moved down by n rows."""
    return cells.withColumn("y", F.when(F.col("y") > after, F.col("y") + n).otherwise(F.col("y")))


def add_subtable(cells: DataFrame, inner: DataFrame, y: int, x: int) -> DataFrame:
    """A table's cells and another's, placed at (y, x); where both have a cell the inner one's stays."""
    moved = inner.withColumns({"y": F.col("y") + y, "x": F.col("x") + x})
    keys = [c for c in cells.columns if c != "text"]
    return cells.join(moved.select(*keys), keys, "left_anti").unionByName(moved.select(*cells.columns))
