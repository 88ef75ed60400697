"""Text layout: lines, words, positioned marks, reading order, lists, wrapping and pages.

Positions come from a fixed-pitch page: 10 units a column, 12 units a line, the first line at the top. Order is data:
every table carries line and word numbers and character offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpointed

#: Units of a column and of a line.
ADVANCE, LEADING = 10.0, 12.0

#: The same tables for DuckDB, as common table expressions over ``documents``.
LINES_SQL = """lines AS (
  SELECT doc_id, CAST(g.i - 1 AS INT) AS line_no, l[g.i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) g
)"""
WORDS_SQL = f"""{LINES_SQL}, parts AS (
  SELECT doc_id, line_no, CAST(g.i - 1 AS INT) AS word_no, w[g.i] AS text
  FROM (SELECT doc_id, line_no, string_split(text, ' ') AS w FROM lines) d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) g
), words AS (
  SELECT * FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS col_no FROM parts) p
  WHERE text <> ''
)"""
MARKS_SQL = f"""{WORDS_SQL}, marks AS (
  SELECT doc_id, line_no, word_no, text, CAST(10 * col_no AS DOUBLE) AS llx, CAST(-12 * line_no - 12 AS DOUBLE) AS lly, CAST(10 * (col_no + length(text)) AS DOUBLE) AS urx, CAST(-12 * line_no AS DOUBLE) AS ury FROM words
)"""


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): lines from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, word_no, text, col_no): words between single spaces, numbered among the line's parts; col_no counts characters before it."""
    return words_of(lines(docs))


def words_of(lines_df: DataFrame) -> DataFrame:
    """The words of lines (doc_id, line_no, text), whose other columns stay. A line's words come from its own row, so nothing is shuffled."""
    keys = [c for c in lines_df.columns if c != "text"]
    source = lines_df.select(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch.column(len(keys)).fill_null(""), " ")
            line, text = pc.list_parent_indices(parts), parts.flatten()
            first = parts.offsets.to_numpy()[line.to_numpy()]
            lengths = pc.utf8_length(text).to_numpy()
            before = np.cumsum(lengths + 1, dtype=np.int64) - lengths - 1
            number = np.arange(len(lengths)) - first
            kept = pa.array(np.flatnonzero(lengths))
            columns = [c.take(line.take(kept)) for c in batch.columns[:-1]]
            made = (pa.array(number.astype(np.int32)), text, pa.array((before - before[first]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*columns, *(c.take(kept) for c in made)], names=[*keys, "word_no", "text", "col_no"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, word_no int, text string, col_no int")


def in_range(docs: DataFrame, start: int, end: int) -> DataFrame:
    """(doc_id, line_no, word_no, text, offset): words that overlap the offsets start to end (exclusive); offsets count the whole text's characters."""
    lengths = docs.select("doc_id", "text", F.transform(F.split("text", "\n", -1), F.length).alias("lengths"))
    # Lines that start behind the end are never needed, so running sums stop there.
    first = F.aggregate(
        "lengths", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")),
        lambda s, n: F.when(s["at"] < end, F.struct((s["at"] + n + 1).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))).otherwise(s),
        lambda s: s["starts"],
    )
    each = lengths.select("doc_id", "text", F.posexplode(first).alias("line_no", "at"))
    line = F.get(F.split("text", "\n", -1), F.col("line_no"))
    own = words_of(each.select("doc_id", "line_no", "at", line.alias("text")))
    offset = F.col("at") + F.col("col_no")
    return own.filter((offset < end) & (offset + F.length("text") > start)).select("doc_id", "line_no", "word_no", "text", offset.alias("offset"))


def marks(docs: DataFrame) -> DataFrame:
    """Words with boxes."""
    at, size = F.col("col_no"), F.length("text")
    return words(docs).select(
        "doc_id", "line_no", "word_no", "text",
        (at * ADVANCE).alias("llx"), (F.col("line_no") * -LEADING - LEADING).alias("lly"),
        ((at + size) * ADVANCE).alias("urx"), (F.lit(0.0) - F.col("line_no") * LEADING).alias("ury"),
    )


def overlaps(llx: float, lly: float, urx: float, ury: float) -> Column:
    """Whether a mark's box overlaps an area."""
    return (F.col("llx") < urx) & (F.col("urx") > llx) & (F.col("lly") < ury) & (F.col("ury") > lly)


def joined_lines(marks_df: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): marks joined by spaces in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    return marks_df.groupBy("doc_id", "line_no").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often the use's own functions read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_by_gap(chars: Column, gap: float) -> Column:
    """Characters (an array of structs llx, urx, text) joined to words (text, llx, urx) where the gap to the one before is at most ``gap``."""
    none = F.expr("cast(array() as array<int>)")

    def word(own: Column) -> Column:
        text = F.array_join(F.transform(own, lambda x: x["text"]), "")
        return F.struct(text.alias("text"), F.get(own, F.lit(0))["llx"].alias("llx"), F.array_max(F.transform(own, lambda x: x["urx"])).alias("urx"))

    def parted(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(none)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i)["llx"] - F.get(ordered, i - 1)["urx"] > gap))
        return bound(starts, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda i, j: word(F.slice(ordered, i + 1, F.coalesce(j, F.size(ordered)) - i))))

    return bound(F.array_sort(chars), parted)


def dehyphenated(lines_df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, line_no, text) where a word that ends in a hyphen is completed with the next line's first word, which is taken away there."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    broken = F.col("text").rlike(r"[\p{L}]-$")
    df = lines_df.withColumns({"_next": F.lead("text").over(w), "_taken": F.coalesce(F.lag(broken).over(w), F.lit(False))})
    own = F.when(F.col("_taken"), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text"))
    first = F.regexp_extract("_next", r"^(\S+)", 1)
    whole = F.when(broken & F.col("_next").isNotNull(), F.concat(F.regexp_replace(own, "-$", ""), first)).otherwise(own)
    return df.select(*keys, "line_no", whole.alias("text"))


def distinct_marks(marks_df: DataFrame, keys: list[str], precision: float) -> DataFrame:
    """Marks without those printed again at (nearly) the same place: the first of equal (text, place) stays."""
    w = Window.partitionBy(*keys, "text", F.round(F.col("llx") / precision), F.round(F.col("lly") / precision)).orderBy("seq")
    return marks_df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def normalized_size(llx: Column, lly: Column, urx: Column, ury: Column, rotate: Column) -> tuple[Column, Column]:
    """Width and height of a page once its rotation (a multiple of 90) is taken out."""
    upright = F.pmod(rotate, F.lit(180)) == 0
    width, height = urx - llx, ury - lly
    return F.when(upright, width).otherwise(height), F.when(upright, height).otherwise(width)


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` characters (a longer word stands alone), as an array: one fold over the words."""
    parts = F.filter(F.split(text, r"[ \n]+"), lambda x: x != "")

    def add(s: Column, x: Column) -> Column:
        fits = F.length(s["now"]) + 1 + F.length(x) <= width
        first = s["now"] == ""
        return F.struct(
            F.when(first | fits, s["out"]).otherwise(F.array_append(s["out"], s["now"])).alias("out"),
            F.when(first, x).when(fits, F.concat(s["now"], F.lit(" "), x)).otherwise(x).alias("now"),
        )

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("now"))
    return F.aggregate(parts, start, add, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.array_append(s["out"], s["now"])))


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (inclusive) by key and order. A key may hold any share of the rows: ranges of (key, order) are summed by themselves, and only
    the ranges' totals, one row for each key and range, meet by key."""
    # The ranges come from a sample, so they must be the same rows for both uses.
    ranged = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *keys).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    totals = totals.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    match = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(totals, match)
    return own.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).select(*df.columns, *sums)


def paginate(items: DataFrame, keys: list[str], order: list[str], height: str, page_height: float) -> DataFrame:
    """Adds page (from 0): items are laid below one another by running height; an item starts on the page its end falls on."""
    df = running_sums(items, keys, order, {"_end": F.col(height)})
    return df.withColumn("page", F.floor((F.col("_end") - F.lit(1e-9)) / page_height).cast("int")).drop("_end")


def fit(text: Column, width: int, lines: int) -> tuple[Column, Column]:
    """(what fits into so many lines, what remains), both as lines of text."""
    own = wrap(text, width)
    return (
        F.array_join(F.slice(own, 1, lines), "\n"),
        bound(own, lambda x: F.array_join(F.slice(x, F.lit(lines + 1), F.greatest(F.size(x) - lines, F.lit(0))), "\n")),
    )


def width(text: Column, size: float, widths: dict[str, float], default: float) -> Column:
    """A text's width: its characters' widths in thousandths of the size, summed up."""
    groups: dict[float, str] = {}
    for c, w in widths.items():
        groups[w] = groups.get(w, "") + c
    known = F.lit(0.0)
    for w, chars in groups.items():
        known = known + (F.length(text) - F.length(F.translate(text, chars, ""))) * (w - default)
    return (F.length(text) * default + known) * size / 1000


def visual_order(text: Column, left_to_right: Column) -> Column:
    """A text in the order that its characters are shown in: right-to-left texts are turned round, but runs of Latin letters and digits in them aren't."""

    @F.arrow_udf("string")
    def turned(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            parts = [] if t is None else re.findall(r"[0-9A-Za-z\u00c0-\u024f]+(?:[ .,:/-]+[0-9A-Za-z\u00c0-\u024f]+)*|.", t, re.DOTALL)
            out.append(None if t is None else "".join(reversed(parts)))
        return pa.array(out, pa.string())

    return F.when(left_to_right, text).otherwise(turned(text))
