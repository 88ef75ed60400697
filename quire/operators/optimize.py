"""Size optimiser: a chain of passes over objects (obj_num, seq, kind, content, refs), and its passes.

A pass takes and returns a DataFrame; a failing pass is logged and its input goes on. Passes run in a fixed order.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Pass = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


class Chain:
    """Passes in order."""

    def __init__(self, passes: Sequence[tuple[str, Pass]] = ()):
        self.passes = list(passes)

    def append(self, name: str, each: Pass) -> Chain:
        self.passes.append((name, each))
        return self

    def optimize(self, objects: DataFrame) -> DataFrame:
        """Applies the passes. A pass that fails while its plan is made is skipped; failures of rows are the caller's."""
        for name, each in self.passes:
            try:
                objects = each(objects)
            except Exception:  # best effort: the pass's input goes on
                log.exception("pass %s failed", name)
        return objects


def combine_duplicates(objects: DataFrame, key: list[str], exempt: str = "false") -> DataFrame:
    """(obj_num, survivor): among objects with equal keys the first in order survives; exempt ones stay themselves.

    Keys are digested, so that groups shuffle hashes instead of contents.
    """
    hashed = objects.select("obj_num", "seq", F.sha2(F.to_json(F.struct(*key)), 256).alias("_h"), F.expr(exempt).alias("_exempt"))
    first = hashed.filter("not _exempt").groupBy("_h").agg(F.min_by("obj_num", "seq").alias("_first"))
    return hashed.join(first, "_h", "left").select("obj_num", F.when(F.col("_exempt"), F.col("obj_num")).otherwise(F.col("_first")).alias("survivor"))


def rewire(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges (src, key, dst) whose targets are replaced by their survivors."""
    return edges.join(survivors, edges.dst == survivors.obj_num, "left").select("src", "key", F.coalesce("survivor", "dst").alias("dst"))


def clean_unused(objects: DataFrame, edges: DataFrame, roots: str = "kind = 'page'") -> DataFrame:
    """Objects that something refers to, and the roots."""
    used = edges.select(F.col("dst").alias("obj_num")).distinct()
    return objects.filter(roots).unionByName(objects.filter(f"not ({roots})").join(used, "obj_num", "left_semi"))


def object_streams(objects: DataFrame, size: int, group: str) -> DataFrame:
    """(group, container, n): small objects gathered in containers of ``size``; a lone object gets none."""
    w = Window.partitionBy(group).orderBy("obj_num")
    numbered = objects.withColumn("container", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.groupBy(group, "container").agg(F.count(F.lit(1)).alias("n"), F.min("obj_num").alias("first"), F.max("obj_num").alias("last")).filter("n > 1")


def clean_operations(ops: DataFrame, dropped: Sequence[str]) -> DataFrame:
    """Operations without the dropped kinds and with shortened numbers (no trailing zeros)."""
    return ops.filter(~F.col("operand").isin(*dropped)).withColumn("params", F.regexp_replace("params", r"(\.[0-9]*[1-9])0+|\.0+", "$1"))
