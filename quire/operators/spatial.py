"""Spatial joins of points and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_cells(points: DataFrame, cells: DataFrame, grid: float) -> DataFrame:
    """Points (x, y) with the cells (llx, lly, urx, ury) that hold them, edges at the upper sides excluded.

    Cells are put into every square of a grid that they touch, so the join is by equality of squares and the exact test follows.
    """
    step = lambda c: F.floor(F.col(c) / grid)
    spread = cells.withColumn("_gx", F.explode(F.sequence(step("llx"), step("urx")))).withColumn("_gy", F.explode(F.sequence(step("lly"), step("ury"))))
    placed = points.withColumns({"_gx": step("x"), "_gy": step("y")})
    inside = (F.col("x") >= F.col("llx")) & (F.col("x") < F.col("urx")) & (F.col("y") >= F.col("lly")) & (F.col("y") < F.col("ury"))
    return placed.join(spread, ["_gx", "_gy"]).filter(inside).drop("_gx", "_gy")
