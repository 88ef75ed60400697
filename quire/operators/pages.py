"""Page selection, merging and splitting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_range(pages: DataFrame, page_col: str, first: int, last: int) -> DataFrame:
    """Pages first to last; fails while running if the last page isn't there. The range reaches the scan as a filter."""
    most = pages.agg(F.coalesce(F.max(page_col), F.lit(-1)).alias("_most"))
    check = most.select(F.when(F.col("_most") < last, F.raise_error(F.lit(f"there is no page {last}")).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    # The check is a table of one row, so this is no product of tables.
    return pages.filter(F.col(page_col).between(first, last)).join(F.broadcast(check), F.col("_ok")).drop("_ok")


def merge(documents: Sequence[DataFrame], source_col: str = "source_idx") -> DataFrame:
    """Pages of all documents in input order, numbered by source from 1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn(source_col, F.lit(i)) for i, d in enumerate(documents, 1)))


def merge_fields(documents: Sequence[DataFrame], name_col: str = "name") -> DataFrame:
    """Form fields of all documents: the first keeps its names, later ones come under 'doc<i>.'."""
    parts = [d if i == 1 else d.withColumn(name_col, F.concat(F.lit(f"doc{i}."), F.col(name_col))) for i, d in enumerate(documents, 1)]
    return reduce(lambda a, b: a.unionByName(b), parts)
