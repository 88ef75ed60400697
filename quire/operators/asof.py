"""As-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the newest right row of their key that isn't later; nulls if there is none.

    Both sides are put in one table and the newest values carried forward, so a key is sorted once and no pairs are made.
    """
    names = [c for c in left.columns if c not in (*keys, time)]
    a = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*names).alias("_l"), F.lit(None).alias("_r"))
    kind = right.select(F.struct(*values).alias("s")).schema["s"].dataType
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    both = a.withColumn("_r", F.lit(None).cast(kind)).unionByName(b)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_v", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select(*keys, time, "_l.*", "_v.*")
