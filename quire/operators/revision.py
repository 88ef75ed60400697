"""Revisions: versions of objects, changes between them and whether a policy permits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a certified document allows.
NO_CHANGES, FILL_FORMS, FILL_FORMS_AND_ANNOTATIONS, NO_RESTRICTIONS = "no_changes", "fill_forms", "fill_forms_and_annots", "no_restrictions"


def as_of(versions: DataFrame, key: list[str], revision: str, k: int) -> DataFrame:
    """The newest version of every object up to revision k."""
    w = Window.partitionBy(*key).orderBy(F.desc(revision))
    return versions.filter(F.col(revision) <= k).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def updated(new: DataFrame, old: DataFrame, key: list[str], value: str) -> DataFrame:
    """Objects that are new or differ."""
    before = old.select(*key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    return new.join(before, key, "left").filter("_was is null or not (_old <=> " + value + ")").drop("_old", "_was")


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, change): added, removed or changed objects, by a full outer join."""
    a = old.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").withColumn("change", change).filter("change is not null").select(*key, "change")


def severity(kind: Column, change: Column, level: Column) -> Column:
    """'warning' for a permitted change, else 'error': by kind of object ('field', 'annotation', 'page'), change and permission level."""
    field = F.when(change == "removed", level == NO_RESTRICTIONS).otherwise(level.isin(NO_RESTRICTIONS, FILL_FORMS, FILL_FORMS_AND_ANNOTATIONS))
    annotation = level.isin(NO_RESTRICTIONS, FILL_FORMS_AND_ANNOTATIONS)
    allowed = F.when(kind == "field", field).when(kind == "annotation", annotation).otherwise(F.lit(False))
    return F.when(allowed, "warning").otherwise("error")
