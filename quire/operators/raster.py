"""Histograms, thresholds, packed samples and symbol classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, bin_col: Column, keys: list[str]) -> DataFrame:
    """(keys, bin, n)."""
    return values.groupBy(*keys, bin_col.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def triangle_threshold(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the bin that lies farthest under the line from the peak to the farther end of a histogram."""
    w = Window.partitionBy(*keys)
    peak = F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(w)
    df = bins.withColumns({"_p": -peak["b"], "_h": peak["n"], "_lo": F.min("bin").over(w), "_hi": F.max("bin").over(w)})
    right = (F.col("_hi") - F.col("_p")) >= (F.col("_p") - F.col("_lo"))
    df = df.withColumn("_end", F.when(right, F.col("_hi")).otherwise(F.col("_lo")))
    df = df.withColumn("_base", F.max(F.when(F.col("bin") == F.col("_end"), F.col("n"))).over(w))
    side = F.when(right, F.col("bin") >= F.col("_p")).otherwise(F.col("bin") <= F.col("_p"))
    span = F.col("_end") - F.col("_p")
    line = F.col("_h") + (F.col("_base") - F.col("_h")) * (F.col("bin") - F.col("_p")) / F.when(span != 0, span)
    gap = F.coalesce(F.round(line - F.col("n"), 6), F.lit(0.0))
    return df.filter(side).groupBy(*keys).agg(F.min_by("bin", F.struct((-gap).alias("g"), "bin")).alias("threshold"))


def unpack(data: Column, bits: int) -> Column:
    """Samples of 1, 2, 4 or 8 bits from an array of byte values, most significant first."""
    each = 8 // bits
    return F.flatten(F.transform(data, lambda x: F.transform(F.sequence(F.lit(each - 1), F.lit(0)), lambda i: F.call_function("shiftright", x, (i * bits).cast("int")).bitwiseAND((1 << bits) - 1))))


def pack(samples: Column, bits: int) -> Column:
    """The inverse of unpack; the last byte is filled with zeros."""
    each = 8 // bits
    n = F.ceil(F.size(samples) / each).cast("int")

    def byte(k: Column) -> Column:
        part = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.coalesce(F.get(samples, k * each + i), F.lit(0)))
        return F.aggregate(part, F.lit(0), lambda s, x: F.call_function("shiftleft", s, F.lit(bits)).bitwiseOR(x.cast("int")))

    return F.transform(F.sequence(F.lit(0), n - 1), byte)


def signature_bits(vector: Column) -> Column:
    """A 64-bit number from the signs of a vector's first 64 entries."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("bigint"), lambda s, x: F.call_function("shiftleft", s, F.lit(1)).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def correlation(a: Column, b: Column) -> Column:
    """Similarity of two bitmaps: shared bits squared over the product of the numbers of bits."""
    area = F.bit_count(a) * F.bit_count(b)
    shared = F.bit_count(a.bitwiseAND(b))
    return shared * shared / F.when(area > 0, area).cast("double")


def cluster(symbols: DataFrame, key: str, bits: str, threshold: float = 0.95) -> DataFrame:
    """(key, class_id): symbols (64-bit bitmaps) joined where their correlation reaches the threshold, and all that are connected through others.

    Correlated bitmaps differ in few bits, so of one more band of bits than that at least one is equal in both: pairs meet by equal bands, are
    made distinct and then scored. Equal bitmaps are one symbol in the join. At thresholds below 0.9 the bands are too short to be selective.
    """
    from quire.operators.graph import components

    differing = max(a + b - 2 * math.ceil(math.sqrt(threshold * a * b) - 1e-9) for a in range(1, 65) for b in range(a, min(64, int(a / threshold + 1e-9)) + 1))
    n = differing + 1
    shapes = symbols.filter(F.bit_count(bits) > 0).groupBy(F.col(bits).alias("shape")).agg(F.min(key).alias("first"))
    ends = [64 * i // n for i in range(n + 1)]
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.call_function("shiftrightunsigned", "shape", F.lit(lo)).bitwiseAND((1 << (hi - lo)) - 1).alias("b")) for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False))))
    placed = shapes.select("shape", F.inline(bands))
    other = placed.select(F.col("shape").alias("other"), "i", "b")
    pairs = placed.join(other, ["i", "b"]).filter("shape < other").select("shape", "other").distinct()
    linked = pairs.filter(correlation(F.col("shape"), F.col("other")) >= threshold)
    labels = components(linked.select(F.col("shape").alias("src"), F.col("other").alias("dst")))
    named = shapes.join(labels, F.col("shape") == F.col("node"), "left").select("shape", "first", F.coalesce("label", "shape").alias("label"))
    classes = named.groupBy(F.col("label").alias("l")).agg(F.min("first").alias("class_id"))
    of_shape = named.join(classes, F.col("label") == F.col("l")).select("shape", "class_id")
    # Empty bitmaps are like nothing; each is a class of its own.
    return symbols.join(of_shape, F.col(bits) == F.col("shape"), "left").select(key, F.coalesce("class_id", key).alias("class_id"))
