"""Functions of one variable on [0, 1] as columns: exponential interpolation and stitching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def exponential(x: Column, c0: float, c1: float, n: float) -> Column:
    """c0 + x**n * (c1 - c0)."""
    return F.lit(c0) + F.pow(clamp(x), F.lit(float(n))) * F.lit(c1 - c0)


def stitching(x: Column, parts: Sequence[Callable[[Column], Column]], bounds: Sequence[float], encode: Sequence[tuple[float, float]]) -> Column:
    """The k-th part on the k-th interval of [0, 1] cut at the bounds, with the interval mapped to encode[k]."""
    x = clamp(x)
    edges = [0.0, *bounds, 1.0]
    out: Column | None = None
    for k in reversed(range(len(parts))):
        lo, hi, (e0, e1) = edges[k], edges[k + 1], encode[k]
        value = parts[k](F.lit(e0) + (x - lo) * F.lit((e1 - e0) / (hi - lo)))
        out = value if out is None else F.when(x < hi, value).otherwise(out)
    assert out is not None
    return out
