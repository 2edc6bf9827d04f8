"""Piecewise linear accuracy curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.config import CURVE_A, CURVE_B


Knots = Sequence[tuple[float, float]]


def segment_of(x: Column, knots: Knots) -> Column:
    """Number of the segment ``x`` lies in, from the left; null outside.

    The last segment has no right end. Null, NaN and anything left of the first
    knot are outside. A balanced tree, so about log2(knots) comparisons.
    """
    starts = [start for start, _ in sorted(knots)[:-1]]

    def number(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last + 1) // 2
        left, right = number(first, middle - 1), number(middle, last)
        return F.when(x < starts[middle], left).otherwise(right)

    return F.when(~F.isnan(x) & (x >= starts[0]), number(0, len(starts) - 1))


def value_on(segment: Column, x: Column, knots: Knots) -> Column:
    """Value at ``x`` on the line of its segment; 0 outside.

    Start, value and slope are looked up in constant arrays. Where this is used
    for many rows, make ``segment`` a column of an earlier projection: that keeps
    the generated code small, and the JVM leaves methods above 8000 bytes
    uncompiled.
    """
    points = sorted(knots)
    slopes = [(y1 - y0) / (x1 - x0) for (x0, y0), (x1, y1) in zip(points, points[1:])]

    def entry(array: list[float]) -> Column:
        return F.get(F.lit(array), segment)

    start, value = entry([x0 for x0, _ in points[:-1]]), entry([y0 for _, y0 in points[:-1]])
    return F.coalesce(value + (x - start) * entry(slopes), F.lit(0.0))


def piecewise_linear(x: Column, knots: Knots) -> Column:
    """Interpolate between ``knots``; 0 for null, NaN and left of the first one."""
    return value_on(segment_of(x, knots), x, knots)


def curve_a(accuracy: Column) -> Column:
    return piecewise_linear(accuracy, CURVE_A)


def curve_b(accuracy: Column) -> Column:
    return piecewise_linear(accuracy, CURVE_B)
