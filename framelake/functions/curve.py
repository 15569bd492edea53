"""Parameter curves: few sorted points (x, y, linear), evaluated for any number of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def evaluate(points: list[tuple[float, float, bool]], x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """The curve at x: lines after linear points, else cubics with the slopes of their neighbours; ends hold; 0 without points.

    Points are a script's handful and become one conditional expression.
    """
    points = sorted(points)
    if not points:
        return F.lit(0.0)
    out = F.when(x < points[0][0], points[0][1])
    for i, (x1, y1, linear) in enumerate(points[:-1]):
        x2, y2, _ = points[i + 1]
        x0, y0, _ = points[max(0, i - 1)]
        x3, y3, _ = points[min(len(points) - 1, i + 2)]
        t = (x - x1) / (x2 - x1) if x2 > x1 else F.lit(0.0)
        if linear or abs(x2 - x1) < 0.01:
            y = y1 + (y2 - y1) * t
        else:
            d = x2 - x1
            m1 = (y2 - y0) / (x2 - x0) * d if x2 > x0 else 0.0
            m2 = (y3 - y1) / (x3 - x1) * d if x3 > x1 else 0.0
            y = y1 + t * (m1 + t * ((-2 * m1 - m2 - 3 * (y1 - y2)) + t * (m1 + m2 + 2 * (y1 - y2))))
        out = out.when(x < x2, y)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), out.otherwise(points[-1][1])))


def bound(points: list[float], x: float, upper: bool) -> int:
    """The index of the first point above x (upper) or not below it."""
    from bisect import bisect_left, bisect_right

    return (bisect_right if upper else bisect_left)(points, x)


def with_opacity(original: DataFrame, filtered: DataFrame, points: list[tuple[float, float, bool]], channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """A filter's pixels blended over the original by the curve at the frame; under 0.5/255 it is skipped, from 254.5/255 on it is all."""
    d = filtered.select("frame", "x", "y", *(F.col(c).alias(f"{c}_f") for c in channels))
    alpha = evaluate(points, F.col("frame").cast("double"))
    joined = original.join(d, ["frame", "x", "y"]).withColumn("a_", alpha)
    k = F.floor(F.col("a_") * 256 + 0.5).cast("int")
    mixed = lambda c: F.when(F.col("a_") < 0.5 / 255, F.col(c)).when(F.col("a_") >= 254.5 / 255, F.col(f"{c}_f")).otherwise(F.col(c) + F.shiftright((F.col(f"{c}_f") - F.col(c)) * k + 128, 8))
    return joined.select("frame", "x", "y", *(mixed(c).cast("int").alias(c) for c in channels))


def as_table(spark: SparkSession, points: list[tuple[float, float, bool]]) -> DataFrame:
    return spark.createDataFrame([(float(x), float(y), bool(k)) for x, y, k in points], "x double, y double, linear boolean")
