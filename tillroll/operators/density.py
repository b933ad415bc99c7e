"""Density curves: Gaussian kernel estimates on a grid.

Values are dealt to the two grid points beside them, each with a share that falls with the distance (linear binning), in one grouped
count of at most as many rows as the grid has points. The curve is then a weighted sum over the neighbouring points of the grid, a window with
a range, so its cost does not depend on the rows of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

POINTS = 256
#: The grid reaches so many bandwidths beyond the values, and a kernel so many around its point.
CUT, REACH = 3, 6


def bandwidth(n: int, deviation: float) -> float:
    """Scott's rule: the sample deviation times n to the power of -1/5."""
    return deviation * n ** -0.2


def density(df: DataFrame, column: str, points: int = POINTS) -> DataFrame:
    """(point, x, density) on an even grid; the density sums to 1 over the line.

    Nulls and values that are not finite do not count. Without two different values there is no curve and no row.
    """
    value = F.col(column).cast("double")
    present = df.select(value.alias("x")).where(F.col("x").isNotNull() & (F.abs("x") < float("inf")) & ~F.isnan("x"))
    n, low, high, deviation = present.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.stddev_samp("x")).first()
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    if not n or n < 2 or not deviation:
        return grid.select("point", F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    h = bandwidth(n, deviation)
    start, step = low - CUT * h, (high - low + 2 * CUT * h) / (points - 1)
    place = (F.col("x") - F.lit(start)) / F.lit(step)
    left = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    beside = present.select(left.alias("left"), (place - left).alias("part")).groupBy("left").agg(
        F.sum(1 - F.col("part")).alias("low"), F.sum("part").alias("high"))
    weights = beside.select(F.inline(F.array(F.struct(F.col("left").alias("at"), F.col("low").alias("w")),
                                             F.struct((F.col("left") + 1).alias("at"), F.col("high").alias("w"))))).groupBy("at").agg(F.sum("w").alias("w"))
    table = grid.join(weights, grid.point == weights["at"], "left").select("point", F.coalesce("w", F.lit(0.0)).alias("w"))
    reach = math.ceil(REACH * h / step)
    near = Window.orderBy("point").rangeBetween(-reach, reach)  # a grid of bounded size
    around = F.collect_list(F.struct("point", "w")).over(near)
    apart = lambda p: (p["point"] - F.col("point")) * F.lit(step / h)
    curve = F.aggregate(F.col("around"), F.lit(0.0), lambda s, p: s + p["w"] * F.exp(apart(p) * apart(p) * -0.5))
    return table.withColumn("around", around).select(
        "point", (F.lit(start) + F.col("point") * F.lit(step)).alias("x"), (curve / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))
