"""Exact quantiles of any number of groups.

What is known of each wanted rank is a row of a table: group, rank, the range of values it lies in and how many values lie below. A
round joins the values to the ranges of their group, counts them in cells of each range (grouped where the rows are read), and takes
the cell with the rank as the next range. No group reaches the driver or sits in one task: a group with a third of all rows is counted like any other, a
million groups are a million rows of the table.

Values are compared as doubles. A range that spans signs or powers of two is cut on a signed logarithmic scale, any other one linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.operators.order_stats import CELLS, LEAST_STEP, POWERS
from tillroll.session import materialize

KEY = "_group"


def _power(x: Column) -> Column:
    """A number that does not fall as a double grows: the logarithm, with the sign of the value."""
    size = F.least(F.greatest(F.log2(F.abs(x)) + POWERS, F.lit(1.0)), F.lit(2.0 * POWERS))
    return F.when(x == 0, 0.0).when(x > 0, size).otherwise(-size)


def _cell(x: Column, low: Column, high: Column) -> Column:
    a, b = F.abs(low), F.abs(high)
    endless = (a == float("inf")) | (b == float("inf"))
    wide = endless | (low * high <= 0) | (F.greatest(a, b) > 4 * F.least(a, b))
    by_power = F.floor((_power(x) - _power(low)) / F.greatest((_power(high) - _power(low)) / CELLS, F.lit(LEAST_STEP)))
    return F.when(wide, by_power).otherwise(F.floor((x - low) / F.greatest((high - low) / CELLS, F.lit(LEAST_STEP))))


def group_quantiles(df: DataFrame, column: str, probabilities: list[float], group: str) -> DataFrame:
    """(group, n, quantiles): linear interpolation between neighbours, one array per group; null is a group.

    Nulls and NaN do not count, and a group without values has no row. ``df`` is read once per round, so pass a stored table.
    """
    value = F.col(column).cast("double")
    rows = df.select(F.col(group).alias(KEY), value.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    extent = materialize(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "group-extents")
    places = F.array(*[F.floor(F.lit(p) * (F.col("n") - 1)).cast("long") for p in probabilities])
    both = F.array_distinct(F.flatten(F.transform(places, lambda k: F.array(k, F.least(k + 1, F.col("n") - 1)))))
    state = extent.select(KEY, F.explode(both).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"))
    closed = []
    while True:
        state = materialize(state, "group-ranks")
        closed.append(state.where(F.col("low") == F.col("high")).select(KEY, "rank", F.col("low").alias("value")))
        open_ = state.where(F.col("low") < F.col("high"))
        if open_.isEmpty():
            break
        # ranks in the same range count its cells once
        ranges = open_.groupBy(KEY, "low", "high", "below").agg(F.collect_list("rank").alias("ranks"))
        named = ranges.withColumnRenamed(KEY, "named")
        met = rows.join(named.select("named", "low", "high"), F.col(KEY).eqNullSafe(F.col("named")) & F.col("x").between(F.col("low"), F.col("high")))
        cells = met.groupBy(KEY, "low", "high", _cell(F.col("x"), F.col("low"), F.col("high")).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
        before = Window.partitionBy(KEY, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS + 1 rows
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        wanted = named.withColumnsRenamed({"low": "a", "high": "b"})
        state = cells.join(wanted, F.col(KEY).eqNullSafe(F.col("named")) & (F.col("low") == F.col("a")) & (F.col("high") == F.col("b"))).withColumn(
            "rank", F.explode("ranks")).withColumn("under", F.col("below") + F.col("before")).where(
            (F.col("rank") >= F.col("under")) & (F.col("rank") < F.col("under") + F.col("n"))).select(
            KEY, "rank", F.col("first").alias("low"), F.col("last").alias("high"), F.col("under").alias("below"))
    found = closed[0]
    for part in closed[1:]:
        found = found.unionByName(part)
    known = found.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")).withColumnRenamed(KEY, "named")

    def interpolated(p: float) -> Column:
        exact = F.lit(p) * (F.col("n") - 1)
        k = F.floor(exact).cast("long")
        weight = exact - k
        a, b = F.col("at")[k], F.col("at")[F.least(k + 1, F.col("n") - 1)]
        return F.when((weight == 0) | (a == b), a).otherwise(a + (b - a) * weight)

    return extent.join(known, F.col(KEY).eqNullSafe(F.col("named"))).select(
        F.col(KEY).alias(group), "n", F.array(*[interpolated(p) for p in probabilities]).alias("quantiles"))
