"""Outlier removal and distribution summaries with exact quantiles.

Every function reads its table several times; pass a stored or cached one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tillroll.operators.group_stats import group_quantiles
from tillroll.operators.order_stats import extents, quantiles, quantiles_of


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def remove_outliers_iqr(df: DataFrame, attributes: list[str] | None = None,
                        factor: float = 2) -> DataFrame:
    """Keep rows within ``factor`` interquartile ranges of the quartiles, attribute by attribute.

    Quartiles of an attribute come from the rows that passed the attributes before it.
    Bounds are inclusive, nulls drop, attributes that are not numeric are skipped.
    """
    numeric = numeric_columns(df)
    for name in attributes or df.columns:
        if name not in numeric:
            continue
        found = quantiles(df, name, [0.25, 0.75])
        if not found:
            return df.where(F.lit(False))
        q1, q3 = found[0]
        reach = factor * (q3 - q1)
        df = df.where(F.col(name).cast("double").between(q1 - reach, q3 + reach))
    return df


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles, one row per column."""
    moments = df.agg(*[F.struct(F.count(c).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
                                F.stddev_samp(F.col(c).cast("double")).alias("std"),
                                F.min(c).cast("double").alias("min"),
                                F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    found = quantiles_of(df, columns, [0.25, 0.5, 0.75])
    parts = []
    for c in columns:
        quarters = found.get(c, [None] * 3)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("m"),
                              *[F.lit(q).cast("double").alias(n) for q, n in zip(quarters, ("q1", "q2", "q3"))]))
    return (moments.select(F.inline(F.array(*parts)))
            .select("column_name", "m.count", "m.mean", "m.std", "m.min", "q1", "q2", "q3", "m.max"))


def box_stats(df: DataFrame, column: str, group: str | None = None, reach: float = 1.5) -> DataFrame:
    """Per group: quartiles, and whiskers at the last values within ``reach`` ranges; groups may be any number."""
    value = F.col(column).cast("double")
    placed = df.select((F.col(group) if group else F.lit("all")).alias("box"), value.alias("x")).where("x is not null")
    edges = group_quantiles(placed, "x", [0.25, 0.5, 0.75], "box").select(
        F.col("box").alias("named"), *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    met = placed.join(edges, F.col("box").eqNullSafe(F.col("named")))
    span = (F.col("q3") - F.col("q1")) * reach
    inside = F.col("x").between(F.col("q1") - span, F.col("q3") + span)
    return met.groupBy("box", "q1", "median", "q3").agg(
        F.count("*").alias("n"), F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max, the last one closed; bins without rows have 0. Values must be finite."""
    found = extents(df, column)
    if not found:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    _, low, high = found[0]
    low, width = float(low), (float(high) - float(low)) / bins
    place = (F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit(width)) if width
             else F.lit(0).cast("bigint"))
    counts = (df.where(F.col(column).isNotNull())
              .select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("n")))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
