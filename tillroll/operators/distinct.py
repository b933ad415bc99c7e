"""Distinct counts of any period from stored sketches of its days.

A day's lines become one row: their number and a HyperLogLog sketch per column. Sketches of days merge into that of a
period, with the result that all of its lines would give, so a total of any period reads days and no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Registers are two to this power; the relative standard error is 1.04 / sqrt(2 ** SIZE), 0.8 %.
SIZE = 14
TOTALS = {"transactions": "InvoiceNo", "products": "StockCode", "customers": "CustomerID"}


def daily_sketches(lines: DataFrame, totals: dict[str, str] = TOTALS, size: int = SIZE) -> DataFrame:
    """(day, n_lines, a sketch per total); null is no value. Lines without a date are the day null."""
    return lines.groupBy(F.to_date("InvoiceDate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_lines"), *[F.hll_sketch_agg(F.col(c).cast("string"), size).alias(name) for name, c in totals.items()])


def period_sketch(days: DataFrame, totals: dict[str, str] = TOTALS) -> DataFrame:
    """The days as one row of the same kind, to be merged further."""
    return days.agg(F.sum("n_lines").alias("n_lines"), *[F.hll_union_agg(name).alias(name) for name in totals])


def period_totals(days: DataFrame, first=None, last=None, totals: dict[str, str] = TOTALS) -> DataFrame:
    """One row with the number of lines and the estimates for the days from ``first`` to ``last``, both included."""
    kept: Column = F.lit(True)
    if first is not None:
        kept = kept & (F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        kept = kept & (F.col("day") <= F.lit(last).cast("date"))
    whole = period_sketch(days.where(kept), totals)
    return whole.select(F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
                        *[F.coalesce(F.hll_sketch_estimate(name), F.lit(0).cast("long")).alias(name) for name in totals])
