"""Line values, baskets and order value ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.bands import ORDER_RANGES, order_range, range_names
from tillroll.functions.time import from_micros, mean_micros
from tillroll.schema import CATEGORIES


def line_value() -> Column:
    return F.col("UnitPrice") * (F.col("Quantity") - F.col("QuantityCanceled"))


def with_line_value(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumn("TotalPrice", line_value())


def with_category_spend(lines: DataFrame, n: int = CATEGORIES) -> DataFrame:
    """``categ_i``: the line value in the category of the product, never below 0."""
    spent = F.greatest(line_value(), F.lit(0))
    return lines.withColumns({
        f"categ_{i}": F.when(F.col("categ_product") == i, spent).otherwise(F.lit(0))
        for i in range(n)})


def baskets(cleaned: DataFrame, significant: bool = True) -> DataFrame:
    """One row per (customer, invoice): total, mean date and spend per category if known.

    All aggregates come from one grouping. ``significant`` keeps totals above 0.
    """
    spend = [c for c in cleaned.columns if c.startswith("categ_") and c != "categ_product"]
    table = cleaned.groupBy("CustomerID", "InvoiceNo").agg(
        F.sum(line_value()).alias("basket_price"),
        mean_micros(F.col("InvoiceDate")).alias("micros"),
        *[F.sum(c).alias(c) for c in spend])
    table = table.select("CustomerID", "InvoiceNo", "basket_price", *spend,
                         from_micros(F.col("micros")).alias("InvoiceDate"))
    return table.where("basket_price > 0") if significant else table


def order_ranges(basket_table: DataFrame, edges: list[int] = ORDER_RANGES) -> DataFrame:
    """Baskets per value range with their share of the total; empty ranges show as 0."""
    counts = [F.count_if(order_range(F.col("basket_price"), edges) == name).alias(name)
              for name in range_names(edges, open_end=False)]
    one_row = basket_table.agg(*counts)
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("price_range"), F.col(f"`{c}`").alias("n"))
        for i, c in enumerate(one_row.columns)])
    total = F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, c: s + c.n)
    return (one_row.select(total.alias("total"), F.inline(cells))
            .select("position", "price_range", "n",
                    F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).alias("share_pct")))


def basket_stats(basket_table: DataFrame) -> DataFrame:
    """Per customer: min, max, mean and sum of baskets and the share of each category in %.

    The denominator is the net sum, so shares may pass 100 together.
    """
    spend = [c for c in basket_table.columns if c.startswith("categ_")]
    price = F.col("basket_price")
    return basket_table.groupBy("CustomerID").agg(
        F.min(price).cast("double").alias("min"), F.max(price).cast("double").alias("max"),
        (F.sum(price).cast("double") / F.count(price)).alias("mean"),
        F.sum(price).cast("double").alias("sum"),
        *[F.try_divide(F.sum(c).cast("double") * 100, F.sum(price).cast("double")).alias(c)
          for c in spend])
