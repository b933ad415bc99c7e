"""Length, recency, frequency and monetary value per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.time import calendar_days, elapsed_days, plus_one_day
from tillroll.operators.basket import line_value
from tillroll.session import materialize


def customer_metrics(basket_table: DataFrame) -> DataFrame:
    """All per-customer metrics from one grouping of the baskets.

    The snapshot is one day after the newest basket; it enters as a scalar subquery over
    the grouped customers, which are stored so that the baskets are not computed twice.
    ``MonetaryValue`` stays DECIMAL, so sums do not depend on order.
    """
    per_customer = materialize(basket_table.groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("last_date"), F.min("InvoiceDate").alias("first_date"),
        F.count("InvoiceNo").alias("Frequency"), F.sum("basket_price").alias("MonetaryValue")),
        "customers")
    newest = per_customer.agg(F.max("last_date").alias("newest")).scalar()
    return (per_customer.withColumn("newest", newest)
            .select("CustomerID",
                    elapsed_days(plus_one_day(F.col("newest")), F.col("last_date")).alias("Recency"),
                    "Frequency", F.col("MonetaryValue").cast("decimal(28,4)").alias("MonetaryValue"),
                    elapsed_days(F.col("last_date"), F.col("first_date")).alias("Lenght"),
                    calendar_days(F.col("newest"), F.col("last_date")).alias("LastPurchase"),
                    calendar_days(F.col("newest"), F.col("first_date")).alias("FirstPurchase")))


def rfm(metrics: DataFrame) -> DataFrame:
    return metrics.select("CustomerID", "Recency", "Frequency", "MonetaryValue")


def length(metrics: DataFrame) -> DataFrame:
    return metrics.select("CustomerID", F.col("MonetaryValue").alias("basket_price"), "Lenght",
                          "LastPurchase", "FirstPurchase")


def snapshot(basket_table: DataFrame) -> DataFrame:
    return basket_table.agg(plus_one_day(F.max("InvoiceDate")).alias("snapshot_date"),
                            F.to_date(F.max("InvoiceDate")).alias("last_date"))


def reconciliation(basket_table: DataFrame) -> DataFrame:
    """Per customer, straight from the baskets: what the metrics must add up to."""
    return basket_table.groupBy("CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("invoices"), F.max("InvoiceDate").alias("last_date"),
        F.sum("basket_price").alias("spend"),
        elapsed_days(F.max("InvoiceDate"), F.min("InvoiceDate")).alias("span_days"))


def line_reconciliation(lines: DataFrame) -> DataFrame:
    """Per customer, straight from the cleaned lines: invoices, spend, dates of lines and share of each category in %.

    Lines of invoices whose total is not above 0 don't count, as in the baskets; the total of an invoice
    is a window over its lines, so no basket is built.
    """
    spend = [c for c in lines.columns if c.startswith("categ_") and c != "categ_product"]
    total = F.sum(line_value()).over(Window.partitionBy("CustomerID", "InvoiceNo"))
    paid = lines.withColumn("value", line_value()).withColumn("total", total).where("total > 0")
    return paid.groupBy("CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("invoices"), F.count("*").alias("n_lines"), F.sum("value").alias("spend"),
        F.min("InvoiceDate").alias("first_line"), F.max("InvoiceDate").alias("last_line"),
        *[(F.sum(c).cast("double") * 100 / F.sum("value").cast("double")).alias(f"share_{c.removeprefix('categ_')}") for c in spend])
