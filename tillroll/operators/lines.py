"""Profiling and cleaning of invoice lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.rows import numbered_copies
from tillroll.schema import order_columns

TRAIN_END = datetime(2011, 10, 1)


def table_size(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(lines.columns)))


def preview(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """First ``n`` rows by ``keys``, rest of the row order as tiebreak."""
    rest = [c for c in order_columns(lines) if c not in keys] if "InvoiceDate" in lines.columns else []
    return lines.orderBy(*keys, *rest).limit(n)


def column_profile(lines: DataFrame) -> DataFrame:
    """Type, null count and null share of every column from one pass."""
    nulls = lines.agg(F.count("*").alias("n_rows"),
                      *[F.count_if(F.col(c).isNull()).alias(c) for c in lines.columns])
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"),
                 F.col(f.name).alias("null_count")) for f in lines.schema])
    return (nulls.select("n_rows", F.inline(cells))
            .select("column_name", "column_type", "null_count",
                    F.when(F.col("n_rows") > 0, F.col("null_count") * 100.0 / F.col("n_rows"))
                    .alias("null_pct")))


def constant_columns(lines: DataFrame) -> DataFrame:
    """Columns with at most one distinct non-null value.

    That is the case exactly when min and max agree, which needs no distinct count.
    """
    ends = lines.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in lines.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("constant"))
                      for c in lines.columns])
    return ends.select(F.inline(cells)).where("constant").select("column_name")


def drop_without_customer(lines: DataFrame) -> DataFrame:
    return lines.na.drop(subset=["CustomerID"])


def _line_groups(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = [c for c in lines.columns if c != "row_id"]
    aggs = [F.count("*").alias("n")]
    if "row_id" in lines.columns:
        aggs.append(F.min("row_id").alias("row_id"))
    return lines.groupBy(*keys).agg(*aggs), keys


def deduplicate(lines: DataFrame) -> DataFrame:
    """One line per set of equal lines, the first one if there is a ``row_id``."""
    groups, _ = _line_groups(lines)
    return groups.select(*lines.columns)


def duplicate_count(lines: DataFrame) -> DataFrame:
    groups, _ = _line_groups(lines)
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Second and later copies of equal lines.

    Copies are counted first (combined before the shuffle) and then written out in runs,
    so a line that fills a third of the table is not held by one task.
    """
    groups, keys = _line_groups(lines)
    return numbered_copies(groups.where("n > 1"), 2, F.col("n"), "copy_no").select(*keys, "copy_no")


def negative_prices(lines: DataFrame) -> DataFrame:
    return lines.where("UnitPrice < 0")


def split_by_time(lines: DataFrame, cutoff: datetime = TRAIN_END) -> tuple[DataFrame, DataFrame]:
    """(before, from) the cutoff; both filters reach the scan."""
    point = F.lit(cutoff).cast("timestamp_ntz")
    return lines.where(F.col("InvoiceDate") < point), lines.where(F.col("InvoiceDate") >= point)


def lookup(lines: DataFrame, **wanted) -> DataFrame:
    """Lines whose columns have the given values."""
    for name, value in wanted.items():
        lines = lines.where(F.col(name) == F.lit(value))
    return lines


def date_range(lines: DataFrame) -> DataFrame:
    return lines.agg(F.min("InvoiceDate").alias("first_date"), F.max("InvoiceDate").alias("last_date"))


def orders_per_country(lines: DataFrame) -> DataFrame:
    return (lines.select("CustomerID", "InvoiceNo", "Country").distinct()
            .groupBy("Country").agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "Country"))


def distinct_totals(lines: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return lines.agg(count("StockCode").alias("products"), count("InvoiceNo").alias("transactions"),
                     count("CustomerID").alias("customers"))


def special_codes(lines: DataFrame, pattern: str = "^[a-zA-Z]+") -> DataFrame:
    """Stock codes that match ``pattern`` with the description of their first line."""
    first = F.min_by("Description", F.struct(*order_columns(lines)))
    return (lines.where(F.col("StockCode").rlike(pattern))
            .groupBy("StockCode").agg(first.alias("Description")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def key_repeats(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat an earlier key; 0 means the key is unique."""
    return (df.groupBy(key).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats")))


def rename(df: DataFrame, names: dict[str, str], drop: list[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(names)
