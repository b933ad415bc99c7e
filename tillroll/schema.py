"""Column names and types of the invoice-line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INVOICE_LINES = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("UnitPrice", T.DecimalType(12, 4)),
    T.StructField("CustomerID", T.LongType()),
    T.StructField("Country", T.StringType()),
])

LINE_COLUMNS = INVOICE_LINES.fieldNames()

# Order of lines when the source has no position of its own (see read_csv's row_id).
VALUE_ORDER = ["InvoiceDate", "InvoiceNo", "StockCode", "Description", "Quantity",
               "UnitPrice", "CustomerID", "Country"]

CATEGORIES = 5

FEATURES = ["Recency", "Frequency", "MonetaryValue", "Lenght", "Proximidade_Marca_Score",
            "RFML_Score", "min", "max", "mean"] + [f"categ_{i}" for i in range(CATEGORIES)]


def order_columns(lines: DataFrame) -> list[str]:
    """Columns that put lines in their order: ``row_id`` if ingest gave one, else the values.

    A total order over distinct lines needs no numbering, so nothing has to be
    sorted globally to give lines an identity.
    """
    return ["row_id"] if "row_id" in lines.columns else VALUE_ORDER


def line_key(lines: DataFrame) -> Column:
    """Comparable struct: first the order columns, then the rest of the line."""
    first = order_columns(lines)
    rest = [c for c in lines.columns if c not in first]
    return F.struct(*first, *rest)
