"""Readers that give the invoice-line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillroll.functions.time import parse_timestamp
from tillroll.schema import INVOICE_LINES, LINE_COLUMNS

CSV_DATE = "M/d/yyyy H:mm"
#: Lines that one task of cleaning holds, sorted and grouped: some 300 MB.
LINES_PER_TASK = 500_000


def _text_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The file as text, columns found by the names in its header."""
    lines = spark.read.option("header", True).option("encoding", encoding).option("escape", '"').option("inferSchema", False).csv(path)
    missing = [c for c in LINE_COLUMNS if c not in lines.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return lines


def _parsed(field: T.StructField, date_format: str) -> Column:
    """The value of a text, null if it does not parse. Whole numbers may be written with a zero fraction, as 5.0."""
    text = F.trim(F.col(f"`{field.name}`"))
    if isinstance(field.dataType, T.TimestampNTZType):
        return parse_timestamp(text, date_format, lenient=True)
    if isinstance(field.dataType, T.IntegralType):
        number = text.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number).try_cast(field.dataType)
    if isinstance(field.dataType, T.StringType):
        return F.col(f"`{field.name}`")
    return text.try_cast(field.dataType)


def _checked(lines: DataFrame, date_format: str) -> tuple[DataFrame, Column]:
    """Parsed columns under p_ names, and the names of the columns that did not parse."""
    parsed = lines.withColumns({f"p_{f.name}": _parsed(f, date_format) for f in INVOICE_LINES})
    bad = F.array_compact(F.array(*[F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"p_{f.name}").isNull(), F.lit(f.name))
                                    for f in INVOICE_LINES]))
    return parsed, bad


def read_csv(spark: SparkSession, path: str, date_format: str = CSV_DATE,
             encoding: str = "ISO-8859-1", row_id: bool = False, lenient: bool = False) -> DataFrame:
    """Invoice lines from CSV with a header, whatever the order of its columns.

    A value that does not parse is an error. With ``lenient`` its row is left out here and is a row of :func:`csv_rejects`.
    ``row_id`` adds a sortable file position (file, block, row in block), which keeps
    the order of the file without a global sort.
    """
    lines, bad = _checked(_text_lines(spark, path, encoding), date_format)
    position = F.struct(F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"))
    lines = lines.select(*[F.col(f"p_{c}").alias(c) for c in LINE_COLUMNS], bad.alias("bad"), *([position.alias("row_id")] if row_id else []))
    if lenient:
        return lines.where(F.size("bad") == 0).drop("bad")
    complaint = F.raise_error(F.concat(F.lit("values that do not parse in "), F.concat_ws(", ", "bad")))
    first = LINE_COLUMNS[0]
    checked = F.when(F.size("bad") == 0, F.col(first)).otherwise(complaint.cast("string"))
    # a filter, unlike a column, is not left out when a query needs few columns
    return lines.where((F.size("bad") == 0) | checked.isNotNull()).drop("bad")


def csv_rejects(spark: SparkSession, path: str, date_format: str = CSV_DATE, encoding: str = "ISO-8859-1") -> DataFrame:
    """Rows that :func:`read_csv` leaves out when lenient, as text, with the names of what did not parse (``rejected``)."""
    lines, bad = _checked(_text_lines(spark, path, encoding), date_format)
    return lines.withColumn("rejected", bad).where(F.size("rejected") > 0).select(*LINE_COLUMNS, "rejected")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Invoice lines from Parquet, cast to the fixed schema. Times with a zone are taken in UTC, whatever the session's zone."""
    table = spark.read.parquet(path)

    def typed(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(table.schema[field.name].dataType, T.TimestampType):
            value = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
        return value.cast(field.dataType).alias(field.name)

    return table.select(*[typed(f) for f in INVOICE_LINES])


def spread(table: DataFrame) -> DataFrame:
    """Rows dealt out to all cores if the scan has fewer splits than there are cores.

    A small file with one row group is one task, and so would be everything that Spark
    fuses with its scan. Large tables have splits enough and stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def dealt(lines: DataFrame, invoices: DataFrame, n_lines: int) -> tuple[DataFrame, DataFrame]:
    """Both by invoice in as many parts as so many lines need, where the session's number of shuffle partitions is too small for them."""
    parts = -(-n_lines // LINES_PER_TASK)
    if parts <= int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return lines, invoices
    return lines.repartition(parts, "InvoiceNo"), invoices.repartition(parts, "InvoiceNo")


def from_star_schema(spark: SparkSession, folder: str, with_customer: bool = False) -> DataFrame:
    """Invoice lines derived from lineitem, orders, part, customer and nation.

    Some lines come twice on purpose (line 7 of an even supplier), so that duplicate
    handling has work to do. ``with_customer`` leaves out, before the joins, lines whose order names no customer.
    """
    def named(order: str) -> Column:
        return F.col(order) % 4 != 0

    def table(name: str, order: str | None = None) -> DataFrame:
        found = spark.read.parquet(f"{folder}/{name}.parquet")
        return found.where(named(order)) if order and with_customer else found

    # under the invoice's number the order meets its lines last, so grouping whole lines needs no other shuffle
    invoices = (
        table("orders", "o_orderkey").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.explode(F.array(F.lit("C"), F.lit(""))).alias("kind"), "o_orderkey", F.col("n_name").alias("Country"),
                F.when(named("o_orderkey"), F.col("o_custkey")).alias("CustomerID"))
        .select(F.concat("kind", F.col("o_orderkey").cast("string")).alias("InvoiceNo"), "CustomerID", "Country")
    )
    cancel = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    twice = (F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 2 == 0)
    retail_cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    price = F.floor((retail_cents * F.col("p_size") + 5000) / F.lit(10000))
    sold = table("lineitem", "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                  "l_returnflag", "l_linestatus", "l_shipdate")
    quantity = F.col("l_quantity")
    sold = spread(sold).select(
        F.concat(F.when(cancel, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("InvoiceNo"), "l_partkey",
        F.when(cancel, -quantity).otherwise(quantity).cast("int").alias("Quantity"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("InvoiceDate"), F.when(twice, 2).otherwise(1).alias("copies"))
    products = table("part").select(
        "p_partkey",
        F.concat(F.when(F.col("p_size") == 1, "D").otherwise(""),
                 F.lpad((F.col("p_partkey") % 64).cast("string"), 5, "0")).alias("StockCode"),
        F.when(F.col("p_size") == 2, "Discount")
        .otherwise(F.upper(F.concat("p_name", F.lit(" "), "p_type"))).alias("Description"),
        (price.cast("decimal(10,0)") / 100).cast("decimal(12,4)").alias("UnitPrice"))
    # the count comes from the footers of the files
    priced, invoices = dealt(sold.join(products, F.col("l_partkey") == F.col("p_partkey")), invoices, table("lineitem").count())
    lines = (priced.join(invoices, "InvoiceNo")
             .select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))
    return lines.select(*LINE_COLUMNS)
