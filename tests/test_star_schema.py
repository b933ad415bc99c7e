"""Invoice lines from hand-made star-schema tables."""

import re
from datetime import date
from decimal import Decimal

import pytest

from tillroll.operators.lines import drop_without_customer
from tillroll.plans.segments import clean_lines
from tillroll.sources import invoices
from tillroll.sources.invoices import from_star_schema

ORDERS = [(1, 7), (2, 8), (3, None), (4, 7), (5, 99), (6, 7), (6, 8), (None, 7)]
LINES = [(1, 1, 2, 7, "R", "F"), (1, 1, 3, 7, "N", "O"), (2, 2, 2, 1, "R", "O"), (3, 1, 2, 1, "N", "O"), (4, 3, 2, 7, "R", "F"), (5, 1, 2, 1, "N", "O"),
         (6, 2, 4, 7, None, "F"), (6, 2, 4, 7, None, "F"), (None, 1, 2, 1, "R", "F"), (2, None, 2, 1, "N", "O"), (2, 3, None, 7, "R", "F")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("star"))

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")

    write("orders", ORDERS, "o_orderkey long, o_custkey long")
    write("customer", [(7, 1), (8, 2)], "c_custkey long, c_nationkey int")
    write("nation", [(1, "PERU"), (2, "CHINA")], "n_nationkey int, n_name string")
    write("part", [(1, "red", "MUG", 1, 10.5), (2, "blue", None, 2, 1.25), (3, "tin", "BOX", 9, 3.0)],
          "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")
    write("lineitem", [(o, p, s, n, Decimal(4), flag, status, date(2000, 1, 2)) for o, p, s, n, flag, status in LINES],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity decimal(12,2), l_returnflag string, l_linestatus string, l_shipdate date")
    return top


def found(df):
    return sorted((r.InvoiceNo, r.StockCode, str(r.Description), r.Quantity, str(r.CustomerID), r.Country) for r in df.collect())


def test_lines_of_the_star_schema(spark, folder):
    assert found(from_star_schema(spark, folder)) == sorted([
        ("C1", "D00001", "RED MUG", -4, "7", "PERU"), ("C1", "D00001", "RED MUG", -4, "7", "PERU"), ("1", "D00001", "RED MUG", 4, "7", "PERU"),
        ("2", "00002", "Discount", 4, "8", "CHINA"), ("C4", "00003", "TIN BOX", -4, "None", "PERU"), ("C4", "00003", "TIN BOX", -4, "None", "PERU"),
        ("C2", "00003", "TIN BOX", -4, "8", "CHINA"),
        *[("6", "00002", "Discount", 4, c, n) for c, n in (("7", "PERU"), ("8", "CHINA")) for _ in range(4)]])


def test_lines_with_customer_are_filtered_before_the_joins(spark, folder):
    early = from_star_schema(spark, folder, with_customer=True)
    assert found(early) == found(drop_without_customer(from_star_schema(spark, folder)))


def test_whole_lines_are_not_shuffled_to_clean_them(spark, folder):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clean_lines(from_star_schema(spark, folder))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "Description" in k]
    # lines travel to their products and to their orders, and nowhere else
    assert sum("l_partkey" in k for k in keys) == 1 and sum("InvoiceNo" in k for k in keys) == 2


def test_parts_of_cleaning_follow_the_lines(spark, folder, monkeypatch):
    want = found(clean_lines(from_star_schema(spark, folder)))
    monkeypatch.setattr(invoices, "LINES_PER_TASK", 1)
    lines = clean_lines(from_star_schema(spark, folder))
    assert found(lines) == want
    # 11 lines, 4 shuffle partitions in this session
    assert "InvoiceNo" in "".join(re.findall(r"hashpartitioning\((\S+), 11\)", lines._jdf.queryExecution().executedPlan().toString()))
