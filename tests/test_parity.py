"""Every query with a statement against DuckDB, every other one by its rows."""

import pytest

import __spark_entry__ as driver
from parity.check import connect, difference
from parity.queries import registered
from parity.sql import STATEMENTS
from parity.tables import tables

QUERIES = registered()


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, small, db, name):
    assert difference(QUERIES[name](spark, small), db, STATEMENTS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATEMENTS) - {"later_period"}))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(STATEMENTS) <= set(driver.oracle_sql())


def test_later_period(spark, small):
    found = QUERIES["later_period"](spark, small)
    assert found.count() > 0 and set(found.columns) == {"CustomerID", "label", "segment", "prediction"}


def test_metrics_reconcile_with_the_lines(spark, small):
    """Metrics go over baskets, the other side over lines."""
    t = tables(spark, small)
    from tillroll.operators.metrics import line_reconciliation
    joined = line_reconciliation(t.cleaned).join(t.metrics, "CustomerID", "full")
    assert joined.where("NOT (invoices <=> Frequency AND spend <=> MonetaryValue)").count() == 0


def test_entry(spark):
    assert {"RFML_Level", "Count"} <= set(driver.entry(spark).columns)
