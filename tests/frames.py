"""Hand-made invoice lines."""

from datetime import datetime, timedelta
from decimal import Decimal

from tillroll.schema import INVOICE_LINES

START = datetime(2011, 1, 1, 12)


def line(invoice="1", stock="A1", text="RED MUG", quantity=1, day=0.0, price="1.0", customer=1, country="UK"):
    return (invoice, stock, text, quantity, START + timedelta(days=day), Decimal(price), customer, country)


def frame(spark, rows):
    return spark.createDataFrame(rows, INVOICE_LINES)
