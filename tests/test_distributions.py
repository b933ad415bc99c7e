"""Density curves, quantiles of many groups and sketches of days against plain versions."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import distinct
from tillroll.operators.density import density
from tillroll.operators.group_stats import group_quantiles
from tillroll.operators.outlier import box_stats

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def test_density_is_the_kernel_estimate(spark):
    rng = random.Random(2)
    x = [rng.gauss(0, 1) for _ in range(300)] + [rng.gauss(6, 2) for _ in range(100)]
    got = density(spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double"), "v").orderBy("point").collect()
    grid = np.array([r.x for r in got])
    h = np.std(x, ddof=1) * len(x) ** -0.2
    plain = np.exp(-0.5 * ((grid[:, None] - np.array(x)) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert len(got) == 256 and np.allclose([r.density for r in got], plain, atol=plain.max() * 2e-3)
    area = np.trapezoid([r.density for r in got], grid)
    assert area == pytest.approx(1, abs=0.002)


@pytest.mark.parametrize("rows", [[], [(1.0,)], [(2.0,)] * 5, [(None,)]])
def test_no_curve_without_two_values(spark, rows):
    assert density(spark.createDataFrame(rows, "v double"), "v").count() == 0


def test_quantiles_of_groups_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    groups = {None: rng.normal(0, 1, 400), "a": np.round(rng.normal(0, 3, 5000)), "b": np.exp(rng.normal(0, 20, 3000)) * rng.choice([-1, 1], 3000),
              "c": np.array([4.0]), "d": np.array([1.0, 2.0]), "e": np.array([-np.inf, 0.0, 5e-324, np.inf, 1e308, -1e-300]), "f": np.full(700, 3.5)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("gone", None), ("gone", float("nan"))]
    random.Random(1).shuffle(rows)
    found = {r.g: r for r in group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", PROBABILITIES, "g").collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        x = np.sort(values)
        want = []
        for p in PROBABILITIES:
            exact = p * (len(x) - 1)
            k = int(exact)
            a, b = x[k], x[min(k + 1, len(x) - 1)]
            want.append(a if exact == k or a == b else a + (b - a) * (exact - k))
        assert found[g].n == len(x) and np.allclose(found[g].quantiles, want, rtol=1e-12, atol=0, equal_nan=True), g


def test_a_million_groups(spark):
    """Quartiles of a million groups of three, nothing of which is named in the plan or brought to the driver."""
    rows = spark.range(3_000_000).select((F.col("id") % 1_000_000).alias("g"), ((F.col("id") * 7) % 3_000_017).cast("double").alias("v"))
    found = group_quantiles(rows, "v", [0.25, 0.5, 0.75], "g")
    plain = rows.groupBy(F.col("g").alias("h")).agg(F.expr("percentile(v, array(0.25, 0.5, 0.75))").alias("want"))
    met = found.join(plain, F.col("g") == F.col("h"))
    bad = F.exists(F.zip_with("quantiles", "want", lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    row = met.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).alias("bad")).first()
    assert (row.n, row.bad) == (1_000_000, 0)


def test_boxes_of_groups_and_of_the_whole(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("a", 100.0), (None, 1.0), ("b", None)], "g string, v double")
    found = {r.box: r for r in box_stats(df, "v", "g").collect()}
    assert set(found) == {"a", None}
    assert (found["a"].median, found["a"].whisker_low, found["a"].whisker_high, found["a"].n) == (5.5, 0.0, 10.0, 12)
    whole = box_stats(df, "v").collect()
    assert [(r.box, r.n) for r in whole] == [("all", 13)]


def test_sketches_of_days_merge_to_that_of_the_whole(spark):
    rng = random.Random(4)
    rows = [(str(rng.randrange(30_000)), str(rng.randrange(800)), rng.randrange(9_000) if rng.random() < 0.8 else None,
             datetime(2011, 1, 1 + rng.randrange(28), rng.randrange(24))) for _ in range(40_000)]
    lines = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, CustomerID long, InvoiceDate timestamp_ntz")
    days = distinct.daily_sketches(lines).persist()
    assert days.count() == 28
    for first, last in ((None, None), ("2011-01-05", "2011-01-11"), ("2011-02-01", None)):
        kept = [r for r in rows if (first is None or f"{r[3]:%Y-%m-%d}" >= first) and (last is None or f"{r[3]:%Y-%m-%d}" <= last)]
        got = distinct.period_totals(days, first, last).first()
        assert got.n_lines == len(kept)
        for name, place in (("transactions", 0), ("products", 1), ("customers", 2)):
            exact = len({r[place] for r in kept} - {None})
            assert abs(got[name] - exact) <= 4 * 1.04 / 2 ** 7 * exact + 1
        # merged sketches count as one sketch of the lines
        if kept:
            part = spark.createDataFrame(kept, lines.schema)
            one = part.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), distinct.SIZE)).alias(n) for n, c in distinct.TOTALS.items()]).first()
            assert all(abs(one[n] - got[n]) <= 0.01 * got[n] + 1 for n in distinct.TOTALS)
