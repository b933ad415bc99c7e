import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from tillroll.operators import order_stats, outlier, score


@pytest.fixture(params=[order_stats.CELLS, 8])
def few_rows(request, monkeypatch):
    """One round or many."""
    monkeypatch.setattr(order_stats, "CELLS", request.param)


@pytest.mark.parametrize("kind", ["int", "float", "decimal", "hot", "wide"])
def test_quantiles_equal_pandas(spark, few_rows, kind):
    rng = random.Random(kind)
    make = {"int": lambda: rng.randrange(50), "float": lambda: rng.lognormvariate(0, 6),
            "decimal": lambda: Decimal(rng.randrange(10**6)).scaleb(-2),
            "wide": lambda: rng.randrange(-2**63, 2**63),
            "hot": lambda: 7 if rng.random() < 0.4 else rng.randrange(1, 10**9)}[kind]
    values = [make() for _ in range(203)] + [None]
    sql = {"float": "double", "decimal": "decimal(12,2)"}.get(kind, "bigint")
    df = spark.createDataFrame([(v,) for v in values], f"x {sql}")
    probabilities = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    want = pd.Series([float(v) for v in values if v is not None]).quantile(probabilities)
    assert np.allclose(order_stats.quantiles(df, "x", probabilities)[0], want, rtol=1e-12)


@pytest.mark.parametrize("values", [
    [float("inf"), *range(50)], [float("-inf"), float("inf"), 0.0, 1.0, 2.0], [1.7e308, -1.7e308, 0.0, 5.0, 1e-300, -1e-300],
    [5e-324 * i for i in range(300)], [10.0**e for e in range(-320, 308, 3)], [-(10.0**e) for e in range(-320, 308, 3)],
    [1.0 + 2.0**-52 * i for i in range(40)], [float("nan"), 1.0, 2.0], [float("inf")] * 5])
def test_any_doubles_end(spark, values):
    """Infinities, the whole range, denormals, neighbours: ranks are exact and the rounds few."""
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = sorted(v for v in values if v == v)
    rounds = []
    count = order_stats._count_cells
    order_stats._count_cells = lambda *a: rounds.append(1) or count(*a)
    try:
        got = order_stats.order_statistics(df, "x", lambda _, n: list(range(n)) if n < 20 else [0, 1, n // 4, n // 2, n - 2, n - 1])[0]
    finally:
        order_stats._count_cells = count
    assert {k: v for k, (v, _) in got.items()} == {k: kept[k] for k in got}
    assert all(below == sum(v < value for v in kept) for value, below in got.values())
    assert len(rounds) <= 7


def test_more_rows_than_one_switch_used_to_take(spark):
    df = spark.range(150_000).selectExpr("if(id = 7, double('infinity'), double(id % 1000)) as x").persist()
    assert order_stats.quantiles(df, "x", [0.25, 0.5, 1])[0][:2] == pytest.approx([249.75, 500], abs=1)
    assert order_stats.quantiles(df, "x", [1])[0] == [float("inf")]
    df.unpersist()


def test_passes_of_one_window(spark, monkeypatch):
    """Outliers and scores of a window read its customers twelve times at most, but for the chained filters."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(400), rng.randrange(1, 17), Decimal(rng.randrange(10**6)).scaleb(-2), rng.randrange(300)) for i in range(900)]
    df = spark.createDataFrame(rows, "CustomerID bigint, Recency bigint, Frequency bigint, MonetaryValue decimal(12,2), Lenght bigint").persist()
    passes = []
    for name in ("_count_cells", "_extents"):
        plain = getattr(order_stats, name)
        monkeypatch.setattr(order_stats, name, lambda *a, f=plain: passes.append(1) or f(*a))
    score.fit_rules(df)
    assert len(passes) <= 12
    df.unpersist()


def test_quantiles_per_group(spark, few_rows):
    rows = [(g, random.Random(g + str(i)).random() * 10 ** (i % 9)) for g in "abc" for i in range(57)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = order_stats.quantiles(df, "x", [0.25, 0.5], "g")
    want = pd.DataFrame(rows, columns=["g", "x"]).groupby("g").x.quantile([0.25, 0.5])
    for g in "abc":
        assert np.allclose(got[g], want[g])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 10, 41])
def test_rank_quartile_equals_pandas(spark, few_rows, n):
    rng = random.Random(n)
    ids = rng.sample(range(10**12), n)
    rows = sorted((i, rng.randrange(3)) for i in ids)
    df = spark.createDataFrame([*rows, (-1, None)], "CustomerID bigint, v bigint")
    got = {r.CustomerID: r.q for r in df.select("CustomerID", score.quartile_by_rank(df, "v").alias("q")).collect()}
    assert got.pop(-1) is None
    if n > 1:
        ranks = pd.Series([v for _, v in rows]).rank(method="first")
        want = pd.qcut(ranks, 4, labels=[1, 2, 3, 4])
        assert [got[i] for i, _ in rows] == list(want)
    else:
        assert list(got.values()) == [1]


def test_six_rows_give_bucket_sizes_2_1_1_2(spark):
    df = spark.createDataFrame([(i, i) for i in range(6)], "CustomerID bigint, v bigint")
    counts = df.groupBy(score.quartile_by_rank(df, "v").alias("q")).count().orderBy("q").collect()
    assert [r["count"] for r in counts] == [2, 1, 1, 2]


def test_value_quartile_and_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 6, 7, 9]], "v int")
    got = [r[0] for r in df.orderBy("v").select(score.quartile_by_value(df, "v", score.DESCENDING)).collect()]
    assert got == list(pd.qcut(pd.Series([1, 2, 3, 4, 5, 6, 7, 9]), 4, labels=[4, 3, 2, 1]))
    tied = spark.createDataFrame([(1,)] * 6 + [(2,), (3,)], "v int")
    with pytest.raises(ValueError):
        score.quartile_by_value(tied, "v", score.ASCENDING)
    dropped = score.quartile_by_value(tied, "v", score.ASCENDING, on_ties="drop")
    assert {r[0]: r[1] for r in tied.select("v", dropped).distinct().collect()} == {1: 1, 2: 2, 3: 2}


def test_iqr_bounds_are_inclusive_and_chained(spark, few_rows):
    values = [0.0, 1.0, 2.0, 3.0, 4.0]
    q1, q3 = np.quantile([*values, 8.0], [0.25, 0.75])
    df = spark.createDataFrame([(v, 1) for v in values] + [(8.0, 1)], "v double, w int")
    reach = (8.0 - q3) / (q3 - q1)
    assert outlier.remove_outliers_iqr(df, factor=reach).count() == 6
    assert outlier.remove_outliers_iqr(df, factor=reach * 0.999).count() == 5

    rng = random.Random(5)
    rows = [(rng.gauss(0, 1) ** 3, rng.gauss(0, 1) ** 3, "t") for _ in range(300)]
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    for c in "ab":
        low, high = pdf[c].quantile([0.25, 0.75])
        pdf = pdf[(pdf[c] >= low - 2 * (high - low)) & (pdf[c] <= high + 2 * (high - low))]
    got = outlier.remove_outliers_iqr(spark.createDataFrame(rows, "a double, b double, c string"))
    assert sorted(got.toPandas().a) == sorted(pdf.a)


def test_histogram_keeps_the_largest_value_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    got = {r.bin: r.n for r in outlier.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    gap = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert {r.bin: r.n for r in outlier.histogram(gap, "v", 5).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1}
