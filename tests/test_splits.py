"""Exact splits and trees against plain searches."""

import math
import random

import pytest
from pyspark.ml.linalg import Vectors

from tillroll.operators.classify import load_model, save_model
from tillroll.operators.splits import best_splits, fit_exact_tree


def value(labels, impurity):
    n = len(labels)
    shares = [labels.count(c) / n for c in set(labels)]
    return 1 - sum(p * p for p in shares) if impurity == "gini" else -sum(p * math.log2(p) for p in shares)


def plain(rows, j, impurity):
    """(impurity, threshold) of the best split of one feature."""
    values, found = sorted({x[j] for x, _ in rows}), []
    for a, b in zip(values, values[1:]):
        left, right = [c for x, c in rows if x[j] <= a], [c for x, c in rows if x[j] > a]
        found.append(((len(left) * value(left, impurity) + len(right) * value(right, impurity)) / len(rows), a / 2 + b / 2))
    least = min((s for s, _ in found), default=None)
    return next(((s, t) for s, t in found if s <= least + 1e-12), None)


def grow(rows, impurity):
    if len({c for _, c in rows}) > 1:
        found = [(s[0], j, s[1]) for j in range(len(rows[0][0])) if (s := plain(rows, j, impurity))]
        if found and value([c for _, c in rows], impurity) - min(found)[0] > 1e-12:
            least = min(found)[0]
            _, j, t = next(f for f in found if f[0] <= least + 1e-12)
            return j, t, grow([r for r in rows if r[0][j] <= t], impurity), grow([r for r in rows if r[0][j] > t], impurity)
    labels = [c for _, c in rows]
    return min(set(labels), key=lambda c: (-labels.count(c), c))


def follow(tree, x):
    while isinstance(tree, tuple):
        j, t, low, high = tree
        tree = low if x[j] <= t else high
    return tree


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = (rng.gauss(0, 1), float(rng.randint(0, 4)), rng.random() * 1e-6, 3.0)
        rows.append((x, int(x[0] + 0.4 * x[1] + rng.gauss(0, 0.3) > 0.8) + int(x[2] > 7e-7)))
    return rows


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_best_splits_equal_a_plain_search(spark, impurity):
    rows = made(700, 1)
    table = spark.createDataFrame([(i % 2, list(x), c) for i, (x, c) in enumerate(rows)], "node int, x array<double>, label int").repartition(5)
    got = {(r.node, r.feature): r for r in best_splits(table, [0, 1, 2], impurity).collect()}
    assert set(got) == {(g, j) for g in (0, 1) for j in (0, 1, 2)}  # the last feature has one value
    for (g, j), r in got.items():
        own = rows[g::2]
        score, threshold = plain(own, j, impurity)
        assert r.impurity == pytest.approx(score, abs=1e-12) and r.threshold == threshold
        assert r.n == len(own) and r.n_left == sum(x[j] <= threshold for x, _ in own)


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_tree_equals_a_plain_tree(spark, impurity):
    rows = made(150, 2)
    train = spark.createDataFrame([(Vectors.dense(x), float(c)) for x, c in rows], ["features", "label"])
    fitted = fit_exact_tree(train, impurity)
    want = grow(rows, impurity)
    other = [x for x, _ in made(300, 3)]
    got = fitted.transform(spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(other)], ["i", "features"])).collect()
    assert all(r.prediction == follow(want, other[r.i]) for r in got)
    again = fitted.transform(train).collect()
    assert all(r.prediction == r.label for r in again)  # grown to the end


def test_edge_cases(spark, tmp_path):
    shape = "node int, x array<double>, label int"
    assert best_splits(spark.createDataFrame([], shape), [0, 1]).count() == 0
    rows = [(0, [float("nan"), 1.0], 0), (0, [1.0, None], 1), (0, [2.0, 2.0], None), (0, [1.0, 2.0], 1), (0, [1e308, 1.0], 0)]
    got = {r.feature: (r.threshold, r.impurity, r.n) for r in best_splits(spark.createDataFrame(rows, shape), [0, 1]).collect()}
    assert got[0] == (5e307 + 0.5, 0.0, 3) and got[1] == (1.5, 0.0, 3)
    one = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)] * 3, ["features", "label"])
    tree = fit_exact_tree(one)
    assert tree.depth == 0 and {r.prediction for r in tree.transform(one).collect()} == {1.0}
    near = spark.createDataFrame([(0, [1.0, 1.0], 0), (0, [1.0000000000000002, float("inf")], 1)], shape)
    for r in best_splits(near, [0, 1]).collect():  # the right value stays on the right
        assert r.threshold == 1.0 and r.n_left == 1
    two = spark.createDataFrame([(Vectors.dense([float(i)]), float(i > 4)) for i in range(9)], ["features", "label"])
    save_model(spark, fit_exact_tree(two), str(tmp_path))
    assert all(r.prediction == r.label for r in load_model(spark, str(tmp_path)).transform(two).collect())


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
def test_small_nodes_are_grown_in_one_job(spark, impurity):
    rows = [*made(200, 5), ((float("nan"), 1.0, 0.0, float("inf")), 2), ((math.inf, -math.inf, 0.0, 3.0), 1)]
    train = spark.createDataFrame([(Vectors.dense(x), float(c)) for x, c in rows], ["features", "label"])
    other = spark.createDataFrame([(i, Vectors.dense(x)) for i, (x, _) in enumerate([*made(300, 6), *rows])], ["i", "features"])

    def placed(**kept):
        fitted = fit_exact_tree(train, impurity, **kept)
        return fitted.depth, sorted(zip(fitted.feature, fitted.threshold)), {r.i: r.prediction for r in fitted.transform(other).collect()}

    levels = placed(most_values=0)  # all nodes are split by passes over the table
    assert placed() == levels and placed(most_values=300) == levels
    assert placed(depth=2) == placed(depth=2, most_values=0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tree", "jobs of one fit")
    fit_exact_tree(train, impurity)
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("tree")) < 30
