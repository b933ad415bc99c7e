"""Exact best splits of numeric features, and decision trees grown from them level by level.

Every gap between two neighbouring values of a feature is tried, for all nodes and features in one pass. Equal values are counted first;
the counted values are dealt by range, so each part holds a bounded run of them, and running class counts are those inside the part plus
the totals of the parts before it. No task needs all values of a feature, however many there are, and hot values are one row each.
Nodes of at most ``MOST_VALUES`` numbers are grown to their end in one task each, all in one job.
"""

from __future__ import annotations

import json
import sys
from dataclasses import asdict, dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillroll.functions.vectors import MOST_VALUES
from tillroll.session import materialize

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Depth of trees; the original has no limit.
DEPTH = 30
LEAST_GAIN = 1e-12


def impurity_sum(counts: list[Column], impurity: str) -> Column:
    """Number of rows times their Gini impurity or entropy (in bits), from the number of rows of each class."""
    n = sum(counts[1:], counts[0])
    if impurity == "gini":
        return F.when(n > 0, n - sum((c * c for c in counts[1:]), counts[0] * counts[0]) / n).otherwise(0.0)
    if impurity == "entropy":
        return sum((F.when(c > 0, -c * F.log2(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))
    raise ValueError(f"impurity is gini or entropy, not {impurity}")


def best_splits(table: DataFrame, classes: list[int], impurity: str = "gini") -> DataFrame:
    """For rows (node, x, label), x an array of numbers: the best split of each node and feature, as rows
    (node, feature, threshold, impurity, n_left, n).

    The impurity is the mean over the rows after the split; the threshold lies halfway between two neighbouring values, rows up to it go left.
    Of splits equal to 12 digits that with the least threshold is taken; features with one value in a node have none. Null and NaN values, and
    rows without a label, are not counted.
    """
    names = [f"c{i}" for i in range(len(classes))]
    each = table.where(F.col("label").isNotNull()).select("node", "label", F.posexplode("x").alias("feature", "value"))
    counted = each.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("node", "feature", "value").agg(
        *[F.count(F.when(F.col("label") == c, 1)).cast("double").alias(name) for name, c in zip(names, classes)])
    dealt = materialize(counted.repartitionByRange("node", "feature", "value").withColumn("part", F.spark_partition_id()), "split-values")
    # one row per node, feature and part: few, and dealt by node and feature
    own = Window.partitionBy("node", "feature")
    parts = dealt.groupBy("node", "feature", "part").agg(F.min("value").alias("first"), *[F.sum(c).alias(f"part_{c}") for c in names])
    parts = parts.select("node", "feature", "part", F.lead("first").over(own.orderBy("part")).alias("follows"),
                         *[(F.sum(f"part_{c}").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"part_{c}")).alias(f"before_{c}") for c in names],
                         *[F.sum(f"part_{c}").over(own).alias(f"all_{c}") for c in names])
    inside = Window.partitionBy("node", "feature", "part").orderBy("value")
    running = dealt.join(parts, ["node", "feature", "part"]).select(
        "node", "feature", "value", F.coalesce(F.lead("value").over(inside), "follows").alias("above"),
        *[(F.col(f"before_{c}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias(f"left_{c}") for c in names],
        *[f"all_{c}" for c in names])
    left, right = [F.col(f"left_{c}") for c in names], [F.col(f"all_{c}") - F.col(f"left_{c}") for c in names]
    n_left, n = sum(left[1:], left[0]), sum((F.col(f"all_{c}") for c in names[1:]), F.col(f"all_{names[0]}"))
    # neighbouring doubles and infinities have none; the value itself separates them
    middle = F.col("value") / 2 + F.col("above") / 2
    tried = running.where(F.col("above").isNotNull()).select(
        "node", "feature", F.round((impurity_sum(left, impurity) + impurity_sum(right, impurity)) / n, 12).alias("impurity"),
        F.when(middle < F.col("above"), middle).otherwise(F.col("value")).alias("threshold"),
        n_left.cast("long").alias("n_left"), n.cast("long").alias("n"))
    found = tried.groupBy("node", "feature").agg(F.min(F.struct("impurity", "threshold", "n_left", "n")).alias("b"))
    return found.select("node", "feature", "b.threshold", "b.impurity", "b.n_left", "b.n")


def _constant(values: list, kind: str) -> Column:
    """Numbers as one constant array, whatever their number; they come as a text that Spark reads once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class ExactTree:
    """A tree in arrays: the feature (-1 for a leaf), threshold, left child (the right one follows it) and label of each node."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    label: list[int]
    depth: int

    def _place(self, x: Column) -> Column:
        feature, threshold, left = _constant(self.feature, "int"), _constant(self.threshold, "double"), _constant(self.left, "int")
        step = lambda node, _: F.when(F.get(feature, node) < 0, node).otherwise(
            F.get(left, node) + F.when(F.get(x, F.get(feature, node)) <= F.get(threshold, node), 0).otherwise(1))
        return F.aggregate(F.array(*[F.lit(0)] * max(self.depth, 1)), F.lit(0), step)

    def transform(self, table: DataFrame) -> DataFrame:
        """``table`` with the column prediction; null and NaN go right."""
        return table.withColumn("prediction", F.get(_constant(self.label, "double"), self._place(vector_to_array("features"))))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ExactTree":
        return ExactTree(**json.loads(spark.read.option("wholetext", True).text(path).first().value))


def _sums(counts: np.ndarray, impurity: str) -> np.ndarray:
    """:func:`impurity_sum` of rows of counts."""
    n = counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if impurity == "gini":
            return np.where(n > 0, n - (counts * counts).sum(1) / n, 0.0)
        return np.where(counts > 0, -counts * np.log2(counts / n[:, None]), 0.0).sum(1)


def _best_of(x: np.ndarray, ranks: np.ndarray, classes: int, impurity: str) -> tuple[float, int, float] | None:
    """(impurity, feature, threshold) of the best split of rows, by the rules of :func:`best_splits`."""
    found = []
    for j in range(x.shape[1]):
        present = ~np.isnan(x[:, j])
        values, label = x[present, j], ranks[present]
        order = np.argsort(values, kind="stable")
        values, label = values[order], label[order]
        ends = np.flatnonzero(values[1:] != values[:-1])
        if not len(ends):
            continue
        counts = np.cumsum(np.eye(classes)[label], axis=0)
        left, whole = counts[ends], counts[-1]
        score = np.round((_sums(left, impurity) + _sums(whole - left, impurity)) / len(values), 12)
        k = int(score.argmin())  # the first is that of the least threshold
        low, above = float(values[ends[k]]), float(values[ends[k] + 1])
        middle = low / 2 + above / 2
        found.append((float(score[k]), j, middle if middle < above else low))
    return min(found, default=None)


def _grown(x: np.ndarray, labels: np.ndarray, classes: list[int], impurity: str, depth: int, least_rows: int) -> ExactTree:
    """The tree of rows that one task holds, level by level."""
    ranks = np.searchsorted(classes, labels)
    tree, level = ExactTree([-1], [0.0], [-1], [classes[0]], 0), 0
    open_nodes = [(0, np.arange(len(x)))]
    while open_nodes:
        children = []
        for node, rows in open_nodes:
            counts = np.bincount(ranks[rows], minlength=len(classes))
            tree.label[node] = classes[int(counts.argmax())]
            if level == depth or len(rows) < least_rows or (counts > 0).sum() < 2:
                continue
            split = _best_of(x[rows], ranks[rows], len(classes), impurity)
            if split is None or _impurity({c: int(n) for c, n in enumerate(counts) if n}, impurity) - split[0] <= LEAST_GAIN:
                continue
            goes_left, child = x[rows, split[1]] <= split[2], len(tree.feature)
            tree.feature[node], tree.threshold[node], tree.left[node] = split[1], split[2], child
            for column, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.label, tree.label[node])):
                column.extend([value, value])
            children += [(child, rows[goes_left]), (child + 1, rows[~goes_left])]
        open_nodes, level = [c for c in children if len(c[1])], level + bool(children)
    return ExactTree(tree.feature, tree.threshold, tree.left, tree.label, level)


def _subtrees(rows: DataFrame, levels: dict[int, int], classes: list[int], impurity: str, depth: int, least_rows: int) -> dict[int, ExactTree]:
    """The trees below nodes of rows (node, x, label), each grown in one task."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        values = table.column("x").combine_chunks()
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
        grown = _grown(x, table.column("label").to_numpy(), classes, impurity, depth - levels[node], least_rows)
        return pa.table({"node": pa.array([node], pa.int32()), "tree": pa.array([json.dumps(asdict(grown))])})

    found = rows.groupBy("node").applyInArrow(run, "node int, tree string")
    return {r.node: ExactTree(**json.loads(r.tree)) for r in found.collect()}


def _spliced(tree: ExactTree, level: int, node: int, below: ExactTree) -> ExactTree:
    """``tree`` with another in place of a leaf on the given level."""
    shift = len(tree.feature) - 1
    moved = [shift + child if child >= 0 else -1 for child in below.left]
    for own, more in ((tree.feature, below.feature), (tree.threshold, below.threshold), (tree.left, moved), (tree.label, below.label)):
        own[node] = more[0]
        own.extend(more[1:])
    return ExactTree(tree.feature, tree.threshold, tree.left, tree.label, max(tree.depth, level + below.depth))


def fit_exact_tree(train: DataFrame, impurity: str = "gini", depth: int = DEPTH, least_rows: int = 2, most_values: int = MOST_VALUES) -> ExactTree:
    """A tree whose splits are the best of all thresholds.

    Nodes of more than ``most_values`` numbers are split in one pass over the rows per level; smaller ones are grown to their end in one
    task each, together. Nodes of one class, of fewer than ``least_rows`` rows or that no split improves are leaves. Of equal features the
    first is taken, of equally frequent classes the least. What reaches the driver is the tree itself.
    """
    rows = materialize(train.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")), "tree-rows")
    classes = sorted(r.label for r in rows.select("label").distinct().where("label IS NOT NULL").collect())
    if not classes:
        raise ValueError("no labelled rows")
    width = rows.select(F.max(F.size("x")).alias("n")).first().n
    tree = ExactTree([-1], [0.0], [-1], [classes[0]], 0)
    fresh, level, small = {0}, 0, {}
    while fresh:
        placed = rows.withColumn("node", tree._place(F.col("x"))).where(F.col("node").isin(*fresh))
        counts: dict[int, dict[int, int]] = {}
        for r in placed.groupBy("node", "label").count().collect():
            counts.setdefault(r.node, {})[r.label] = r["count"]
        for node, of in counts.items():
            tree.label[node] = min(of, key=lambda c: (-of[c], c))
        open_nodes = [n for n, of in counts.items() if len(of) > 1 and sum(of.values()) >= least_rows]
        fresh = set()
        if not open_nodes or level == depth:
            break
        held = [n for n in open_nodes if sum(counts[n].values()) * width <= most_values and None not in counts[n]]
        small |= {n: level for n in held}
        open_nodes = [n for n in open_nodes if n not in small]
        if not open_nodes:
            break
        found = best_splits(placed.where(F.col("node").isin(*open_nodes)), classes, impurity)
        best = found.groupBy("node").agg(F.min(F.struct("impurity", "feature", "threshold")).alias("b")).select("node", "b.*")
        for r in best.orderBy("node").collect():
            if _impurity(counts[r.node], impurity) - r.impurity <= LEAST_GAIN:
                continue
            child = len(tree.feature)
            tree.feature[r.node], tree.threshold[r.node], tree.left[r.node] = r.feature, float(r.threshold), child
            for column, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.label, tree.label[r.node])):
                column.extend([value, value])
            fresh |= {child, child + 1}
        level += 1
        tree = ExactTree(tree.feature, tree.threshold, tree.left, tree.label, level)
    if small:
        placed = rows.withColumn("node", tree._place(F.col("x"))).where(F.col("node").isin(*small))
        for node, below in sorted(_subtrees(placed, small, classes, impurity, depth, least_rows).items()):
            tree = _spliced(tree, small[node], node, below)
    return tree


def _impurity(counts: dict[int, int], impurity: str) -> float:
    n = sum(counts.values())
    shares = [c / n for c in counts.values()]
    return 1 - sum(p * p for p in shares) if impurity == "gini" else -sum(p * log2(p) for p in shares)
