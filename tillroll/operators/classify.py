"""Classifiers that place customers in known clusters, and their comparison."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.vectors import matrix
from tillroll.operators.cluster import FITS_AT_ONCE, side_by_side
from tillroll.operators.evaluation import accuracy
from tillroll.operators.splits import ExactTree

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-3
Fitter = Callable[[DataFrame], object]


def fit_svm(train: DataFrame, c: float = 3.0) -> object:
    """Linear SVM, one class against the rest. The penalty C weighs the sum of losses, Spark's
    parameter the regulariser against the mean loss, hence 1 / (C n)."""
    svm = LinearSVC(regParam=1.0 / (c * train.count()), tol=TOLERANCE)
    return OneVsRest(classifier=svm, labelCol="label", parallelism=FITS_AT_ONCE).fit(train)


@dataclass(frozen=True)
class PairwiseSvm:
    """One linear SVM per pair of classes; the class with most votes wins, low ids on ties."""

    planes: list[tuple[int, int, list[float], float]]  # negative class, positive class, w, b

    def transform(self, table: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        classes = sorted({c for a, b, _, _ in self.planes for c in (a, b)})
        votes = {c: F.lit(0) for c in classes}
        for a, b, weights, intercept in self.planes:
            w = F.array(*[F.lit(v) for v in weights])
            side = F.aggregate(F.zip_with(x, w, lambda p, q: p * q), F.lit(intercept), lambda s, v: s + v)
            votes[a] = votes[a] + F.when(side <= 0, 1).otherwise(0)
            votes[b] = votes[b] + F.when(side > 0, 1).otherwise(0)
        return table.withColumn("prediction", _first_best(votes))

    def save(self, spark, path: str) -> None:
        _save_text(spark, path, {"planes": self.planes})

    @staticmethod
    def load(spark, path: str) -> "PairwiseSvm":
        return PairwiseSvm([(a, b, w, c) for a, b, w, c in _load_text(spark, path)["planes"]])


def _save_text(spark, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def _load_text(spark, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first().value)


def _first_best(totals: dict[int, Column]) -> Column:
    best = F.greatest(*totals.values()) if len(totals) > 1 else next(iter(totals.values()))
    rule = None
    for c, total in sorted(totals.items()):
        rule = (F.when if rule is None else rule.when)(total == best, F.lit(float(c)))
    return rule


def fit_pairwise_svm(train: DataFrame, c: float = 3.0) -> PairwiseSvm:
    classes = sorted(int(r.label) for r in train.select("label").distinct().collect())

    def plane(pair: tuple[int, int]) -> tuple[int, int, list[float], float]:
        a, b = pair
        rows = train.where(F.col("label").isin(a, b)).withColumn("side", (F.col("label") == b).cast("double"))
        model = LinearSVC(regParam=1.0 / (c * rows.count()), tol=TOLERANCE, labelCol="side").fit(rows)
        return a, b, [float(v) for v in model.coefficients], float(model.intercept)

    return PairwiseSvm(side_by_side(plane, list(combinations(classes, 2))))


@dataclass(frozen=True)
class Stump:
    feature: int
    threshold: float
    left: int
    right: int
    weight: float

    def says(self, x: Column) -> Column:
        return F.when(x[self.feature] <= self.threshold, self.left).otherwise(self.right)


@dataclass(frozen=True)
class BoostedStumps:
    classes: list[int]
    stumps: list[Stump]

    def transform(self, table: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        totals = {c: F.lit(0.0) for c in self.classes}
        for stump in self.stumps:
            said = stump.says(x)
            for c in self.classes:
                totals[c] = totals[c] + F.when(said == c, stump.weight).otherwise(0.0)
        return table.withColumn("prediction", _first_best(totals))

    def save(self, spark, path: str) -> None:
        _save_text(spark, path, {"classes": self.classes, "stumps": [asdict(s) for s in self.stumps]})

    @staticmethod
    def load(spark, path: str) -> "BoostedStumps":
        state = _load_text(spark, path)
        return BoostedStumps(state["classes"], [Stump(**s) for s in state["stumps"]])


def _best_stump(cells: list, edges: list[list[float]], classes: list[int]) -> tuple[Stump, float]:
    """The split with the least weighted error among the counted cells, and that error."""
    best, least = None, math.inf
    total = {c: sum(r.weight for r in cells if r.feature == 0 and r.label == c) for c in classes}
    for j, cuts in enumerate(edges):
        at = {(r.bin, r.label): r.weight for r in cells if r.feature == j}
        left = dict.fromkeys(classes, 0.0)
        for i, cut in enumerate(cuts):
            for c in classes:
                left[c] += at.get((i, c), 0.0)
            right = {c: total[c] - left[c] for c in classes}
            low, high = max(classes, key=left.get), max(classes, key=right.get)
            error = sum(total.values()) - left[low] - right[high]
            if error < least:
                best, least = Stump(j, cut, low, high, 0.0), error
    return best, least / sum(total.values())


@dataclass(frozen=True)
class Cell:
    """Weight of the rows of a class in a bin of a feature."""

    feature: int
    bin: int
    label: int
    weight: float


def _cell_weights(classes: list[int], sizes: list[int], stumps: list[tuple[int, int, int, int, float]]):
    """Per task: weights of all cells as one list, under the stumps (feature, last bin on the left, left, right, weight) so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(size * len(classes)) for size in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            label, bins = batch.column("label").to_numpy(), matrix(batch.column("bins"))
            weight = np.zeros(len(label))
            for feature, last, left, right, alpha in stumps:
                weight += np.where(np.where(bins[:, feature] <= last, left, right) != label, alpha, 0.0)
            weight, place = np.exp(weight), np.searchsorted(classes, label)
            for j, size in enumerate(sizes):
                sums[j] += np.bincount(bins[:, j] * len(classes) + place, weight, size * len(classes))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tolist()], pa.list_(pa.float64()))], ["sums"])

    return run


def _cells(table: DataFrame, classes: list[int], edges: list[list[float]], stumps: list[Stump]) -> list[Cell]:
    """All cells of rows (label, bins); each task sends one list of their weights."""
    sizes = [len(cuts) + 1 for cuts in edges]
    plain = [(s.feature, edges[s.feature].index(s.threshold), s.left, s.right, s.weight) for s in stumps]
    sums = [r.sums for r in table.mapInArrow(_cell_weights(classes, sizes, plain), "sums array<double>").collect()]
    places = ((j, i, c) for j, size in enumerate(sizes) for i in range(size) for c in classes)
    return [Cell(j, i, c, float(w)) for (j, i, c), w in zip(places, np.sum(sums, axis=0))]


def fit_adaboost(train: DataFrame, rounds: int = 50, bins: int | None = None) -> BoostedStumps:
    """Multi-class boosting (SAMME) of depth-1 trees.

    Features are binned once at approximate quantiles, as Spark's own trees do. A round is
    one pass without a shuffle: the weight per feature, bin and class, added up by numpy in
    the tasks. Row weights follow from the bins and the stumps so far, so nothing is stored
    from round to round.
    """
    bins = bins or BINS
    classes = sorted(int(r.label) for r in train.select("label").distinct().collect())
    table = train.select(F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
    size = table.select(F.size("x").alias("n")).first().n
    wide = table.select(*[F.col("x")[j].alias(f"x{j}") for j in range(size)])
    found = wide.approxQuantile(wide.columns, [i / bins for i in range(1, bins)], 1 / (8 * bins))
    edges = [sorted(set(q)) for q in found]

    def bin_of(j: int) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in edges[j]]), lambda v: v < F.col("x")[j]))

    table = table.select("label", F.array(*[bin_of(j) for j in range(size)]).alias("bins")).persist()
    stumps: list[Stump] = []
    for _ in range(rounds):
        stump, error = _best_stump(_cells(table, classes, edges, stumps), edges, classes)
        if error >= 1 - 1 / len(classes):
            break
        alpha = math.log((1 - error) / error) + math.log(len(classes) - 1) if error > 0 else 1.0
        stumps.append(replace(stump, weight=alpha))
        if error <= 0:
            break
    table.unpersist()
    return BoostedStumps(classes, stumps)


BINS = 32


def fit_tree(train: DataFrame, impurity: str = "entropy", seed: int = 101, depth: int = 30, bins: int = BINS) -> object:
    """Without a limit of depth in the original method; 30 is the most Spark allows. Splits are tried at ``bins`` values."""
    return DecisionTreeClassifier(impurity=impurity, seed=seed, maxDepth=depth, maxBins=bins, labelCol="label").fit(train)


def fit_forest(train: DataFrame, trees: int = 50, seed: int = 0, depth: int = 30, bins: int = BINS) -> object:
    """As :func:`fit_tree`: 30 is the most depth Spark allows."""
    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=depth, maxBins=bins, labelCol="label").fit(train)


HOME_MADE = {"PairwiseSvm": PairwiseSvm, "BoostedStumps": BoostedStumps, "ExactTree": ExactTree}


def save_model(spark, model: object, path: str) -> None:
    """Any fitted classifier; a type name beside it tells how to load it."""
    kind = type(model).__name__ if type(model).__name__ in HOME_MADE else "pipeline"
    _save_text(spark, f"{path}/kind", {"kind": kind})
    if kind == "pipeline":
        PipelineModel([model]).write().overwrite().save(f"{path}/model")
    else:
        model.save(spark, f"{path}/model")


def load_model(spark, path: str) -> object:
    kind = _load_text(spark, f"{path}/kind")["kind"]
    return PipelineModel.load(f"{path}/model") if kind == "pipeline" else HOME_MADE[kind].load(spark, f"{path}/model")


MODELS: dict[str, Fitter] = {
    "decision_tree": fit_tree, "random_forest": fit_forest, "adaboost": fit_adaboost, "svm": fit_svm,
}


def compare(train: DataFrame, test: DataFrame, models: dict[str, Fitter] = MODELS,
            ) -> tuple[DataFrame, dict[str, object]]:
    """(model, accuracy) rows and the fitted models."""
    train, test = train.persist(), test.persist()
    fitted = {name: fit(train) for name, fit in models.items()}
    rows = [(name, float(accuracy(model.transform(test)).first().accuracy)) for name, model in fitted.items()]
    train.unpersist()
    test.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, accuracy double"), fitted
