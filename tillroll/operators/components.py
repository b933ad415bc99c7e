"""Principal components of sparse vectors.

The covariance of n rows times a block of vectors is the mean of x (x . block) over the rows, less the mean row times (mean . block). So a
pass over the rows as they are, sparse, gives the product, and no centred row is ever made. A block of random vectors is multiplied
again and again; all products together span a Krylov space, whose best directions are the components. Passes go on until the
components asked for are eigenvectors up to ``TOLERANCE``, or until the space holds all directions, so that the result is exact.

A pass brings one table of (entries x block) numbers to the driver, summed over tasks: entries are the vocabulary, not the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Directions beyond those asked for.
MORE = 10
#: What remains of an eigenvector's image beside it, as a share of the largest eigenvalue.
TOLERANCE = 1e-7
#: Rows of the product that one row of a task's result holds.
CHUNK = 64


def sparse(column: str) -> Column:
    """Places and values of a vector's entries, dense or sparse, without making it dense."""
    raw = F.unwrap_udt(column)
    dense = raw["type"] == 1
    places = F.when(dense, F.when(F.size(raw["values"]) > 0, F.sequence(F.lit(0), F.size(raw["values"]) - 1))).otherwise(raw["indices"])
    return F.struct(F.coalesce(places, F.array().cast("array<int>")).alias("places"), raw["values"].alias("values"))


def _rows(batch: pa.RecordBatch | pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every entry."""
    places, values = batch.field("places"), batch.field("values")
    sizes = np.diff(places.offsets.to_numpy())
    return np.repeat(np.arange(len(places)), sizes), places.flatten().to_numpy(), values.flatten().to_numpy()


def _product(block: np.ndarray):
    """Sum of x (x . block) over the rows of a task, in chunks of rows of the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for batch in batches:
            rows, places, values = _rows(batch.column("x"))
            size = 2_000_000 // max(1, block.shape[1])
            cuts = [0]  # whole rows, about ``size`` entries at a time
            while cuts[-1] < len(rows):
                at = min(cuts[-1] + size, len(rows))
                if at < len(rows):
                    at = int(np.searchsorted(rows, rows[at], "left"))
                    at = at if at > cuts[-1] else int(np.searchsorted(rows, rows[cuts[-1]], "right"))
                cuts.append(at)
            for a, b in zip(cuts, cuts[1:]):
                first = rows[a]
                own = np.zeros((rows[b - 1] - first + 1, block.shape[1]))
                part = values[a:b, None] * block[places[a:b]]
                starts = np.flatnonzero(np.concatenate(([True], rows[a + 1:b] != rows[a:b - 1])))
                own[rows[a:b][starts] - first] = np.add.reduceat(part, starts, axis=0)
                part = values[a:b, None] * own[rows[a:b] - first]
                order = np.argsort(places[a:b], kind="stable")
                sorted_places = places[a:b][order]
                starts = np.flatnonzero(np.concatenate(([True], sorted_places[1:] != sorted_places[:-1])))
                total[sorted_places[starts]] += np.add.reduceat(part[order], starts, axis=0)
        starts = list(range(0, len(total), CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[i:i + CHUNK].ravel() for i in starts], pa.list_(pa.float64()))], ["at", "part"])

    return run


def _covariance_times(rows: DataFrame, n: int, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    parts = rows.mapInArrow(_product(block), "at int, part array<double>").groupBy("at").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    found = np.zeros(block.shape)
    for r in parts.select("at", vector_to_array("part").alias("part")).collect():
        found[r["at"]:r["at"] + CHUNK] = np.array(r.part).reshape(-1, block.shape[1])
    return found / n - np.outer(mean, mean @ block)


def _apart(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``basis``."""
    size = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):  # twice, for rounding
        block = block - basis @ (basis.T @ block)
    left, weights, _ = np.linalg.svd(block, full_matrices=False)
    return left[:, weights > 1e-10 * max(size, 1e-300)]


@dataclass(frozen=True)
class Components:
    """Mean, directions in columns, their variances, and the variance of all directions; rows are centred before they are projected."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    passes: int
    column: str = "features"

    def transform(self, table: DataFrame, output: str = "pca") -> DataFrame:
        directions, shift = self.directions, self.mean @ self.directions

        @F.pandas_udf("array<double>")
        def project(entries: pd.DataFrame) -> pd.Series:
            found = [np.asarray(v) @ directions[np.asarray(p, np.int64)] - shift if len(p) else -shift for p, v in zip(entries["places"], entries["values"])]
            return pd.Series(found, dtype=object)

        return table.withColumn(output, array_to_vector(project(sparse(self.column))))

    def explained(self, spark) -> DataFrame:
        """Explained variance per component, as a share of the whole, and its running sum."""
        rows = [(i + 1, float(v / self.total) if self.total else 0.0) for i, v in enumerate(self.variances)]
        table = spark.createDataFrame(rows, "component int, explained double")
        running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
        return table.withColumn("cumulative", F.sum("explained").over(running))


def fit_components(table: DataFrame, k: int | None = None, column: str = "features", seed: int = 1, tolerance: float = TOLERANCE) -> Components:
    """The ``k`` components of most variance; all of them without ``k``. The sign of a component makes its largest entry positive."""
    known = table.where(F.col(column).isNotNull())
    n = known.count()
    if not n:
        raise ValueError("no rows to take components of")
    row = known.agg(Summarizer.mean(F.col(column)).alias("mean"), Summarizer.variance(F.col(column)).alias("v")).first()
    mean = row["mean"].toArray()
    size, total = len(mean), float(row.v.toArray().sum()) * (n - 1) / n
    wanted = size if k is None else min(k, size)
    rows = known.select(sparse(column).alias("x"))
    draw = np.random.default_rng(seed)
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    block, passes = np.linalg.qr(draw.normal(size=(size, min(size, wanted + MORE))))[0], 0
    while True:
        basis, images = np.hstack((basis, block)), np.hstack((images, _covariance_times(rows, n, mean, block)))
        passes += 1
        inner = basis.T @ images
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        left = np.linalg.norm(images @ vectors - basis @ vectors * values, axis=0)
        if basis.shape[1] >= size or (basis.shape[1] >= wanted and left.max(initial=0.0) <= tolerance * max(values.max(initial=0.0), 1e-300)):
            break
        block = _apart(images[:, -block.shape[1]:], basis)
        if not block.shape[1]:  # nothing new: the rest of the directions has no variance, or needs other starts
            block = _apart(draw.normal(size=(size, min(MORE, size - basis.shape[1]))), basis)
        block = block[:, :size - basis.shape[1]]
    directions = basis @ vectors
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return Components(mean, directions * np.where(signs == 0, 1.0, signs), np.maximum(values, 0.0), total, passes, column)
