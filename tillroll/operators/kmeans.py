"""k-means with all restarts and all numbers of clusters in one job per step.

Each step reads the table once. A task holds the centres of all runs as one matrix, places its rows in every run by one product
of matrices per batch, and adds up sizes, sums and costs; so jobs are as many as the longest run has steps,
however many runs there are. A run that rests takes no further part.

Starts are k-means++ over all rows: in the order of a hash they lie in blocks of bounded size, a pass adds up the weights of each block for all
starts together, and the block in which a draw falls finds its row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tillroll.functions.vectors import matrix, numbers, row_hash, width
from tillroll.session import materialize

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 300
#: A run rests when its centres move by less than this share of the mean variance, as a squared distance.
TOLERANCE = 1e-4
#: Numbers of a product of matrices that are held at a time.
HELD = 4_000_000
#: Numbers in a block of the rows that starts are drawn from.
BLOCK = 250_000


class Centers(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Nearest of fixed centres, the first one on ties, as ``cluster``; can be stored with a pipeline."""

    centers = Param(Params._dummy(), "centers", "centres, one list of numbers each", TypeConverters.toList)
    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "cluster column", TypeConverters.toString)
    cost = Param(Params._dummy(), "cost", "sum of squared distances of the fitting table", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, centers=None, inputCol="features", outputCol="cluster", cost=0.0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="cluster", cost=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.getOrDefault(self.centers)]

    def setOutput(self, name: str) -> Centers:
        return self._set(outputCol=name)

    @property
    def trainingCost(self) -> float:
        return self.getOrDefault(self.cost)

    @property
    def summary(self) -> Centers:
        """What is known of the fit; only ``trainingCost``."""
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = [[float(v) for v in c] for c in self.getOrDefault(self.centers)]
        point = numbers(dataset, self.getOrDefault(self.inputCol))
        # |x - c|^2 = |x|^2 - 2 x c + |c|^2, of which |x|^2 is the same for all centres
        parts = [F.aggregate(F.zip_with(point, F.lit(c), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) * -2.0 + sum(v * v for v in c)
                 for c in rows]
        distances = F.array(*parts)
        return dataset.withColumn(self.getOrDefault(self.outputCol), (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


@dataclass
class Run:
    """One fit on its way."""

    k: int
    seed: int
    centers: np.ndarray
    cost: float = float("inf")
    steps: int = 0
    resting: bool = False
    done: bool = False


def plus_plus(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each centre drawn with the squared distance to those before it."""
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(points)))]
    norms = (points * points).sum(1)

    def to(i: int) -> np.ndarray:
        return np.maximum(norms - 2 * points @ points[i] + norms[i], 0.0)

    near = to(chosen[0])
    for _ in range(1, k):
        total = near.sum()
        chosen.append(int(draw.integers(len(points))) if total <= 0 else int(min(np.searchsorted(np.cumsum(near), draw.random() * total, "right"), len(points) - 1)))
        near = np.minimum(near, to(chosen[-1]))
    return points[chosen].copy()


def _step(all_centers: list[np.ndarray]):
    """Per task: (run, cluster, n, cost, sums) of all runs."""
    sizes = [len(c) for c in all_centers]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    stacked = np.concatenate(all_centers)
    norms = (stacked * stacked).sum(1)
    labels = [(run, cluster) for run, size in enumerate(sizes) for cluster in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, costs, sums = np.zeros(len(stacked)), np.zeros(len(stacked)), np.zeros(stacked.shape)
        for batch in batches:
            everything = matrix(batch.column("x"))
            size = max(1, HELD // max(1, len(stacked)))
            for start in range(0, len(everything), size):
                x = everything[start:start + size]
                own = (x * x).sum(1)
                apart = norms - 2 * (x @ stacked.T)
                for a, b in zip(edges, edges[1:]):
                    near = apart[:, a:b].argmin(1)
                    hits = np.zeros((len(x), b - a))
                    hits[np.arange(len(x)), near] = 1.0
                    counts[a:b] += hits.sum(0)
                    sums[a:b] += hits.T @ x
                    costs[a:b] += hits.T @ np.maximum(apart[np.arange(len(x)), a + near] + own, 0.0)
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in labels], pa.int32()), pa.array([c for _, c in labels], pa.int32()), pa.array(counts), pa.array(costs),
                 pa.array(list(sums), pa.list_(pa.float64()))], ["run", "cluster", "n", "cost", "sums"])

    return run


def features_of(rows: DataFrame, all_centers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set of centres: sizes, costs and vector sums of the rows (``x``) that are nearest to each, in one pass."""
    parts = rows.mapInArrow(_step(all_centers), "run int, cluster int, n double, cost double, sums array<double>")
    found = parts.groupBy("run", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    result = [(np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)) for c in all_centers]
    for r in found.select("run", "cluster", "n", "cost", vector_to_array("sums").alias("sums")).collect():
        result[r.run][0][r.cluster], result[r.run][1][r.cluster], result[r.run][2][r.cluster] = r.n, r.cost, r.sums
    return result


def _packed(rows: pa.Table) -> pa.Table:
    """One row for the rows of a block, in the order of the hash."""
    x, h = matrix(rows.column("x").combine_chunks()).astype(np.float64), rows.column("h").to_numpy()
    order = np.lexsort((*x.T[::-1], h))
    copies = rows.column("copies").to_numpy().astype(np.int64)[order]
    return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([int(copies.sum())], pa.int64()), "points": pa.array([x[order].tobytes()], pa.binary()),
                     "copies": pa.array([copies.tobytes()], pa.binary())})


def _blocks(present: DataFrame, column: str, size: int, seed: int) -> tuple[DataFrame, int]:
    """All rows in blocks (part, n, points, copies) by ranges of their hash, and the number of these ranges; equal rows are counted."""
    parts = max(1, -(-size * max(1, width(present, column)) // BLOCK))
    counted = present.select(row_hash(present, seed).alias("h"), numbers(present, column).alias("x")).groupBy("h", "x").agg(F.count(F.lit(1)).alias("copies"))
    part = F.least(F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
    return counted.withColumn("part", part).groupBy("part").applyInArrow(_packed, "part int, n long, points binary, copies binary"), parts


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            copies = np.frombuffer(batch.column("copies")[i].as_py(), np.int64)
            yield batch.column("part")[i].as_py(), np.frombuffer(batch.column("points")[i].as_py()).reshape(len(copies), -1), copies


def _weights(points: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the nearest of the centres chosen so far."""
    norms = (points * points).sum(1)
    near = np.full(len(points), np.inf)
    for c in chosen:
        near = np.minimum(near, np.maximum(norms - 2 * points @ c + c @ c, 0.0))
    return near


def _weighed(chains: list[np.ndarray]):
    """Per block: the sum of the weights of its rows for every start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points, copies in _opened(batches):
            sums = [float((_weights(points, c) * copies).sum()) for c in chains]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], ["part", "sums"])

    return run


def _drawn(wanted: list[tuple[int, float, bool]], chains: list[np.ndarray]):
    """The row of every start whose draw falls in a block: (block, place) by weight, or by number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points, copies in _opened(batches):
            for chain, (at, place, by_weight) in enumerate(wanted):
                if at == part:
                    edges = np.cumsum(_weights(points, chains[chain]) * copies if by_weight else copies)
                    found = min(int(np.searchsorted(edges, place, "right")), len(points) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([chain], pa.int32()), pa.array([points[found].tolist()], pa.list_(pa.float64()))], ["chain", "x"])

    return run


def spread_starts(blocks: DataFrame, k: int, seeds: list[int]) -> list[np.ndarray]:
    """:func:`plus_plus` for each seed, over all rows in stored blocks; two passes per centre, for all seeds together."""
    sizes = sorted((r.part, r.n) for r in blocks.select("part", "n").collect())
    parts, ends = [p for p, _ in sizes], np.cumsum([n for _, n in sizes])
    draws = [np.random.default_rng(s) for s in seeds]
    chains: list[np.ndarray] = []
    for step in range(k):
        if step:
            found = {r.part: r.sums for r in blocks.mapInArrow(_weighed(chains), "part int, sums array<double>").collect()}
            weights = np.cumsum([found[p] for p in parts], axis=0)
        wanted = []
        for chain, draw in enumerate(draws):
            by_weight = bool(step and weights[-1, chain] > 0)
            edges = weights[:, chain] if by_weight else ends
            place = draw.random() * edges[-1] if by_weight else int(draw.integers(int(ends[-1])))
            at = min(int(np.searchsorted(edges, place, "right")), len(parts) - 1)
            wanted.append((parts[at], place - (edges[at - 1] if at else 0), by_weight))
        rows = blocks.where(F.col("part").isin(*{at for at, _, _ in wanted})).mapInArrow(_drawn(wanted, chains), "chain int, x array<double>").collect()
        fresh = {r.chain: np.array([r.x], np.float64) for r in rows}
        chains = [np.concatenate((chains[i], fresh[i])) if step else fresh[i] for i in range(len(seeds))]
    return chains


def start_runs(table: DataFrame, ks: Iterable[int], restarts: int, seed: int, column: str) -> tuple[list[Run], float]:
    """All runs with their first centres, and the mean variance of the columns."""
    present = table.where(F.col(column).isNotNull())
    size = present.count()
    if not size:
        raise ValueError("no rows to cluster")
    spread = present.agg(Summarizer.variance(array_to_vector(numbers(table, column))).alias("v")).first().v
    ks, seeds = list(ks), list(range(seed, seed + restarts))
    blocks, parts = _blocks(present, column, size, seed)
    if parts == 1:
        block = blocks.first()
        copies = np.frombuffer(block.copies, np.int64)
        points = np.repeat(np.frombuffer(block.points).reshape(len(copies), -1), copies, axis=0)
        starts = [plus_plus(points, max(ks), s) for s in seeds]
    else:
        starts = spread_starts(materialize(blocks, "start-blocks"), max(ks), seeds)
    # the starts of one seed are the same up to the number of centres
    return [Run(k, s, centers[:k].copy()) for k in ks for s, centers in zip(seeds, starts)], float(np.mean(spread.toArray()))


def fit_runs(table: DataFrame, ks: Iterable[int], restarts: int, seed: int = 1, column: str = "features", steps: int = STEPS,
             tolerance: float = TOLERANCE) -> list[Run]:
    """Every run to its rest, or ``steps`` steps; costs are those of the centres as returned."""
    ks = list(ks)
    runs, variance = start_runs(table, ks, restarts, seed, column)
    rows = table.select(numbers(table, column).alias("x")).where("x is not null")
    moving = runs
    while moving:
        for run, (counts, costs, sums) in zip(moving, features_of(rows, [r.centers for r in moving])):
            run.cost = float(costs.sum())
            if run.resting:  # its cost is now that of its last centres
                run.done = True
                continue
            run.steps += 1
            now = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], run.centers)  # a centre without rows stays
            run.resting = float(((now - run.centers) ** 2).sum()) <= tolerance * variance or run.steps >= steps
            run.centers = now
        moving = [r for r in moving if not r.done]
    return runs


def best(runs: Iterable[Run], column: str = "features") -> Centers:
    """The cheapest run as a model."""
    run = min(runs, key=lambda r: r.cost)
    return Centers(centers=run.centers.tolist(), inputCol=column, cost=run.cost)
