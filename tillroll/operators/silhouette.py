"""Silhouettes by Euclidean distance.

The mean distance of a row to a cluster does not follow from sums, so it takes all rows. The values are computed for a
sample of rows, against every row of the table: the sample goes to all tasks, each reads its rows batch by batch and adds up distances per sample row and
cluster. The sample is drawn per cluster by a hash, in proportion, and its size is bounded (``MOST_ROWS`` rows and ``MOST_VALUES``
numbers); a table no larger than that is its own sample and the result exact. Each value is exact in any case; only their mean
is an estimate, and comes with its standard error.

:func:`whole_means` takes no sample: every row meets every other one, in blocks of bounded size, once for several clusterings of the same rows.
Its time is quadratic in the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from tillroll.functions.vectors import MOST_VALUES, matrix, numbers, row_hash, width
from tillroll.session import materialize

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a sample: about so many.
MOST_ROWS = 10_000
#: Distances that a task holds at a time.
HELD = 2_000_000
#: Numbers and rows of a block, distances of two blocks that a task holds at a time, and bytes of the blocks that it reads again and again.
BLOCK, BLOCK_ROWS, TILE, READ = 500_000, 4_096, 500_000, 64 << 20


@dataclass(frozen=True)
class Silhouette:
    """Mean silhouette, its standard error (0 if every row counts), rows that count and all rows."""

    mean: float
    error: float
    sampled: int
    rows: int


def _distances(points: np.ndarray, kinds: int):
    """Sums of the distances of every sample row to the rows of each cluster that a task has."""
    norms = (points * points).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(points), kinds))
        seen = False
        for batch in batches:
            everything, clusters = matrix(batch.column("x")), batch.column("place").to_numpy(zero_copy_only=False)
            size = max(1, HELD // max(1, len(points)))
            for start in range(0, len(everything), size):
                x, own = everything[start:start + size], clusters[start:start + size]
                apart = np.sqrt(np.maximum(norms[:, None] - 2 * (points @ x.T) + (x * x).sum(1), 0.0))
                for place in np.unique(own):
                    sums[:, place] += apart[:, own == place].sum(1)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(list(sums), pa.list_(pa.float64()))], ["at", "sums"])

    return run


def _measured(clustered: DataFrame, column: str, cluster: str, key: str | None, most_rows: int, seed: int) -> tuple[list[tuple], dict[Any, int]]:
    """(key, cluster, silhouette) of the sample, and the size of every cluster."""
    table = clustered.where(F.col(column).isNotNull() & F.col(cluster).isNotNull())
    sizes = {r[0]: r.n for r in table.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(cluster).collect()}
    total = sum(sizes.values())
    if not total:
        return [], sizes
    places = {c: i for i, c in enumerate(sizes)}
    most = min(most_rows, max(2 * len(sizes), MOST_VALUES // max(1, width(table, column))))
    chosen = table.withColumn("_h", row_hash(table, seed))
    if total > most:
        # a small cluster still has a few rows in the sample, for its variance
        share = F.lit(0.0)
        for c, n in sizes.items():
            share = F.when(F.col(cluster) == F.lit(c), min(1.0, max(most / total, 30 / n))).otherwise(share)
        chosen = chosen.where(F.pmod("_h", F.lit(1 << 40)) < share * float(1 << 40))
    picked = chosen.select("_h", (F.col(key) if key else F.lit(None)).alias("k"), F.col(cluster).alias("c"), numbers(table, column).alias("x")).collect()
    picked.sort(key=lambda r: (r._h, str(r.k)))
    points = np.array([r.x for r in picked], np.float64).reshape(len(picked), -1)
    index = F.lit(0)
    for c, i in places.items():
        index = F.when(F.col(cluster) == F.lit(c), i).otherwise(index)
    rows = table.select(numbers(table, column).alias("x"), index.cast("int").alias("place"))
    parts = rows.mapInArrow(_distances(points, len(sizes)), "at long, sums array<double>")
    sums = np.zeros((len(points), len(sizes)))
    total_of = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(sizes))]
    for r in parts.groupBy("at").agg(*total_of).collect():
        sums[r["at"]] = [r[f"s{i}"] for i in range(len(sizes))]
    counts = np.array(list(sizes.values()), np.float64)
    found = []
    for r, row in zip(picked, sums):
        own = places[r.c]
        if counts[own] == 1 or len(sizes) == 1:
            found.append((r.k, r.c, 0.0))
            continue
        a = row[own] / (counts[own] - 1)
        b = min(row[i] / counts[i] for i in range(len(counts)) if i != own)
        found.append((r.k, r.c, float((b - a) / max(a, b)) if max(a, b) > 0 else 0.0))
    return found, sizes


def euclidean_silhouettes(clustered: DataFrame, key: str, column: str = "features", cluster: str = "cluster", most_rows: int = MOST_ROWS,
                          seed: int = 1) -> DataFrame:
    """(key, cluster, silhouette) of about ``most_rows`` rows, of every row if there are no more; a lone row has 0."""
    found, _ = _measured(clustered, column, cluster, key, most_rows, seed)
    kinds = {c: clustered.schema[c].dataType.simpleString() for c in (key, cluster)}
    return clustered.sparkSession.createDataFrame(found, f"`{key}` {kinds[key]}, `{cluster}` {kinds[cluster]}, silhouette double")


def mean_euclidean_silhouette(clustered: DataFrame, column: str = "features", cluster: str = "cluster", most_rows: int = MOST_ROWS, seed: int = 1) -> Silhouette:
    """Mean over the rows: clusters weigh by their sizes, and the error is that of a sample drawn per cluster."""
    found, sizes = _measured(clustered, column, cluster, None, most_rows, seed)
    total = sum(sizes.values())
    mean = variance = 0.0
    for c, n in sizes.items():
        own = np.array([s for _, k, s in found if k == c])
        if not len(own):
            continue
        mean += n / total * own.mean()
        if len(own) < n:
            spread = own.var(ddof=1) if len(own) > 1 else 1.0
            variance += (n / total) ** 2 * spread / len(own) * (1 - len(own) / n)
    return Silhouette(float(mean), math.sqrt(variance), len(found), total)


def _packed(size: int):
    """Rows (x, own) in blocks of ``size``: their numbers and the places of their clusters as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            while held and (sum(len(x) for x, _ in held) >= size or last):
                x, own = (np.concatenate(part) for part in zip(*held))
                held = [(x[size:], own[size:])] if len(x) > size else []
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([x[:size].tobytes()], pa.binary()), pa.array([own[:size].tobytes()], pa.binary())],
                                                 ["at", "points", "own"])
                number += 1

        for batch in batches:
            if batch.num_rows:
                held.append((matrix(batch.column("x")).astype(np.float64), matrix(batch.column("own")).astype(np.int32)))
                yield from block(False)
        yield from block(True)

    return run


def _sizes(clusterings: int):
    """Rows of each cluster of each clustering."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("own"):
                places = np.frombuffer(own.as_py(), np.int32).reshape(-1, clusterings)
                for j in range(clusterings):
                    values, counts = np.unique(places[:, j], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([j] * len(values), pa.int32()), pa.array(values), pa.array(counts, pa.int64())], ["which", "place", "n"])

    return run


def _met(kinds: list[int]):
    """For each block: sums of the distances of its rows to those of every cluster of every clustering, over the blocks that a task lets it meet."""
    starts = np.concatenate(([0], np.cumsum(kinds))).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sums = None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([own.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())],
                                                 ["at", "own", "sums"])

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("at")[i].as_py() != at:
                    yield from done()
                    at = batch.column("at")[i].as_py()
                    own = np.frombuffer(batch.column("own")[i].as_py(), np.int32).reshape(-1, len(kinds))
                    points = np.frombuffer(batch.column("points")[i].as_py()).reshape(len(own), -1)
                    norms, sums = (points * points).sum(1), np.zeros((len(own), starts[-1]))
                places = np.frombuffer(batch.column("other_own")[i].as_py(), np.int32).reshape(-1, len(kinds))
                x = np.frombuffer(batch.column("other_points")[i].as_py()).reshape(len(places), -1)
                there, hot = (x * x).sum(1), np.zeros((len(places), starts[-1]))
                for j, start in enumerate(starts[:-1]):
                    hot[np.arange(len(places)), start + places[:, j]] = 1.0
                size = max(1, TILE // len(places))
                for a in range(0, len(own), size):
                    apart = points[a:a + size] @ x.T
                    apart *= -2.0
                    apart += there
                    apart += norms[a:a + size, None]
                    np.sqrt(np.maximum(apart, 0.0, out=apart), out=apart)
                    sums[a:a + size] += apart @ hot
        yield from done()

    return run


def _valued(counts: list[list[int]]):
    """The sum of the silhouettes of the rows of a block, for each clustering."""
    starts = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(int)

    def run(parts: pa.Table) -> pa.Table:
        own = np.frombuffer(parts.column("own")[0].as_py(), np.int32).reshape(-1, len(counts))
        sums = np.zeros((len(own), starts[-1]))
        for part in parts.column("sums"):
            sums += np.frombuffer(part.as_py()).reshape(sums.shape)
        totals, rows = [], np.arange(len(own))
        for j, sizes in enumerate(counts):
            n, mine, row = np.array(sizes, np.float64), own[:, j], sums[:, starts[j]:starts[j + 1]]
            if len(n) == 1:
                totals.append(0.0)
                continue
            a = row[rows, mine] / np.maximum(n[mine] - 1, 1)
            others = row / n
            others[rows, mine] = np.inf
            b = others.min(1)
            most = np.maximum(a, b)
            totals.append(float(np.where((n[mine] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0).sum()))
        return pa.table({"which": pa.array(range(len(counts)), pa.int32()), "total": pa.array(totals, pa.float64())})

    return run


def whole_means(clustered: DataFrame, clusters: list[str], column: str = "features") -> list[float]:
    """Mean Euclidean silhouette over all rows for each of the columns ``clusters``, from the distances of all pairs of rows.

    Blocks of rows meet in a product of stored tables; what is shuffled are the sums of distances per row and cluster.
    """
    present = F.col(column).isNotNull()
    for c in clusters:
        present = present & F.col(c).isNotNull()
    table = clustered.where(present)
    kinds = [sorted(r[0] for r in table.select(c).distinct().collect()) for c in clusters]
    # places of the clusters in place of their names
    places = [F.array_position(F.array(*[F.lit(v) for v in own]), F.col(c)) - 1 for c, own in zip(clusters, kinds)]
    if not kinds[0]:
        return [0.0] * len(clusters)
    rows = max(1, min(BLOCK_ROWS, BLOCK // max(1, width(table, column))))
    packed = materialize(table.select(numbers(table, column).alias("x"), F.array(*places).cast("array<int>").alias("own"))
                         .mapInArrow(_packed(rows), "at long, points binary, own binary"), "silhouette-blocks")
    total = [[0] * len(own) for own in kinds]
    for r in packed.mapInArrow(_sizes(len(kinds)), "which int, place int, n long").groupBy("which", "place").agg(F.sum("n").alias("n")).collect():
        total[r.which][r.place] = r.n
    size = packed.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("points") + F.length("own")).alias("bytes")).first()
    # every pair of partitions is a task; one reads the second partition again for each block of the first
    here = packed.repartition(max(1, min(size.blocks, 4 * table.sparkSession.sparkContext.defaultParallelism)))
    there = packed.select(F.col("points").alias("other_points"), F.col("own").alias("other_own")).repartition(-(-size.bytes // READ))
    pairs = here.join(there.hint("shuffle_replicate_nl"))
    sums = pairs.mapInArrow(_met([len(own) for own in kinds]), "at long, own binary, sums binary")
    found = sums.groupBy("at").applyInArrow(_valued(total), "which int, total double").groupBy("which").agg(F.sum("total").alias("total"))
    return [r.total / sum(total[r.which]) for r in found.orderBy("which").collect()]
