"""Ward's hierarchical clusters over mergeable summaries.

A summary of rows is their number, vector sum and squared spread; summaries of two sets add up. One pass over the table gives each row to
the nearest of at most ``MOST_LEAVES`` representatives and adds up their summaries; merging by Ward's rule then needs nothing but the
summaries, since the cost of joining two sets follows from their sizes and means. Merges are found along chains of
nearest neighbours, which is quadratic in the number of summaries, not of rows.

Every distinct row is a summary of its own, so the merges are exactly Ward's for a table of any size. As joining two sets brings none nearer to a
third, all pairs that are nearest to each other can be joined at once: while more than ``LAST_SETS`` sets are left, a round finds the nearest set of
each in blocks with boxes, distributed, and joins all such pairs; the last sets are joined on the driver. Merges of rounds stay tables. Where a caller gives
``most_leaves``, the summaries are those of so many rows drawn by k-means++ from a bounded sample, and what is lost is the spread inside them (``within``), which is reported.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.functions.vectors import MOST_VALUES, matrix, numbers, sampled, width
from tillroll.operators.kmeans import features_of, plus_plus
from tillroll.operators.silhouette import mean_euclidean_silhouette
from tillroll.operators.smote import _cell_of, _halves
from tillroll.session import materialize

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct rows of a table that is joined on the driver from the start, and sets that are left to it after rounds.
MOST_LEAVES, LAST_SETS = 2_000, 6_000
#: Sets in a block, and pairs of them that a task holds at a time.
BLOCK_ROWS, HELD = 2_000, 500_000


@dataclass(frozen=True)
class Ward:
    """Summaries, and merges (left, right, height, rows) in the order of heights; leaves come first, then merges, as in a linkage table."""

    representatives: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    merges: list[tuple[int, int, float, float]]
    within: float

    def labels(self, k: int) -> np.ndarray:
        """Cluster of each summary when ``k`` are left, numbered by the first summary in each."""
        n = len(self.sizes)
        if not 1 <= k <= n:
            raise ValueError(f"{k} clusters of {n} distinct rows")
        parent = list(range(2 * n - 1))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for step, (a, b, _, _) in enumerate(self.merges[:n - k]):
            parent[top(a)] = parent[top(b)] = n + step
        met = {}
        return np.array([met.setdefault(top(i), len(met)) for i in range(n)])

    def transform(self, table: DataFrame, k: int, column: str = "features", output: str = "cluster") -> DataFrame:
        """Each row's cluster: that of its nearest representative."""
        return self.placed(table, self.labels(k), column, output)

    def placed(self, table: DataFrame, labels: np.ndarray, column: str = "features", output: str = "leaf") -> DataFrame:
        """The label of each row's nearest representative."""
        points = self.representatives
        norms = (points * points).sum(1)

        @F.pandas_udf("int")
        def place(values: pd.Series) -> pd.Series:
            found = np.empty(len(values), np.int32)
            for start in range(0, len(values), 1_000):
                x = np.stack(values.iloc[start:start + 1_000].to_numpy())
                found[start:start + len(x)] = labels[(norms - 2 * (x @ points.T)).argmin(1)]
            return pd.Series(found)

        return table.withColumn(output, place(numbers(table, column)))

    def height(self, k: int) -> float:
        """Height of the merge that leaves k clusters; 0 if there are no more rows."""
        return self.merges[len(self.sizes) - k - 1][2] if k < len(self.sizes) else 0.0

    def spread(self) -> tuple[int, float]:
        """Number of rows, and the costs of all merges with the spread inside the summaries."""
        return int(self.sizes.sum()), sum(h * h / 2 for _, _, h, _ in self.merges) + self.within

    def linkage(self, spark: SparkSession) -> DataFrame:
        """The merges as a table: step, left, right, height, rows."""
        rows = [(i + 1, int(a), int(b), float(h), float(n)) for i, (a, b, h, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "step int, `left` int, `right` int, height double, rows double")


def chain_merges(sizes: np.ndarray, means: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Ward's merges of summaries, found along chains of nearest neighbours; height is the root of twice the cost, as usual for Ward."""
    n = len(sizes)
    weight, centre, active = sizes.astype(np.float64).copy(), means.copy(), np.ones(n, bool)
    found: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(found) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(active)[0])]
        tip = chain[-1]
        cost = weight[tip] * weight / (weight[tip] + weight) * ((centre - centre[tip]) ** 2).sum(1)
        cost[~active] = np.inf
        cost[tip] = np.inf
        near = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:  # mutual neighbours
            other = chain[-2]
            found.append((tip, other, float(np.sqrt(2 * cost[other]))))
            chain = chain[:-2]
            both = weight[tip] + weight[other]
            centre[tip] = (weight[tip] * centre[tip] + weight[other] * centre[other]) / both
            weight[tip], active[other] = both, False
        else:
            chain.append(near)
    # by height; the first summary of a merged set stands for it
    parent, number, rows = list(range(n)), list(range(n)), sizes.astype(np.float64).tolist()

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    merges = []
    for step, (a, b, height) in enumerate(sorted(found, key=lambda m: m[2])):
        a, b = top(a), top(b)
        left, right = sorted((number[a], number[b]))
        parent[b], rows[a], number[a] = a, rows[a] + rows[b], n + step
        merges.append((left, right, height, rows[a]))
    return merges


@dataclass(frozen=True)
class WholeWard:
    """Ward's merges of a table whose distinct rows are too many for one place. A row is known by its place in the order of values, a merge by a key above these
    that rises from round to round. The merges of the driver are a list as well: (key, left, right)."""

    leaves: DataFrame        # id, x, n
    rounds: list[DataFrame]  # lo, hi, cost, sets: a pair that was joined, or a set that was not
    last: list[int]          # keys of the sets that were left for the driver
    joined: list[tuple[int, int, int]]
    merges: DataFrame        # key, left, right, height, rows
    n: int

    def _top(self, k: int) -> list:
        return self.merges.orderBy(F.desc("height"), F.desc("key")).limit(k).collect()

    def height(self, k: int) -> float:
        """Height of the merge that leaves k clusters; 0 if there are no more rows."""
        return self._top(k)[-1].height if k < self.n else 0.0

    def spread(self) -> tuple[int, float]:
        """Number of rows, and the costs of all merges."""
        return int(self.leaves.agg(F.sum("n")).first()[0]), float(self.merges.agg(F.sum(F.col("height") * F.col("height") / 2)).first()[0])

    def labels(self, k: int) -> DataFrame:
        """(id, cluster) of the distinct rows when ``k`` clusters are left, numbered by the first row in each."""
        if not 1 <= k <= self.n:
            raise ValueError(f"{k} clusters of {self.n} distinct rows")
        undone = {r.key for r in self._top(k - 1)} if k > 1 else set()
        root = {}
        for key, left, right in reversed(self.joined):
            for child in (left, right):
                root[child] = child if key in undone else root.get(key, key)
        spark = self.leaves.sparkSession
        found = spark.createDataFrame([(key, root.get(key, key)) for key in self.last], "key long, root long")
        for number, table in reversed(list(enumerate(self.rounds))):
            after = F.when(F.size("sets") == 2, self.n * (number + 1) + F.col("lo")).otherwise(F.col("sets")[0]["key"])
            members = table.select(after.alias("key"), F.explode("sets.key").alias("member"))
            cut = F.array(*[F.lit(u) for u in sorted(undone)]).cast("array<bigint>")
            found = members.join(found, "key").select(
                F.col("member").alias("key"), F.when(F.array_contains(cut, F.col("key")) & (F.col("key") != F.col("member")), F.col("member")).otherwise(F.col("root")).alias("root"))
        found = materialize(found, "ward-roots")
        first = sorted((r.first, r.root) for r in found.groupBy("root").agg(F.min("key").alias("first")).collect())
        names = spark.createDataFrame([(root, i) for i, (_, root) in enumerate(first)], "root long, cluster int")
        return found.join(F.broadcast(names), "root").select(F.col("key").alias("id"), "cluster")

    def transform(self, table: DataFrame, k: int, column: str = "features", output: str = "cluster") -> DataFrame:
        """Each row's cluster; null for rows that the fit has not seen."""
        labels = self.leaves.select("id", F.col("x").alias("_x")).join(self.labels(k), "id").select("_x", F.col("cluster").alias(output))
        return table.withColumn("_x", numbers(table, column)).join(labels, "_x", "left").drop("_x")

    def linkage(self, spark: SparkSession) -> DataFrame:
        """The merges as a table: step, left, right, height, rows."""
        placed = materialize(_placed_in_order(self.merges, ["height", "key"], "at"), "ward-order")
        number = placed.select("key", (F.col("at") + self.n).alias("number"))

        def of(child: str) -> DataFrame:
            return number.select(F.col("key").alias(child), F.col("number").alias(f"{child}_number"))

        sides = [F.coalesce(F.col(f"{c}_number"), F.col(c)) for c in ("left", "right")]
        return placed.join(of("left"), "left", "left").join(of("right"), "right", "left").select(
            (F.col("at") + 1).cast("int").alias("step"), F.least(*sides).cast("int").alias("left"), F.greatest(*sides).cast("int").alias("right"), "height", "rows")


def _placed_in_order(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """``table`` with the place of each row in an order, from 0; dealt by range, so no task orders all rows."""
    dealt = materialize(table.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ward-dealt")
    counts = sorted((r._part, r.n) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = np.cumsum([0, *(n for _, n in counts)])
    before = table.sparkSession.createDataFrame([(p, int(e)) for (p, _), e in zip(counts, ends)], "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before")


def _nearest(ids: np.ndarray, n: np.ndarray, x: np.ndarray, least: np.ndarray, other_ids: np.ndarray, other_n: np.ndarray, other_x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, cost, partner): for each set the one that costs least to join, of equal ones that of the lower pair of ids; none that costs more than ``least``."""
    found = []
    here, there = (x * x).sum(1), (other_x * other_x).sum(1)
    size = max(1, HELD // max(1, len(other_ids)))
    for start in range(0, len(ids), size):
        own = slice(start, start + size)
        weight = n[own, None] * other_n / (n[own, None] + other_n)
        norms = here[own, None] + there
        rough, slack = norms - 2 * (x[own] @ other_x.T), 1e-12 * norms
        same = ids[own, None] == other_ids
        rough[same] = np.inf
        limit = np.minimum(least[own], ((rough + slack) * weight).min(1))
        rows, picks = np.nonzero(((rough - slack) * weight <= limit[:, None] * (1 + 1e-12)) & ~same)
        a, b = n[own][rows], other_n[picks]
        cost = a * b / (a + b) * ((x[own][rows] - other_x[picks]) ** 2).sum(1)
        found.append((rows + start, cost, other_ids[picks]))
    rows, cost, partner = (np.concatenate(part) for part in zip(*found))
    low, high = np.minimum(ids[rows], partner), np.maximum(ids[rows], partner)
    order = np.lexsort((high, low, cost, rows))
    first = order[np.r_[True, np.diff(rows[order]) != 0]] if len(order) else order
    return rows[first], cost[first], partner[first]


def _boxed(sets: pa.Table) -> pa.Table:
    """A block: its sets, the best partner of each inside it, its box and what bounds the partners elsewhere."""
    ids, n, x = sets.column("id").to_numpy(), sets.column("n").to_numpy(), matrix(sets.column("x").combine_chunks())
    least, partner = np.full(len(ids), np.inf), np.full(len(ids), -1, np.int64)
    rows, cost, found = _nearest(ids, n, x, least, ids, n, x)
    least[rows], partner[rows] = cost, found
    return pa.table({"at": pa.array([int(ids.min())]), "ids": [ids.tobytes()], "ns": [n.tobytes()], "points": [x.tobytes()], "least": [least.tobytes()], "partner": [partner.tobytes()],
                     "far": [float((least / n).max())], "most": [float(least.max())], "light": [float(n.min())],
                     "low": pa.array([x.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([x.max(0).tolist()], pa.list_(pa.float64()))})


BOXED = "at long, ids binary, ns binary, points binary, least binary, partner binary, far double, most double, light double, low array<double>, high array<double>"
FOUND = "id long, cost double, partner long"


def _best_rows(ids, cost, partner) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cost, pa.float64()), pa.array(partner, pa.int64())], ["id", "cost", "partner"])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, cost, partner = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("ids", np.int64), ("least", float), ("partner", np.int64)))
            yield _best_rows(ids[partner >= 0], cost[partner >= 0], partner[partner >= 0])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partners in other blocks that cost no more than those found so far."""
    at = None
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("at", "ids", "ns", "points", "least", "other_ids", "other_ns", "other_points", "other_low", "other_high", "light")}
            if r["at"] != at:
                at, ids, n, least = r["at"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ns"]), np.frombuffer(r["least"]).copy()
                x = np.frombuffer(r["points"]).reshape(len(ids), -1)
            apart = np.maximum(np.maximum(np.array(r["other_low"]) - x, x - np.array(r["other_high"])), 0.0)
            asking = np.flatnonzero((apart * apart).sum(1) * (n * r["light"] / (n + r["light"])) <= least * (1 + 1e-9))
            if len(asking):
                other_ids = np.frombuffer(r["other_ids"], np.int64)
                rows, cost, partner = _nearest(ids[asking], n[asking], x[asking], least[asking], other_ids, np.frombuffer(r["other_ns"]),
                                               np.frombuffer(r["other_points"]).reshape(len(other_ids), -1))
                near = cost <= least[asking[rows]]
                rows, cost, partner = asking[rows[near]], cost[near], partner[near]
                least[rows] = cost
                if len(rows):
                    yield _best_rows(ids[rows], cost, partner)


def _partners(sets: DataFrame, count: int) -> DataFrame:
    """(id, lo, hi, cost): for each set the pair with the one that costs least to join."""
    blocks = max(1, -(-count // BLOCK_ROWS))
    # the sample only cuts the blocks, every set meets all that can be nearest
    tree = _halves(sampled(sets.select("id", "x"), "x", count, max(10_000, 64 * blocks), 0), blocks) if blocks > 1 else [(-1, 0.0)]
    placed = sets.select("id", "n", "x", _cell_of(tree)("x").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = materialize(dealt.groupBy("cell", "part").applyInArrow(lambda sets: _boxed(sets), BOXED), "ward-blocks")
    there = packed.select(*[F.col(c).alias(f"other_{c}") for c in ("at", "ids", "ns", "points", "low", "high")], "light")
    here = packed.select("at", "ids", "ns", "points", "least", "far", "most", "low", "high").repartition(max(1, min(blocks, 4 * sets.sparkSession.sparkContext.defaultParallelism)))
    gaps = F.zip_with(F.zip_with("low", "other_high", lambda a, b: a - b), F.zip_with("other_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)
    met = here.join(there.hint("shuffle_replicate_nl"), (F.col("at") != F.col("other_at")) & (apart <= (F.col("far") + F.col("most") / F.col("light")) * (1 + 1e-9)))
    met = met.select("at", "ids", "ns", "points", "least", "other_ids", "other_ns", "other_points", "other_low", "other_high", "light")
    found = packed.select("ids", "least", "partner").mapInArrow(_inside, FOUND).unionByName(met.mapInArrow(_across, FOUND))
    best = F.min(F.struct("cost", F.least("id", "partner").alias("lo"), F.greatest("id", "partner").alias("hi"))).alias("b")
    return found.groupBy("id").agg(best).select("id", "b.*")


def _whole(leaves: DataFrame, count: int, most: int) -> WholeWard:
    """All merges of ``count`` distinct rows (x, n), rounds of them until no more than ``most`` sets are left."""
    leaves = materialize(_placed_in_order(leaves, ["x"], "id"), "ward-leaves")
    spark, rounds, merges, left = leaves.sparkSession, [], [], count
    state = leaves.select("id", F.col("id").alias("key"), F.col("n").cast("double").alias("n"), "x", F.lit(0.0).alias("top"))
    while left > most:
        pairs = state.join(_partners(state, left), "id").groupBy("lo", "hi").agg(
            F.first("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("id", "key", "n", "x", "top"))).alias("sets"))
        rounds.append(materialize(pairs, "ward-round"))
        a, b = F.col("sets")[0], F.col("sets")[1]
        joined = rounds[-1].where(F.size("sets") == 2).select(
            a["id"].alias("id"), (count * len(rounds) + a["id"]).alias("key"), (a["n"] + b["n"]).alias("n"),
            F.zip_with(a["x"], b["x"], lambda p, q: (a["n"] * p + b["n"] * q) / (a["n"] + b["n"])).alias("x"),
            F.greatest(F.sqrt(2 * F.col("cost")), a["top"], b["top"]).alias("top"), a["key"].alias("left"), b["key"].alias("right"))
        merges.append(joined.select("key", "left", "right", F.col("top").alias("height"), F.col("n").alias("rows")))
        alone = rounds[-1].where(F.size("sets") == 1).select(*[a[c].alias(c) for c in ("id", "key", "n", "x", "top")])
        state = materialize(alone.unionByName(joined.drop("left", "right")), "ward-sets")
        was, left = left, state.count()
        if left == was:
            raise ValueError("rows without a distance to each other")
    last = state.orderBy("id").collect()
    keys, tops, rows = [r.key for r in last], [r.top for r in last], []
    for step, (a, b, height, n) in enumerate(chain_merges(np.array([r.n for r in last]), np.array([r.x for r in last], np.float64))):
        tops.append(max(height, tops[a], tops[b]))
        keys.append(count * (len(rounds) + 1) + step)
        rows.append((keys[-1], keys[a], keys[b], tops[-1], n))
    table = spark.createDataFrame(rows, "key long, `left` long, `right` long, height double, rows double")
    for part in merges:
        table = table.unionByName(part)
    return WholeWard(leaves, rounds, keys[:len(last)], [r[:3] for r in rows], table, count)


def fit_ward(table: DataFrame, column: str = "features", most_leaves: int | None = None, seed: int = 1) -> Ward | WholeWard:
    """Ward's merges of all distinct rows; with ``most_leaves``, of at most so many summaries."""
    rows = table.select(numbers(table, column).alias("x")).where("x is not null")
    most = MOST_LEAVES if most_leaves is None else most_leaves
    # most tables show early that they have more distinct rows than these
    few = rows.limit(4 * most).distinct().limit(most + 1).collect()
    if len(few) <= most:
        few = rows.distinct().limit(most + 1).collect()
    if not few:
        raise ValueError("no rows to cluster")
    if len(few) <= most:
        points = np.array(sorted(r.x for r in few), np.float64)
    elif most_leaves is None:
        leaves = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "ward-distinct")
        return _whole(leaves, leaves.count(), LAST_SETS)
    else:
        size = rows.count()
        sample = np.unique(sampled(table.where(F.col(column).isNotNull()), column, size, max(4 * most_leaves, MOST_VALUES // max(1, width(table, column))), seed), axis=0)
        points = np.unique(plus_plus(sample, min(most_leaves, len(sample)), seed), axis=0)
    sizes, costs, sums = features_of(rows, [points])[0]
    met = sizes > 0
    points, sizes, sums, costs = points[met], sizes[met], sums[met], costs[met]
    means = sums / sizes[:, None]
    # spread about the means of the summaries, from that about their representatives
    within = float((costs - sizes * ((means - points) ** 2).sum(1)).sum())
    return Ward(points, sizes, means, chain_merges(sizes, means), max(0.0, within))


def ward_sweep(table: DataFrame, ks: Iterable[int] = range(2, 11), column: str = "features") -> DataFrame:
    """(k, height, silhouette): the height of the merge that leaves k clusters, and the mean Euclidean silhouette of these; one fit for all k."""
    fitted = fit_ward(table, column)
    if isinstance(fitted, Ward):
        # the search for the nearest summary is the same for all k
        placed = materialize(fitted.placed(table, np.arange(len(fitted.sizes)), column, "_leaf"), "ward-leaves")

    def clusters(k: int) -> DataFrame:
        if isinstance(fitted, WholeWard):
            return materialize(fitted.transform(table, k, column), "ward-clusters")
        labels = F.split(F.lit(",".join(map(str, fitted.labels(k)))), ",").cast("array<int>")
        return placed.withColumn("cluster", F.get(labels, F.col("_leaf"))).drop("_leaf")

    rows = [(k, fitted.height(k), mean_euclidean_silhouette(clusters(k), column).mean) for k in ks]
    return table.sparkSession.createDataFrame(rows, "k int, height double, silhouette double")
