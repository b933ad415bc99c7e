"""Oversampling of small classes with synthetic rows between near neighbours (SMOTE)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.rows import numbered_copies
from tillroll.functions.vectors import MOST_VALUES, sampled, width
from tillroll.operators.cluster import side_by_side
from tillroll.operators.order_stats import pairs_at
from tillroll.session import materialize

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 2_000   # rows of a block
SAMPLED = 64         # sampled rows per block, to cut the blocks
SEEKERS = 256        # rows that look at a block at a time
MOST_ROWS = 50_000   # rows of a class that :func:`bounded` keeps

#: A stored block; numbers as bytes.
BLOCK = {"at": "long", "ids": "binary", "points": "binary", "reach": "binary", "most": "double", "low": "array<double>", "high": "array<double>",
         "seekers": "binary", "members": "binary", "gaps": "binary", "picks": "binary"}

FOUND = "id long, neighbour long, x array<double>, distance double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _first(k: int, seekers: np.ndarray, members: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Places of the k nearest members of each seeker, the least ids on ties."""
    order = np.lexsort((members, gap, seekers))
    starts = np.flatnonzero(np.r_[True, np.diff(seekers[order]) != 0]) if len(order) else order
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k]


def _within(points: np.ndarray, ids: np.ndarray, reach: np.ndarray, x: np.ndarray, member_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(id, neighbour, distance, place of the neighbour in ``x``) of at most k members for each point, none farther than its ``reach``."""
    found = []
    norms = (x * x).sum(1)
    for start in range(0, len(points), SEEKERS):
        p, own, far = points[start:start + SEEKERS], ids[start:start + SEEKERS], reach[start:start + SEEKERS]
        size = (p * p).sum(1)[:, None] + norms
        rows, picks = np.nonzero(size - 2 * (p @ x.T) <= (far * far)[:, None] + 1e-9 * size)
        gap = np.sqrt(((p[rows] - x[picks]) ** 2).sum(1))
        near = (gap <= far[rows]) & (own[rows] != member_ids[picks])
        rows, picks, gap = rows[near], picks[near], gap[near]
        first = _first(k, own[rows], member_ids[picks], gap)
        found.append((own[rows][first], member_ids[picks][first], gap[first], picks[first]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _halves(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A tree of about ``leaves`` cells: (feature, threshold) of each inner node, halved where the sample is widest; -1 for a leaf.
    The children of node i are 2 i + 1 and 2 i + 2."""
    depth = max(0, leaves - 1).bit_length()
    tree = [(-1, 0.0)] * (2 ** (depth + 1) - 1)
    inside = {0: sample}
    for node in range(2 ** depth - 1):
        own = inside.pop(node, sample[:0])
        if len(own) < 2:
            continue
        widths = np.quantile(own, 0.9, axis=0) - np.quantile(own, 0.1, axis=0)
        j = int(widths.argmax()) if widths.max() > 0 else int(np.ptp(own, axis=0).argmax())
        middle = float(np.median(own[:, j]))
        if (own[:, j] <= middle).all():
            middle = float((own[:, j].min() + own[:, j].max()) / 2)
        low = own[:, j] <= middle
        if low.all() or not low.any():
            continue
        tree[node] = (j, middle)
        inside[2 * node + 1], inside[2 * node + 2] = own[low], own[~low]
    return tree


def _cell_of(tree: list[tuple[int, float]]):
    features, thresholds = np.array([j for j, _ in tree]), np.array([t for _, t in tree])

    @F.pandas_udf("int")
    def cell(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series(np.empty(0, np.int32))
        x = _matrix(values)
        node = np.zeros(len(x), np.int32)
        for _ in range(len(tree).bit_length()):
            j = features[node]
            node = np.where(j < 0, node, 2 * node + 1 + (x[np.arange(len(x)), j] > thresholds[node])).astype(np.int32)
        return pd.Series(node)

    return cell


def _packed(k: int):
    """One row for a block of points: its points, the k nearest of each inside it, how far others may be, and its box."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf.x), pdf.id.to_numpy(np.int64)
        usable = np.isfinite(x).all(1)  # nothing is near the others
        x, ids = x[usable], ids[usable]
        if not len(x):
            return pd.DataFrame({c: [] for c in BLOCK})
        parts = []
        for start in range(0, len(x), SEEKERS):
            p, own = x[start:start + SEEKERS], ids[start:start + SEEKERS]
            apart = (p * p).sum(1)[:, None] - 2 * (p @ x.T) + (x * x).sum(1)
            apart[own[:, None] == ids[None, :]] = np.inf
            width = min(k, len(ids)) - 1
            rough = np.partition(apart, width, axis=1)[:, width]
            reach = np.sqrt(np.maximum(rough, 0)) * (1 + 1e-6) + 1e-6 * np.sqrt((p * p).sum(1) + (x * x).sum(1).max())
            parts.append(_within(p, own, reach, x, ids, k))
        seekers, members, gap, picks = (np.concatenate(c) for c in zip(*parts))
        first = _first(k, seekers, members, gap)
        seekers, members, gap, picks = seekers[first], members[first], gap[first], picks[first]
        farthest = pd.DataFrame({"id": seekers, "gap": gap}).groupby("id").gap.agg(["max", "size"]).reindex(ids)
        reach = np.where(farthest["size"].to_numpy() == k, farthest["max"].to_numpy(), np.inf)
        return pd.DataFrame({"at": [int(ids.min())], "ids": [ids.tobytes()], "points": [x.tobytes()], "reach": [reach.tobytes()], "most": [float(reach.max())],
                             "low": [x.min(0)], "high": [x.max(0)], "seekers": [seekers.tobytes()], "members": [members.tobytes()], "gaps": [gap.tobytes()],
                             "picks": [picks.tobytes()]})
    return run


def _rows(seekers: np.ndarray, members: np.ndarray, gap: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seekers, pa.int64()), pa.array(members, pa.int64()), pa.array(list(x), pa.list_(pa.float64())),
                                       pa.array(gap, pa.float64())], ["id", "neighbour", "x", "distance"])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours found inside the blocks."""
    for batch in batches:
        for r in batch.to_pylist():
            points = np.frombuffer(r["points"]).reshape(len(r["ids"]) // 8, -1)
            yield _rows(np.frombuffer(r["seekers"], np.int64), np.frombuffer(r["members"], np.int64), np.frombuffer(r["gaps"]),
                        points[np.frombuffer(r["picks"], np.int64)])


def _across(k: int):
    """Neighbours in other blocks; of those that a task finds for the points of one block, the k nearest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def best() -> Iterator[pa.RecordBatch]:
            if held:
                seekers, members, gap, x = (np.concatenate(c) for c in zip(*held))
                first = _first(k, seekers, members, gap)
                yield _rows(seekers[first], members[first], gap[first], x[first])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("at", "ids", "points", "reach", "other_ids", "other_points", "other_low", "other_high")}
                if r["at"] != at:
                    yield from best()
                    held, at = [], r["at"]
                ids, member_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["other_ids"], np.int64)
                points, x = np.frombuffer(r["points"]).reshape(len(ids), -1), np.frombuffer(r["other_points"]).reshape(len(member_ids), -1)
                reach = np.frombuffer(r["reach"])
                apart = np.maximum(np.maximum(np.array(r["other_low"]) - points, points - np.array(r["other_high"])), 0.0)
                asking = (apart * apart).sum(1) <= reach * reach * (1 + 1e-9)
                if asking.any():
                    *found, picks = _within(points[asking], ids[asking], reach[asking], x, member_ids, k)
                    held.append((*found, x[picks]))
        yield from best()

    return run


def nearest_neighbours(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest other points: (id, neighbour, x, distance, place).

    ``points``: unique ``id`` BIGINT and ``x`` ARRAY<DOUBLE>, stored. Of equal points only
    k + 1 are searched, as the neighbours of the others are among these at distance 0.
    """
    copy = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    kept = materialize(points.select("id", "x").withColumn("copy", copy).where(F.col("copy") <= k + 1), "kept")
    near = _search(kept.select("id", "x"), k, block_rows)
    crowd = points.select("id", "x").join(kept.select("id"), "id", "left_anti")
    beside = kept.where(F.col("copy") <= k).select(F.col("id").alias("neighbour"), "x", F.col("copy").alias("place"))
    return near.unionByName(crowd.join(beside, "x").select(
        "id", "neighbour", "x", F.lit(0.0).alias("distance"), "place"))


def _search(points: DataFrame, k: int, block_rows: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return _candidates(points, k, block_rows).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _candidates(points: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, neighbour, x, distance): the k nearest points of each are among these.

    Points near each other form blocks of about ``block_rows``, cut at the medians of a bounded sample, and are shuffled once. The neighbours inside
    a block say how far those in other blocks may be; a block meets only those whose box is so near, and sends on only what is not
    farther. Blocks meet in a product of stored tables, which shuffles nothing; its time still grows with the square of the blocks that are near.
    """
    points = points.where("id is not null")
    n = points.count()
    blocks = max(1, -(-n // block_rows))
    most = max(1, min(MOST_VALUES // max(1, width(points, "x")), max(10_000, SAMPLED * blocks)))
    tree = _halves(sampled(points, "x", n, most, 0), blocks) if blocks > 1 else [(-1, 0.0)]
    placed = points.select("id", "x", _cell_of(tree)("x").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = materialize(dealt.groupBy("cell", "part").applyInPandas(_packed(k), ", ".join(f"{c} {kind}" for c, kind in BLOCK.items())), "blocks")
    inside = packed.select("ids", "points", "seekers", "members", "gaps", "picks").mapInArrow(_inside, FOUND)
    if blocks == 1:
        return inside
    here = packed.select("at", "ids", "points", "reach", "most", "low", "high")
    there = packed.select(*[F.col(c).alias(f"other_{c}") for c in ("at", "ids", "points", "low", "high")])
    gaps = F.zip_with(F.zip_with("low", "other_high", lambda a, b: a - b), F.zip_with("other_low", "high", lambda a, b: a - b),
                      lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)
    met = here.join(there, (F.col("at") != F.col("other_at")) & (apart <= F.col("most") * F.col("most") * (1 + 1e-9)))
    met = met.select("at", "ids", "points", "reach", "other_ids", "other_points", "other_low", "other_high")
    return inside.unionByName(met.mapInArrow(_across(k), FOUND))


def bounded(table: DataFrame, most: int = MOST_ROWS, key: str = "CustomerID", label: str = "label", seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each class, those with the least hashes, for callers that ask for a bound on the rows to fit on.

    ``table`` is stored and read several times. Classes that are small enough stay whole.
    """
    h = F.xxhash64(F.lit(seed), F.col(key).cast("bigint"))
    counts = {r[label]: r.n for r in table.groupBy(label).agg(F.count("*").alias("n")).collect()}
    kept = F.lit(True)
    for value in sorted(v for v, n in counts.items() if n > most):
        own = table.where(F.col(label) == value).select(h.alias("h"), F.col(key).cast("bigint").alias("id"))
        last, at = pairs_at(own, "h", "id", lambda _: [most - 1])[0]
        first = (h < last) | ((h == last) & (F.col(key).cast("bigint") <= at))
        kept = F.when(F.col(label) == value, first).otherwise(kept)
    return table.where(kept)


def smote(table: DataFrame, k: int = 5, seed: int = 0, key: str = "CustomerID",
          label: str = "label", features: str = "features") -> DataFrame:
    """(label, features, synthetic): all rows, and synthetic ones until classes are equal.

    Each synthetic row lies between a real row and one of its k nearest neighbours of the
    same class; both choices and the position come from hashes of the seed. ``table``
    is read several times.
    """
    counts = {r[label]: r.n for r in table.groupBy(label).agg(F.count("*").alias("n")).collect()}
    most = max(counts.values(), default=0)
    lone = [value for value, n in counts.items() if n == 1 < most]
    if lone:
        raise ValueError(f"classes with a single row have no neighbours: {lone}")

    def grow(value) -> DataFrame:
        rows = table.where(F.col(label) == value).select(
            F.col(key).cast("bigint").alias("id"), vector_to_array(features).alias("x"),
            F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("bigint")), 2).alias("h"))
        rows = materialize(rows, "class")
        made = _between(rows, counts[value], most - counts[value], min(k, counts[value] - 1), seed)
        return made.select(F.lit(value).cast(table.schema[label].dataType).alias(label),
                           array_to_vector("made").alias(features), F.lit(True).alias("synthetic"))

    result = table.select(label, features, F.lit(False).alias("synthetic"))
    for made in side_by_side(grow, sorted(v for v, n in counts.items() if n < most)):
        result = result.unionByName(made)
    return result.hint("rebalance")  # fits read it many times: even partitions, no tiny ones


def _between(rows: DataFrame, n: int, missing: int, width: int, seed: int) -> DataFrame:
    """``missing`` new points ``made`` between rows and their neighbours.

    Rows take turns: everyone gets missing // n copies, the first missing % n in hash
    order one more. The place of the last of these is found by counting, not by sorting.
    """
    near = nearest_neighbours(rows.select("id", "x"), width)
    copies = F.lit(missing // n)
    if missing % n:
        h, last = pairs_at(rows, "h", "id", lambda _: [missing % n - 1])[0]
        first = (F.col("h") < h) | ((F.col("h") == h) & (F.col("id") <= last))
        copies = copies + first.cast("int")
    turns = rows.select("id", F.col("x").alias("base"), copies.alias("copies"))
    drawn = numbered_copies(turns, 1, F.col("copies"), "copy")
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("copy")), F.lit(width)) + 1
    position = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id"), F.col("copy")), F.lit(1 << 30)) / (1 << 30)
    drawn = drawn.withColumns({"place": pick.cast("int"), "u": position})
    return (drawn.join(near.select("id", "place", "x"), ["id", "place"])
            .select(F.zip_with("base", "x", lambda a, b: a + (b - a) * F.col("u")).alias("made")))
