"""Near duplicates by SetSketch registers.

A text is the set of its word shingles, as 64-bit hashes. Its sketch has ``REGISTERS`` registers: the elements throw exponentially
distributed points on them, each register keeps its least, truncated to a whole power of ``BASE``. Sketches of two sets merge by
register-wise maxima, and two registers agree with nearly the Jaccard similarity of their sets.

1. Texts with equal sets are one class from here on (one aggregation).
2. Registers are banded. The number of registers per band is the largest for which less than one pair in a million at the least
   similarity shares no band; the number of registers grows with the logarithm of the documents, so that unrelated ones seldom meet in a bucket.
3. The classes in a bucket are compared with one of them, its leader, by the likelihood of the registers, and joined only if they may be alike.
   Those that are surely near the leader need no other comparison: whatever is linked with them is joined to the leader as well. Among the
   others, while they are not all joined to the same leader, there is another round with the next one. A bucket that is not settled after
   ``ROUNDS`` rounds, with as many unrelated texts in it, is joined as it is. Components of these edges are families.
4. A family's members are dealt into blocks; each pair of blocks is compared in one task. From the registers that are greater, less and
   equal and the exact set sizes, the similarity is estimated by maximum likelihood; pairs that come near
   the least similarity are verified on the full sets. Pairs whose texts are connected already need no link. A task returns at most as
   many links as it has members, so nothing grows with the number of pairs.
5. Components of the links are the groups.

Defined cases: a text with fewer words than a shingle is one shingle; one without words has the empty set and is linked with nothing; null counts as
empty; rows equal in id and text are one document and stay or go together; a null id is larger than all others, and component_id is
null where a group has no other; an empty table gives no rows; other columns pass through untouched. Texts of any length are one set, which
one task holds: 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.llm.common import LOWER, MULTIPLIER, column, few, fresh, map_arrow, mixed, ship, span_hashes, spans_of, stage, utf8
from tillroll.llm.graph import components

REGISTERS, BASE, RATE, TOP = 320, 1.2, 20.0, 254
#: Unrelated classes that a class meets in a bucket, on average, at most.
MEETINGS = 0.05
#: Leaders of a bucket that the others are compared with.
ROUNDS = 2
MISS = 1e-6
#: Standard errors below which less than one estimate in a million lies.
ERRORS = 4.8
#: A block has about so many members and shingles.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000

def shingles(data: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of a text's bytes, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, np.uint64)
    data = LOWER[data]
    starts, ends = spans_of(~((data == 32) | ((data >= 9) & (data <= 13))))
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashes = span_hashes(data, starts, ends)
    n = min(size, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total * MULTIPLIER + hashes[k:len(hashes) - n + 1 + k])
    return np.unique(total)


def sketch(elements: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes, one byte each.

    Each element is a Poisson process of points in time, each point on a random register; a register keeps its
    first. Points are made in blocks until none to come can be the first of any register.
    """
    first = np.full(registers, np.inf)
    active, time, step = elements, np.zeros(len(elements)), 0
    while len(active):
        n = max(1, -(-8 * registers // len(active)) if step == 0 else 2)
        salt = np.arange(step + 1, step + n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        draws = mixed(active[:, None] + salt[None, :])
        gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * registers)
        points = time[:, None] + np.cumsum(gaps, axis=1)
        place = ((draws & np.uint64(0x7FF)) * np.uint64(registers)) >> np.uint64(11)
        np.minimum.at(first, place.ravel().astype(np.int64), points.ravel())
        time, step = points[:, -1], step + n
        going = time < first.max()
        active, time = active[going], time[going]
    return np.clip(np.floor(1 - np.log(first) / np.log(BASE)), 0, TOP + 1).astype(np.uint8) if len(elements) else np.zeros(registers, np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def _exceeds(x: np.ndarray) -> np.ndarray:
    """Probability that a register is greater, from the share of elements that only its set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


GRID = np.linspace(0.0, 1.0, 101)


def estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """Most likely Jaccard similarity from counts of registers greater, less and equal in a than in b, and the set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    best, value = np.zeros(len(u)), np.full(len(u), -np.inf)
    for j in grid:
        at = np.minimum(j, most)
        up, down = _exceeds(u - v * at), _exceeds(v - u * at)
        likely = (more * np.log(np.maximum(up, 1e-9)) + less * np.log(np.maximum(down, 1e-9))
                  + equal * np.log(np.maximum(1 - up - down, 1e-9)))
        better = likely > value
        best[better], value[better] = at[better], likely[better]
    return best


def at_least(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a, n_b, t: float, step: float = 0.005) -> np.ndarray:
    """Whether the most likely similarity is ``t`` or more: the likelihood, which has one peak, still rises there."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def value(j: float) -> np.ndarray:
        up, down = _exceeds(u - v * j), _exceeds(v - u * j)
        return more * np.log(np.maximum(up, 1e-9)) + less * np.log(np.maximum(down, 1e-9)) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    return value(t + step) >= value(t - step)


def margin(similarity: float, registers: int = REGISTERS) -> float:
    """How far below the least similarity an estimate may lie for the pair to be verified: one in a million lies lower."""
    return ERRORS * (similarity * (1 - similarity) / registers) ** 0.5


def band_rows(similarity: float, registers: int = REGISTERS) -> int:
    rows = 1
    while (1 - similarity ** (rows + 1)) ** (registers // (rows + 1)) <= MISS:
        rows += 1
    return rows


def registers_for(similarity: float, documents: int) -> int:
    """Registers of a corpus: more per band, and as many bands as that needs, where unrelated documents would meet too often."""
    by_chance = float(1 - 2 * _exceeds(np.array(0.5)))
    rows = band_rows(similarity)
    count = REGISTERS
    while documents * by_chance ** rows > MEETINGS:
        rows += 1
        count = rows * int(np.ceil(np.log(MISS) / np.log1p(-similarity ** rows)))
    return count


def bounds(similarity: float, registers: int) -> tuple[float, float]:
    """Estimates from which on a class may be joined to a leader, and surely lies near it.

    With distances d = 1 - similarity, which obey the triangle inequality: linked classes are at most 1 - similarity apart. A class is near if its
    distance is at most ``close``; what is linked with it is then at most close + 1 - similarity from the leader, and joined.
    """
    close = 1 - similarity + 0.05
    farthest = close + 1 - similarity
    return 1 - farthest - margin(1 - farthest, registers), 1 - close + margin(1 - close, registers)


def _met(similarity: float):
    """Pairs (leader, node) with registers and sizes of both: whether they are joined, and near."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("own", "of_leader"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "n_leader"))
            more, less = (x > y).sum(1), (x < y).sum(1)
            least, near = bounds(similarity, x.shape[1])
            most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
            joined, close = ((most >= t) & at_least(more, less, x.shape[1] - more - less, n_a, n_b, t) for t in (least, near))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("node"), pa.array(joined), pa.array(close)], ["leader", "node", "joined", "near"])

    return run


def candidates(classes: DataFrame, bands: Column, similarity: float, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) that connect all classes (node, n_shingles, registers) that share a band and may be linked."""
    entries = classes.select("node", F.explode(bands).alias("bucket"))
    leaders = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1").select("bucket", "leader")
    met = entries.withColumn("mark", F.lit(None).cast("binary")).join(leaders, "bucket").where(F.col("node") != F.col("leader"))
    edges, sketches = [], classes.select("node", F.col("n_shingles").alias("n"), F.col("registers").alias("own"))
    for number in range(rounds + 1):
        met = stage(met, "near-met")
        pairs = met.select("leader", "node").distinct()
        if number == rounds:
            edges.append(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")))
            break
        both = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("leader"), F.col("n").alias("n_leader"), F.col("own").alias("of_leader")), "leader")
        judged = stage(map_arrow(both, _met(similarity), "leader binary, node binary, joined boolean, near boolean"), "near-judged")
        edges.append(judged.where("joined").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        # a bucket all of which is joined to its leader is settled, and only the others are looked at again
        apart = met.join(few(stage(judged.where("not joined").select("leader", "node"), "near-apart")), ["leader", "node"], "left_semi")
        unsettled = apart.select("bucket") if not number else met.select("bucket")
        unsettled = stage(unsettled.distinct(), "near-unsettled")
        if unsettled.isEmpty():
            break
        left = met.join(few(unsettled), "bucket").join(judged, ["leader", "node"]).where(~F.col("near")).withColumn(
            "mark", F.coalesce("mark", F.when(F.col("joined"), F.col("leader")))).select("node", "bucket", "mark")
        # the next leader: a class that was joined to none, if there is one
        open_ = left.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.count("mark").alias("marked"), F.min("mark").alias("low"), F.max("mark").alias("high"),
            F.min(F.struct(F.col("mark").isNotNull().alias("marked"), "node")).alias("first")).where(
            (F.col("n") > 1) & ((F.col("marked") < F.col("n")) | (F.col("low") != F.col("high")))).select("bucket", F.col("first.node").alias("leader"))
        met = left.join(open_, "bucket").where(F.col("node") != F.col("leader"))
    found = edges[0]
    for part in edges[1:]:
        found = found.unionByName(part)
    return found


def _sketches(size: int, count: int = REGISTERS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = utf8(batch.column("text"))
            digests, counts, registers = [], [], []
            seen: dict[bytes, bytes] = {}
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                found = shingles(body[a:b], size)
                digest = hashlib.blake2b(found.data, digest_size=16).digest()
                if digest not in seen:
                    seen[digest] = sketch(found, count).tobytes()
                digests.append(digest)
                counts.append(len(found))
                registers.append(seen[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())],
                ["id", "mark", "n_shingles", "node", "registers"])

    return run


def _sets(size: int, count: int = REGISTERS):
    """Full sets and registers of family members; rows of the same id but another set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = utf8(batch.column("text"))
            nodes = batch.column("node").to_pylist()
            held, size_now, first = [], 0, 0
            for i in range(len(batch)):
                found = shingles(body[ends[i]:ends[i + 1]], size)
                held.append((found.tobytes(), sketch(found, count).tobytes()))
                size_now += found.nbytes
                if size_now > 4 << 20 or i == len(batch) - 1:
                    sets, registers = zip(*held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[first:i + 1], pa.binary()), *[batch.column(c).slice(first, i + 1 - first) for c in ("root", "blocks")],
                         pa.array(sets, pa.binary()), pa.array(registers, pa.binary())], ["node", "root", "blocks", "elements", "registers"])
                    held, size_now, first = [], 0, i + 1

    return run


class _Compared:
    """The members of one task: labels of what is joined so far, and the links that joined it."""

    def __init__(self, elements: list[np.ndarray], percent: int):
        self.elements, self.percent = elements, percent
        self.n = np.array([len(e) for e in elements], np.int64)
        self.labels = np.arange(len(elements))
        self.links: list[tuple[int, int]] = []

    def linked(self, same: np.ndarray, n_a, n_b) -> np.ndarray:
        return 100 * same >= self.percent * (n_a + n_b - same)

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if self.labels[j] != self.labels[i]:
                self.labels[self.labels == self.labels[j]] = self.labels[i]
                self.links.append((i, j))

    def one_by_one(self, i: int, others: np.ndarray) -> None:
        """Intersections of one set with others, all at once."""
        if not len(others):
            return
        own, merged = self.elements[i], np.concatenate([self.elements[j] for j in others])
        at = np.searchsorted(own, merged)
        at[at == len(own)] = 0
        starts = np.concatenate(([0], np.cumsum(self.n[others])[:-1]))
        same = np.add.reduceat((own[at] == merged).astype(np.int64), starts)
        self.join(i, others[self.linked(same, self.n[i], self.n[others])])

    def all_at_once(self, rows: np.ndarray, shared: tuple[np.ndarray, np.ndarray, int], open_pairs: np.ndarray) -> None:
        """Intersections of all pairs as products of 0-1 matrices, some thousand elements at a time."""
        members, columns, width = shared
        same = np.zeros((len(rows), len(rows)), np.float32)
        for start in range(0, width, SLAB):
            inside = (columns >= start) & (columns < start + SLAB)
            dense = np.zeros((len(rows), min(SLAB, width - start)), np.float32)
            dense[members[inside], columns[inside] - start] = 1
            same += dense @ dense.T
        n = self.n[rows]
        linked = open_pairs & self.linked(same.astype(np.int64), n[:, None], n[None, :])
        for k in np.flatnonzero(linked.any(1)).tolist():
            self.join(int(rows[k]), rows[np.flatnonzero(linked[k])])


HUBS, SLAB = 8, 4_096


def verified_links(elements: list[np.ndarray], registers: np.ndarray, percent: int, left: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all pairs (one of them at least from ``left``) with 100 * intersection >= percent * union.

    Not every such pair is returned, but one path between any two texts that such pairs connect. The best connected
    texts are compared first, for they join most others; then all pairs that are likely and still apart, set by
    set or as a matrix product, whichever is less work. Both are exact.
    """
    found = _Compared(elements, percent)
    n, count = found.n, len(elements)
    likely = np.zeros((count, count), bool)
    for i in range(count - 1):
        others = i + 1 + np.flatnonzero((100 * np.minimum(n[i + 1:], n[i]) >= percent * np.maximum(n[i + 1:], n[i])) & (left[i + 1:] | left[i]))
        if len(others):
            more = (registers[i] > registers[others]).sum(1)
            less = (registers[i] < registers[others]).sum(1)
            likely[i, others] = at_least(more, less, registers.shape[1] - more - less, n[i].astype(float), n[others].astype(float), percent / 100 - margin(percent / 100, registers.shape[1]))
    likely |= likely.T
    for i in np.argsort(-likely.sum(1), kind="stable")[:HUBS].tolist():
        found.one_by_one(i, np.flatnonzero(likely[i] & (found.labels != found.labels[i])))
        likely[i] = likely[:, i] = False
    apart = likely & (found.labels[:, None] != found.labels[None, :])
    rows = np.flatnonzero(apart.any(1))
    if not len(rows):
        return found.links
    values, columns, often = np.unique(np.concatenate([elements[i] for i in rows]), return_inverse=True, return_counts=True)
    members = np.repeat(np.arange(len(rows)), n[rows])
    kept = often[columns] > 1  # what stands in one set only is in no intersection
    places = np.cumsum(often > 1) - 1
    width = int((often > 1).sum())
    apart = apart[np.ix_(rows, rows)]
    if len(rows) ** 2 * width * 1e-10 < (apart @ n[rows]).sum() / 2 * 6e-8:
        found.all_at_once(rows, (members[kept], places[columns[kept]], width), apart)
    else:
        for k, i in enumerate(rows.tolist()):
            found.one_by_one(i, rows[k + 1:][apart[k, k + 1:] & (found.labels[rows[k + 1:]] != found.labels[i])])
    return found.links


def _compare(percent: int):
    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.drop_duplicates("node").reset_index(drop=True)
        elements = [np.frombuffer(e, np.uint64) for e in members["elements"]]
        registers = np.frombuffer(b"".join(members["registers"]), np.uint8).reshape(len(members), -1)
        left = (members["block"] == members["one"]).to_numpy()
        links = verified_links(elements, registers, percent, left)
        nodes = members["node"].tolist()
        return pd.DataFrame({"a": [nodes[i] for i, _ in links], "b": [nodes[j] for _, j in links]})

    return run


def groups(docs: DataFrame, identity: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sketched rows (id, mark, n_shingles, node), and the root of each node that is linked with another."""
    rows = docs.select(column(docs, identity).alias("id"), _mark(column(docs, text)).alias("mark"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    count = registers_for(percent / 100, rows.count())
    table = stage(map_arrow(rows, _sketches(size, count), f"id {kind}, mark long, n_shingles long, node binary, registers binary"), "near-sketches")
    full = table.where(F.col("n_shingles") > 0)
    # one row per class of equal sets; any of its texts stands for it
    classes = stage(full.groupBy("node").agg(F.min(F.struct("id", "mark", "n_shingles")).alias("one"), F.min("registers").alias("registers"))
                    .select("node", "one.*", "registers"), "near-classes")
    rows_per_band = band_rows(percent / 100, count)
    bands = F.transform(F.sequence(F.lit(0), F.lit(count // rows_per_band - 1)), lambda i: F.xxhash64(
        i, F.substring("registers", i * rows_per_band + 1, F.lit(rows_per_band))))
    families = stage(components(candidates(classes, bands, percent / 100)), "near-families")
    members = stage(families.join(classes.select("node", "id", "mark", "n_shingles"), "node"), "near-members")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = stage(members.join(sizes, "root").select(F.col("id").alias("of"), F.col("mark").alias("marked"), "node", "root", "blocks"), "near-wanted")
    found = rows.join(few(wanted), F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("marked"))).select("text", "node", "root", "blocks")
    sets = map_arrow(found, _sets(size, count), "node binary, root binary, blocks int, elements binary, registers binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("root", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "elements", "registers")
    ship(pairs.sparkSession)
    links = stage(pairs.groupBy("root", "one", "two").applyInPandas(_compare(percent), "a binary, b binary"), "near-links")
    return table, components(links)


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def decide(docs: DataFrame, identity: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, mark (hash of the text), n_shingles, component_id, kept."""
    table, roots = groups(docs, identity, text, size, percent)
    rows = table.select("id", "mark", "n_shingles", "node")
    # nulls last: a class's and a group's first document
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))
    classes = rows.where(F.col("n_shingles") > 0).groupBy("node").agg(first.alias("first")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stage(classes, "near-firsts")
    best = classes.groupBy("root").agg(F.min("first").alias("best"))
    of = classes.join(best, "root").select("node", "best")
    joined = rows.join(of, (rows["node"] == of["node"]) & (rows["n_shingles"] > 0), "left")
    alone = F.col("best").isNull()
    return joined.select(
        F.col("id").alias(identity), "mark", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")))).alias("kept"))


def deduplicate(docs: DataFrame, identity: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group."""
    gone = decide(docs, identity, text, size, percent).where(~F.col("kept")).select(F.col(f"`{identity}`").alias("of"), "mark").distinct()
    names = fresh(docs, "gone_id", "gone_mark")
    gone = stage(gone.toDF(*names), "near-gone")
    same = column(docs, identity).eqNullSafe(F.col(names[0])) & (_mark(column(docs, text)) == F.col(names[1]))
    return docs.join(few(gone), same, "left_anti")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
