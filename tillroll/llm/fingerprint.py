"""Document fingerprints of improbable features.

Each window of ``WINDOW`` bytes of a text is a feature. Features are ranked by how rare the entropy of their bytes is among all windows of all
documents, the rarest first, those of hardly any entropy last. Of every ``NEIGHBOURS`` consecutive features of a text the leftmost of the least
rank gets a point, and features with ``POINTS`` of them are selected: what a reader would call the unusual places. A text in which none gets
so many has the one with the most (the leftmost), a text shorter than a window is one feature, an empty one has none.

Selected features set five bits each in Bloom filters of 256 bytes, in the order of the text, ``MOST`` features to a filter, then the next
one. Two fingerprints are alike by the overlap of their bits: what two filters share beyond chance, as a share of what they could share; for each
filter of the shorter chain the best filter of the other one counts, weighted by its features. Overlap within four standard deviations of chance is none.

All counts are whole numbers, so a fingerprint does not depend on how texts are dealt. One pass counts entropies (1,001 numbers reach the driver); another
one brings neighbours together, texts packed, in ranges by descending id: the next document is the next row of a task, and only a task's first and
last rows are joined across tasks.

Defined cases: null counts as the empty text; two empty texts are alike (1), an empty one and another are not (0); rows equal in id are ordered by a
hash of their text, repeated rows are each other's next; a null id is the smallest; a lone document is its own next; an empty table gives no
rows; texts of any length are cut into overlapping pieces with the same result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.common import column, fresh, keyed, map_arrow, mixed, stage, utf8

WINDOW = 64
NEIGHBOURS = 64
POINTS = 16
#: Entropies in thousandths of the most a window can have; windows below LOW come after all others.
BINS = 1_001
LOW = 100
#: Features of a filter, bits of it, and bits that a feature sets.
MOST, BITS, SET = 160, 2048, 5
#: Bytes that are looked at together.
BLOCK = 1 << 18
_SCALE = 1 << 20
_PLACES = 20
_NONE = np.uint32(0xFFFFFFFF)
_counts = np.arange(1, WINDOW + 1)
#: n log2 n for n equal bytes of a window, and what one more adds.
AMOUNT = np.concatenate(([0], np.rint(_counts * np.log2(_counts) * _SCALE))).astype(np.int64)
MORE = np.diff(AMOUNT)


def entropies(body: np.ndarray) -> np.ndarray:
    """Bin of the entropy of every window of ``body``, from one to the next by the byte that leaves and the byte that enters."""
    n = len(body) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(body), np.uint8), np.zeros(len(body), np.uint8)  # equal bytes among the 63 on either side
    for k in range(1, WINDOW):
        same = (body[k:] == body[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    first = int(AMOUNT[np.bincount(body[:WINDOW], minlength=256)].sum())
    change = MORE[before[WINDOW:]] - MORE[after[:n - 1]]
    total = first + np.concatenate((np.zeros(1, np.int64), np.cumsum(change)))
    return (BINS - 1) - total * (BINS - 1) // int(AMOUNT[WINDOW])


def ranked(counts: np.ndarray) -> np.ndarray:
    """Rank of each bin: the rarest first, ties by bin, bins of little entropy last."""
    bins = np.arange(BINS)
    ranks = np.empty(BINS, np.uint32)
    ranks[np.lexsort((bins, counts, bins < LOW))] = bins
    return ranks


def _points(body: np.ndarray, limit: np.ndarray | int, windows: int, ranks: np.ndarray) -> np.ndarray:
    """Points of each place; features start up to ``limit``, and the first ``windows`` places begin a neighbourhood if they are features."""
    n = len(body)
    key = np.full(n + NEIGHBOURS - 1, _NONE)
    found = entropies(body)
    key[:len(found)] = ranks[found] << np.uint32(_PLACES) | np.arange(len(found), dtype=np.uint32)
    valid = np.arange(n) <= limit
    key[:n][~valid] = _NONE
    width = 1
    while width < NEIGHBOURS:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    winners = key[:windows][valid[:windows]] & np.uint32((1 << _PLACES) - 1)
    return np.bincount(winners, minlength=n)


def selected(body: np.ndarray, ends: np.ndarray, ranks: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Places of the selected features of texts in a row, and the text of each; texts shorter than a window have none."""
    sizes = np.diff(ends)
    points = np.zeros(len(body), np.uint8)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + block, "right")) - 1)
        a, b = int(ends[first]), int(ends[last])
        if b - a <= block:
            limit = np.repeat(ends[first + 1:last + 1] - a - WINDOW, sizes[first:last])
            points[a:b] += _points(body[a:b], limit, b - a, ranks).astype(np.uint8)
        else:  # one long text, in pieces that see as far as their last neighbourhood does
            for start in range(a, b - WINDOW + 1, block):
                stop = min(b, start + block + NEIGHBOURS + WINDOW - 2)
                piece = body[start:stop]
                points[start:stop] += _points(piece, len(piece) - WINDOW, min(block, b - WINDOW + 1 - start), ranks).astype(np.uint8)
        first = last
    places = np.flatnonzero(points >= POINTS)
    texts = np.searchsorted(ends, places, "right") - 1
    none = np.flatnonzero((np.bincount(texts, minlength=len(sizes)) == 0) & (sizes >= WINDOW))
    if len(none):
        best = np.array([ends[t] + int(points[ends[t]:ends[t + 1]].argmax()) for t in none], np.int64)
        places, texts = np.concatenate((places, best)), np.concatenate((texts, none))
        order = np.argsort(places)
        places, texts = places[order], texts[order]
    return places, texts


def hashes(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of WINDOW bytes."""
    words = np.ascontiguousarray(windows).view("<u8").astype(np.uint64)
    value = np.full(len(windows), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        value = mixed(value ^ words[:, i]) + np.uint64(i)
    return value


class Fingerprint:
    """A chain of Bloom filters and the number of features in each."""

    __slots__ = ("sizes", "filters")

    def __init__(self, sizes: np.ndarray, filters: np.ndarray):
        self.sizes, self.filters = sizes, filters

    def __str__(self) -> str:
        packed = np.concatenate((self.sizes.astype(">u2").view(np.uint8).reshape(-1, 2), self.filters), axis=1)
        return base64.b64encode(packed.tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        packed = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 2 + BITS // 8)
        return cls(packed[:, :2].copy().view(">u2").ravel().astype(np.int64), packed[:, 2:])


def fingerprints_of(body: np.ndarray, ends: np.ndarray, ranks: np.ndarray, block: int = BLOCK) -> list[Fingerprint]:
    """Fingerprints of texts in a row."""
    n, sizes = len(ends) - 1, np.diff(ends)
    places, texts = selected(body, ends, ranks, block)
    found = hashes(body[places[:, None] + np.arange(WINDOW)]) if len(places) else np.zeros(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(short):
        rows = np.zeros((len(short), WINDOW), np.uint8)
        for row, t in zip(rows, short):
            row[:sizes[t]] = body[ends[t]:ends[t + 1]]
        texts = np.concatenate((texts, short))
        found = np.concatenate((found, hashes(rows) + sizes[short].astype(np.uint64)))
        order = np.argsort(texts, kind="stable")
        texts, found = texts[order], found[order]
    # a feature that a text repeats counts once, where it comes first
    order = np.lexsort((np.arange(len(found)), found, texts))
    again = np.concatenate(([False], (texts[order][1:] == texts[order][:-1]) & (found[order][1:] == found[order][:-1]))) if len(found) else np.zeros(0, bool)
    once = np.ones(len(found), bool)
    once[order[again]] = False
    texts, found = texts[once], found[once]
    counts = np.bincount(texts, minlength=n)
    chains = -(-counts // MOST)
    heads = np.concatenate(([0], np.cumsum(chains)))
    filters = heads[texts] + (np.arange(len(texts)) - np.concatenate(([0], np.cumsum(counts)))[texts]) // MOST
    bits = np.zeros((int(heads[-1]), BITS), np.uint8)
    for i in range(SET):
        bits[filters, (found >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    held = np.bincount(filters, minlength=int(heads[-1]))
    return [Fingerprint(held[a:b], packed[a:b]) for a, b in zip(heads[:-1].tolist(), heads[1:].tolist())]


def likeness(left: Fingerprint, right: Fingerprint) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if left.filters.tobytes() == right.filters.tobytes():
        return 1.0
    if not len(left.sizes) or not len(right.sizes):
        return 0.0
    small, large = (left, right) if len(left.sizes) <= len(right.sizes) else (right, left)
    of_large = np.bitwise_count(large.filters).sum(axis=1).astype(np.float64)
    total = 0.0
    for size, one in zip(small.sizes.tolist(), small.filters):
        own = float(np.bitwise_count(one).sum())
        shared = np.bitwise_count(one & large.filters).sum(axis=1).astype(np.float64)
        chance = own * of_large / BITS
        most = np.minimum(own, of_large)
        beyond = (shared > chance + 4 * np.sqrt(chance) + 1) & (most > chance)
        total += size * float(np.where(beyond, (shared - chance) / np.where(beyond, most - chance, 1), 0.0).max())
    return min(1.0, total / float(small.sizes.sum()))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, np.int64)
    for batch in batches:
        body, ends = utf8(batch.column("text"))
        # windows of a text are those that start WINDOW bytes or more before its end
        limit = np.repeat(ends[1:] - WINDOW, np.diff(ends))
        for start in range(0, len(body), BLOCK):
            found = entropies(body[start:start + BLOCK + WINDOW - 1])
            inside = np.arange(start, start + len(found)) <= limit[start:start + len(found)]
            counts += np.bincount(found[inside], minlength=BINS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["bin", "n"])


def ranks_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of entropies among all windows of all documents."""
    counts = np.zeros(BINS, np.int64)
    for r in map_arrow(docs.select(column(docs, text).alias("text")), _histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    return ranked(counts)


def _prints(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, ends = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([str(p) for p in fingerprints_of(body, ends, ranks)], pa.string())], ["id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """id and fingerprint of every row; with ``ranks`` of another corpus, its fingerprints compare with that corpus'."""
    ranks = ranks_of(docs, text) if ranks is None else ranks
    rows = docs.select(column(docs, identity).alias("id"), column(docs, text).alias("text"))
    return map_arrow(rows, _prints(ranks), f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", identity)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        body, ends = utf8(batch.column("text"))
        texts = [codec.compress(body[a:b], asbytes=True) if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        kept = [batch.column(c) for c in ("id", "tie", "row")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends), pa.int64()), pa.array(texts, pa.binary())], ["id", "tie", "row", "size", "packed"])


RESULT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Rows whose next one is known, the last row of a task, and the first one as the next of another task's last.
DONE, LAST, FIRST = 0, 1, 2


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(held: list[tuple], ranks: np.ndarray) -> list[tuple]:
    """Results for all of (id, text, fingerprint) but the last."""
    texts = [edited(a[1], b[1]).encode() for a, b in zip(held, held[1:])]
    prints = fingerprints_of(*_joined(texts), ranks)
    return [(a[0], len(a[1]), hashlib.sha256(t).hexdigest(), str(a[2]), str(p), likeness(a[2], p), likeness(a[2], b[2]))
            for a, b, t, p in zip(held, held[1:], texts, prints)]


def _neighbours(ranks: np.ndarray, kind: pa.DataType):
    names = [*RESULT, "part", "kind", "size", "packed"]
    kinds = [kind, *KINDS, pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, held = pa.Codec("zstd", compression_level=1), TaskContext.get().partitionId(), None

        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def edge(which, identity, text):
            raw = text.encode()
            return (identity, *[None] * 6, part, which, len(raw), codec.compress(raw, asbytes=True) if raw else b"")

        for batch in batches:
            waiting, size = [], 0
            for at in range(len(batch)):
                n = batch.column("size")[at].as_py()
                raw = codec.decompress(batch.column("packed")[at].as_py(), n, asbytes=True) if n else b""
                waiting.append((batch.column("id")[at].as_py(), raw))
                size += n
                if size < BLOCK and at + 1 < len(batch):
                    continue
                prints = fingerprints_of(*_joined([w[1] for w in waiting]), ranks)
                now = [(identity, raw.decode(), p) for (identity, raw), p in zip(waiting, prints)]
                out = [edge(FIRST, *now[0][:2])] if held is None else []
                row = ([] if held is None else [held]) + now
                out += [(*r, part, DONE, None, None) for r in _rows(row, ranks)]
                held, waiting, size = now[-1], [], 0
                if out:
                    yield given(out)
        if held is not None:
            yield given([edge(LAST, *held[:2])])

    return run


def _edges(ranks: np.ndarray, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pair = [codec.decompress(r[p], r[s], asbytes=True) if r[s] else b"" for p, s in (("packed", "size"), ("next_packed", "next_size"))]
                prints = fingerprints_of(*_joined(pair), ranks)
                rows += _rows([(r["id"], pair[0].decode(), prints[0]), (None, pair[1].decode(), prints[1])], ranks)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [kind, *KINDS])], RESULT)

    return run


def with_next(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against the next one, by descending id, and against itself with its second half replaced by that one's first.

    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ranks = ranks_of(docs, text)
    (row,) = fresh(docs, "row")
    table = keyed(docs, row)
    rows = table.select(column(table, identity).alias("id"), column(table, text).alias("text"), F.col(row).alias("row"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    field = rows.schema["id"].dataType
    kind, simple = to_arrow_type(field), field.simpleString()
    packed = map_arrow(rows, _packed, f"id {simple}, tie long, row struct<file:long,at:long>, size long, packed binary")
    order = [F.desc_nulls_last("id"), F.desc("tie"), F.asc("row")]
    dealt = packed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "size", "packed")
    names = "id {0}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double".format(simple)
    found = stage(map_arrow(dealt, _neighbours(ranks, kind), names + ", part long, kind long, size long, packed binary"), "fingerprint-rows")
    # one first and one last row per task: the last one's next is the first of the next task that has rows, or of the first task
    first, last = (found.where(F.col("kind") == k).select("part", "id", "size", "packed") for k in (FIRST, LAST))
    everywhere = Window.orderBy("part")
    follows = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(everywhere), F.min("part").over(Window.partitionBy())))
    pairs = last.join(follows, "part").join(first.select(F.col("part").alias("next"), F.col("size").alias("next_size"), F.col("packed").alias("next_packed")), "next")
    edges = map_arrow(pairs.select("id", "size", "packed", "next_size", "next_packed"), _edges(ranks, kind), names)
    return found.where(F.col("kind") == DONE).select(*RESULT).unionByName(edges).withColumnRenamed("id", identity)


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
