"""Repeated passages by content-defined chunks.

Texts are cut at peaks of a gear rolling hash. A cut depends on the bytes around it alone, so a passage is cut into the same
chunks wherever it stands, and an insertion changes the chunks next to it only. Chunks are known by a digest of 128 bits. All occurrences of
a digest but the first are repeats. Whole chunks leave out what a repeat shares with the first occurrence beyond its outer cuts, so
repeats in a row are extended on both sides over the words that stand there too: cuts depend on 24 bytes before and 16 after, and
chunks are longer than 16 bytes, so three chunks on either side hold all of it. Extended repeats that touch are one passage if they
hold at least ``LEAST_WORDS`` words. The order of occurrences is id, text digest, place.

All chunks are shuffled once, to the task of their digest, which finds the first occurrence and hands on the others. The occurrences
of one digest so meet in one task, some 40 bytes each; they are sorted and held on disk where memory does not do. Texts are
read again only where a repeat or its first occurrence stands.

Defined cases: null counts as empty; texts shorter than a passage have none; rows equal in id and text are one document and
don't repeat each other; a null id is the smallest; a passage found twice in one
document is a repeat at its second place; an empty table gives no rows; other columns pass through ``remove`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillroll.llm.common import column, fresh, map_arrow, stage, utf8
from tillroll.llm.gear import peaks

WINDOW, AROUND, LONGEST = 8, 16, 4096
LEAST_WORDS = 25
#: Chunks on either side that a repeat is extended over at most; cuts that only one of two equal places has are fewer.
BESIDE = 3
BEFORE, AFTER = 0, 1
BLANKS = frozenset(" \t\n\x0b\x0c\r")
#: Chunks that a task hands over at a time.
HANDOVER = 50_000

EVERY = {"id": None, "twin": pa.int64(), "place": pa.int32(), "high": pa.int64(), "low": pa.int64()}


def _white(body: np.ndarray) -> np.ndarray:
    return (body == 32) | ((body >= 9) & (body <= 13))


def _counted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and begun words before each byte and the end."""
    inside = ~_white(data)
    begun = inside & np.concatenate(([True], ~inside[:-1]))
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))), np.concatenate(([0], np.cumsum(begun)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all chunks, by place; where they begin is counted for the ends of runs only, when the text is read again."""
    for batch in batches:
        body, ends = utf8(batch.column("text"))
        ids = batch.column("id")
        twins = batch.column("twin").to_numpy()
        held: list[tuple] = []
        count = 0
        for i in range(len(batch)):
            data = body[ends[i]:ends[i + 1]]
            if not len(data):
                continue
            cut = peaks(data, WINDOW, AROUND, LONGEST)
            raw = data.tobytes()
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]),
                                    np.int64).reshape(-1, 2)
            held.append((np.full(len(cut), i), np.full(len(cut), twins[i]), np.arange(len(cut)), digests[:, 0], digests[:, 1]))
            count += len(cut)
            if count >= HANDOVER:
                yield _handed(held, ids)
                held, count = [], 0
        if held:
            yield _handed(held, ids)


def _handed(held: list[tuple], ids: pa.Array) -> pa.RecordBatch:
    columns = dict(zip(EVERY, (np.concatenate(c) for c in zip(*held))))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(c)) if n == "id" else pa.array(c).cast(EVERY[n]) for n, c in columns.items()], list(EVERY))


def _schema(kind: str) -> str:
    return ", ".join(f"{n} {kind if n == 'id' else 'long' if t == pa.int64() else 'int'}" for n, t in EVERY.items())


def _rows(docs: DataFrame, identity: str, text: str) -> DataFrame:
    rows = docs.select(column(docs, identity).alias("id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    return rows.withColumn("twin", F.xxhash64("text"))


def repeats(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks that are not the first occurrence of their digest, with the id, twin and place of the first."""
    rows = _rows(docs, identity, text)
    found = map_arrow(rows, _chunks, _schema(rows.schema["id"].dataType.simpleString()))
    own = F.struct("id", "twin", "place")
    found = found.withColumn("first", F.min(own).over(Window.partitionBy("high", "low")))
    return found.where(own > F.col("first")).select("id", "twin", "place", "first")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, place, side, own, near, point, begun): what stands before or after each chunk in ``ends`` (own: the end) and ``firsts``
    (no own), and the code points and begun words up to there.

    Text after a chunk begins with the chunk's last character; a line end stands for the start and the end of the text.
    """
    for batch in batches:
        for i in range(len(batch)):
            raw = batch.column("text")[i].as_py().encode()
            data = np.frombuffer(raw, np.uint8)
            points, begun = _counted(data)
            cuts = np.concatenate(([0], peaks(data, WINDOW, AROUND, LONGEST))).tolist()
            own, firsts = batch.column("ends")[i].values, batch.column("firsts")[i].values
            places = own.field("place").to_pylist() + firsts.field("place").to_pylist()
            sides = own.field("side").to_pylist() + firsts.field("side").to_pylist()
            near = []
            for at, side in zip(places, sides):
                if side == BEFORE:
                    low = max(0, at - BESIDE)
                    near.append(("" if low else "\n") + raw[cuts[low]:cuts[at]].decode())
                else:
                    high = min(len(cuts) - 1, at + 1 + BESIDE)
                    near.append(raw[cuts[at]:cuts[at + 1]].decode()[-1] + raw[cuts[at + 1]:cuts[high]].decode()
                                + ("\n" if high == len(cuts) - 1 else ""))
            edges = [cuts[at if side == BEFORE else at + 1] for at, side in zip(places, sides)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(np.full(len(near), i))), pa.array(places, pa.int32()), pa.array(sides, pa.int32()),
                 pa.concat_arrays([own, pa.nulls(len(firsts), own.type)]), pa.array(near, pa.string()),
                 pa.array(points[edges], pa.int32()), pa.array(begun[edges], pa.int32())],
                ["doc", "place", "side", "own", "near", "point", "begun"])


def _shared(own: str, other: str, side: int) -> tuple[int, int]:
    """Characters and words of whole words that follow (or, reversed, stand before) in both texts."""
    if side == BEFORE:
        own, other = own[::-1], other[::-1]
    most = min(len(own), len(other))
    same = next((k for k in range(most) if own[k] != other[k]), most)
    first = 0 if side == BEFORE else 1
    blank = [c in BLANKS for c in own[:same + 1]]
    for end in range(min(same, most - 1), first, -1):
        if blank[end] and other[end] in BLANKS and not blank[end - 1]:
            before = 1 if side == BEFORE else -1
            return end - first, sum(not blank[k] and blank[k + before] for k in range(first, end))
    return 0, 0


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = batch.column("side").to_pylist()
        found = [_shared(a, b, s) for a, b, s in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), sides)]
        more = pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())
        kept = [n for n in batch.schema.names if n not in ("own", "other")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *more], [*kept, "chars", "more"])


def _extended(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with the whole words on either side that stand beside the first occurrences too."""
    rows = rows.select(F.struct("id", "twin").alias("doc"), "text")  # equal as a key where the id is null, too
    info = "n_chunks", "first_id"
    ends = runs.select(F.struct("id", "twin").alias("doc"), F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{c}.place").alias("place"), F.struct(f"{c}.first.id", f"{c}.first.twin").alias("from_doc"),
                 F.col(f"{c}.first.place").alias("from_place"), "run", *info) for side, c in ((BEFORE, "head"), (AFTER, "tail"))])).alias("end"))
    firsts = ends.select(F.col("end.from_doc").alias("doc"), F.struct("end.from_place", "end.side").alias("first")).distinct()
    firsts = firsts.select("doc", F.struct(F.col("first.from_place").alias("place"), F.col("first.side").alias("side")).alias("first"))
    wanted = ends.unionByName(firsts, allowMissingColumns=True).groupBy("doc").agg(  # at most four for each of its chunks
        F.collect_list("end").alias("ends"), F.collect_list("first").alias("firsts")).withColumnRenamed("doc", "who")
    read = rows.join(wanted, F.col("doc") == F.col("who")).select("doc", "text", "ends", "firsts")
    types = dict(read.dtypes)
    near = map_arrow(read, _beside, f"doc {types['doc']}, place int, side int, own {types['ends'][6:-1]}, near string, point int, begun int")
    near = stage(near, "substring-near")
    first = near.where("own IS NULL").groupBy("doc", "place", "side").agg(F.min("near").alias("other"))  # repeated rows give it again
    first = first.toDF("from_doc", "from_place", "side", "other")
    own = near.where("own IS NOT NULL").select("doc", F.col("near").alias("own"), "point", "begun", *[
        F.col(f"own.{c}") for c in ("side", "place", "from_doc", "from_place", "run", *info)])
    both = own.join(first, ["from_doc", "from_place", "side"])
    # a repeat just after its first occurrence doesn't grow back into it
    inside = (F.col("doc") == F.col("from_doc")) & (F.col("place") - F.col("from_place") <= BESIDE) & (F.col("side") == BEFORE)
    both = both.withColumn("other", F.when(inside, F.lit("")).otherwise(F.col("other"))).withColumns(
        {"id": F.col("doc.id"), "twin": F.col("doc.twin")})
    types = dict(both.dtypes)
    kept = ["id", "twin", "run", *info, "point", "begun", "side", "own", "other"]
    grown = map_arrow(both.select(*kept), _grown, ", ".join(f"{n} {types[n]}" for n in kept[:-2]) + ", chars int, more int")
    at = lambda side, value: F.when(F.col("side") == side, value)
    point, words, chars, more = (F.col(c) for c in ("point", "begun", "chars", "more"))
    return grown.groupBy("id", "twin", "run").agg(
        F.min(at(BEFORE, point - chars)).alias("start"), F.max(at(AFTER, point + chars)).alias("end"),
        F.min(at(BEFORE, words - more)).alias("begun"), F.max(at(AFTER, words + more)).alias("until"),
        F.min("n_chunks").alias("n_chunks"), F.min("first_id").alias("first_id"))


def passages(docs: DataFrame, identity: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Repeated passages: id, twin (digest of the whole text), start and end in code points, n_words, n_chunks, first_id.

    ``n_chunks`` counts whole repeated chunks; a first occurrence is that of a chunk, so parts of a passage may have several, and
    ``first_id`` is the smallest.
    """
    # dealt by text once, for its places and for its runs
    single = repeats(docs, identity, text).repartition("id", "twin").groupBy("id", "twin", "place").agg(F.min("first").alias("first"))
    order = Window.partitionBy("id", "twin").orderBy("place")
    runs = single.withColumn("run", F.col("place") - F.row_number().over(order))
    end = F.struct("place", "first")
    runs = runs.groupBy("id", "twin", "run").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("first.id").alias("first_id"), F.min(end).alias("head"), F.max(end).alias("tail"))
    grown = _extended(_rows(docs, identity, text), stage(runs, "substring-runs"))
    order = Window.partitionBy("id", "twin").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grown = grown.withColumn("apart", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    whole = grown.withColumn("run", F.sum("apart").over(order)).groupBy("id", "twin", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("until") - F.min("begun")).alias("n_words"),
        F.sum("n_chunks").alias("n_chunks"), F.min("first_id").alias("first_id"))
    return whole.where(F.col("n_words") >= least_words).drop("run").withColumnRenamed("id", identity)


def _without(texts: Column, spans: Column) -> Column:
    """The text without its spans: what stands before each and after the last."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(texts)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(texts, a + 1, b - a)), "")


def remove(docs: DataFrame, identity: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of their texts. Ids must be integers."""
    spans, twin, who, other = fresh(docs, "spans", "twin", "who", "other")
    found = passages(docs, identity, text, least_words).groupBy(f"`{identity}`", "twin").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))  # as many as a text has passages
    found = found.toDF(who, other, spans)
    own = docs.withColumn(twin, F.xxhash64(F.coalesce(column(docs, text), F.lit(""))))
    same = column(own, identity).eqNullSafe(F.col(who)) & (F.col(twin) == F.col(other))
    old = column(own, text)
    new = F.when(F.col(spans).isNull(), old).otherwise(_without(old, F.col(spans)))
    return own.join(found, same, "left").select(*[new.alias(c) if c == text else column(own, c) for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return passages(docs).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                                 "n_words", "n_chunks", "first_id")
