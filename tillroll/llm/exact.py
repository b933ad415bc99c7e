"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is the value of the polynomial with its bytes as coefficients, modulo two primes. The
fingerprint of two pieces in a row follows from theirs and the length of the second (``combine``), so a
text of any length is hashed in chunks of bounded size. Texts with equal fingerprint and length are then compared
themselves, chunk by chunk: within a class, the least and the greatest chunk at each place must be the same.
Least and greatest are kept by every task for what it has read, so of a class with a third of all rows
only a row per task and chunk is moved. A class that fails is split by the digest of the whole text.

Defined cases: null counts as the empty text; texts are equal when identical after lower-casing A-Z only;
of equal texts the row with the largest id stays, a null id being the smallest; of rows equal in id as
well one stays; an empty table gives no rows; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.common import LOWER, column, few, fresh, keyed, map_arrow, stage, utf8

CHUNK = 1 << 16
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)
#: Bytes of chunks that a task hands over at a time.
HANDOVER = 4 << 20


def powers(base: int, prime: int, n: int = CHUNK) -> np.ndarray:
    """base**(n-1) ... base, 1 modulo prime."""
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n - 1, -1, -1):
        out[i] = value
        value = value * base % prime
    return out


def chunk_print(data: np.ndarray, table: np.ndarray, prime: int) -> int:
    """Fingerprint of at most ``CHUNK`` bytes; products stay below 2**40 and their sum below 2**56."""
    wide = data.astype(np.uint64) + np.uint64(1)
    return int(np.dot(wide, table[len(table) - len(wide):])) % prime


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """Fingerprint of two pieces in a row."""
    return (left * pow(base, right_length, prime) + right) % prime


class Printer:
    """Fingerprints of byte strings under all primes."""

    def __init__(self, primes=PRIMES, bases=BASES):
        self.parts = [(p, b % p, powers(b % p, p)) for p, b in zip(primes, bases)]

    def __call__(self, data: np.ndarray) -> tuple[int, ...]:
        found = []
        for prime, base, table in self.parts:
            value = 0
            for start in range(0, len(data), CHUNK):
                piece = data[start:start + CHUNK]
                value = combine(value, chunk_print(piece, table, prime), len(piece), base, prime)
            found.append(value)
        return tuple(found)


def _prints(primes, bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(primes, bases)
        for batch in batches:
            body, ends = utf8(batch.column("text"))
            body = LOWER[body]
            values, digests = [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                values.append(printer(body[a:b]))
                digests.append(hashlib.sha256(body[a:b].data).hexdigest())
            numbers = np.array(values, np.int64).reshape(-1, len(primes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(numbers[:, 0]), pa.array(numbers[:, -1]),
                 pa.array(np.diff(ends)), pa.array(digests, pa.string())],
                ["row", "id", "print_a", "print_b", "n_bytes", "text_sha256"])

    return run


def _chunks(primes, bases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(primes, bases)
        held, size = [], 0

        def handed():
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(4)]
                                              + [pa.array(columns[4], pa.binary())],
                                              ["print_a", "print_b", "n_bytes", "place", "chunk"])

        for batch in batches:
            body, ends = utf8(batch.column("text"))
            body = LOWER[body]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                values = printer(body[a:b])
                for start in range(a, b, CHUNK):
                    piece = body[start:min(b, start + CHUNK)].tobytes()
                    held.append((values[0], values[-1], b - a, (start - a) // CHUNK, piece))
                    size += len(piece)
                    if size >= HANDOVER:
                        yield handed()
                        held, size = [], 0
        if held:
            yield handed()

    return run


CLASS = ["print_a", "print_b", "n_bytes"]


def classes(rows: DataFrame, primes=PRIMES, bases=BASES) -> DataFrame:
    """Decisions on rows (row, id, text): row, id, keep_id, group_size, kept, text_sha256."""
    kind, row = rows.schema["id"].dataType.simpleString(), rows.schema["row"].dataType.simpleString()
    prints = stage(map_arrow(rows, _prints(primes, bases), (
        f"row {row}, id {kind}, print_a long, print_b long, n_bytes long, text_sha256 string")), "exact-prints")
    # only texts whose fingerprint another one has are compared
    repeated = stage(prints.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*CLASS), "exact-repeated")
    chunks = map_arrow(rows, _chunks(primes, bases), "print_a long, print_b long, n_bytes long, place long, chunk binary")
    chunks = chunks.join(few(repeated), CLASS, "left_semi")
    unlike = stage(
        chunks.groupBy(*CLASS, "place").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
        .where(F.col("least") != F.col("greatest")).select(*CLASS).distinct(), "exact-unlike")
    if unlike.isEmpty():
        prints = prints.withColumn("variant", F.lit(""))
    else:  # equal fingerprints of different texts
        prints = prints.join(unlike.withColumn("split", F.lit(True)), CLASS, "left").withColumn(
            "variant", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
    key = [*CLASS, "variant"]
    groups = prints.groupBy(*key).agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return prints.join(groups, key).select(
        "row", "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def decide(docs: DataFrame, identity: str = "doc_id", text: str = "text", primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the text as compared)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, identity).alias("id"),
                       column(docs, text).alias("text"))
    return classes(rows, primes, bases).drop("row").withColumnRenamed("id", identity)


def deduplicate(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    (row,) = fresh(docs, "row")
    table = keyed(docs, row)
    rows = table.select(F.col(row).alias("row"), column(table, identity).alias("id"), column(table, text).alias("text"))
    gone = stage(classes(rows).where(~F.col("kept")).select(F.col("row").alias(row)), "exact-gone")
    return table.join(few(gone), row, "left_anti").select(*[column(table, c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
