"""Small helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import tillroll
from tillroll.session import place, shared_folder

#: What separates words: the space and the five control characters from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of so many rows at most, some 100 bytes each, are sent to all executors.
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small, so that what it is joined with need not be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key of each row that is the same whenever the rows are read again.

    Rows of Parquet files have one in their file and place; any other table is stored first, with numbers.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        place_ = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.struct(F.xxhash64(place_["file_path"]).alias("file"), place_["row_index"].alias("at")))
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return stage(docs.withColumn(name, number), "rows")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package as a zip in the shared folder, once per application; executors need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(tillroll.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(file.relative_to(root.parent))), file.read_bytes())
    content = packed.getvalue()
    target = f"{shared_folder(spark)}/tillroll/package-{hashlib.sha256(content).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(content)
    stream.close()
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return df[f"`{name}`"]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and where each begins and ends in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(places, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]:ends[-1]], ends - ends[0]


#: ASCII capitals to small letters, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, p in enumerate((MULTIPLIER, _INVERSE)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of 64-bit numbers stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that are inside."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomial sums from prefix sums, shifted to the span's own start, then stirred."""
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
