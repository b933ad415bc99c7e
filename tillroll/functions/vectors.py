"""Vectors as Arrow batches of numbers, and bounded samples of them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# Executors need not have this package: the task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers that a sample may bring to the driver and to every task: 32 MB.
MOST_VALUES = 4_000_000


def numbers(table: DataFrame, column: str) -> Column:
    """A vector or array column as ``array<double>``."""
    if table.schema[column].dataType.typeName() == "array":
        return F.col(column).cast("array<double>")
    return vector_to_array(column)


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def width(table: DataFrame, column: str) -> int:
    first = table.select(F.size(numbers(table, column)).alias("n")).first()
    return first.n if first else 0


def row_hash(table: DataFrame, seed: int) -> Column:
    """A hash of the whole row; vectors count by their numbers."""
    parts = [vector_to_array(c) if table.schema[c].dataType.typeName() not in ("array",) and table.schema[c].dataType.simpleString() == "vector" else F.col(f"`{c}`")
             for c in table.columns]
    return F.xxhash64(F.lit(seed), *parts)


def sampled(table: DataFrame, column: str, rows: int, most: int, seed: int) -> np.ndarray:
    """Vectors of about ``most`` of the ``rows`` rows, chosen by their hash, all if there are no more; in the order of the hash."""
    place = row_hash(table, seed)
    chosen = table.select(place.alias("h"), numbers(table, column).alias("x"))
    if rows > most:
        chosen = chosen.where(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * most / rows))
    found = sorted((r.h, r.x) for r in chosen.collect())
    return np.array([x for _, x in found], np.float64).reshape(len(found), -1)
