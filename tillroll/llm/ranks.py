"""Places of rows within their groups, for groups of any size.

Rows are dealt by ranges of (group, order), so a group with a third of all rows is spread over many tasks. Each task counts on from
row to row and starts a new *run* at each new group, and after ``RUN`` rows; a table of runs, with what stands before each, gives the
place in the group. Only that table is ever sorted as a whole group: one row per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillroll.llm.common import fresh, map_arrow, stage

#: Rows of a run at most.
RUN = 1 << 13


def _counted(group: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at, last = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            runs, places = [], []
            for value in batch.column(group).to_pylist():
                if value != last or at == most:
                    now, at, last = now + 1, 0, value
                runs.append(now)
                places.append(at)
                at += 1
            more = [pa.array([part] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "run", "at"])

    return run


def numbered(rows: DataFrame, group: str, order: list[str], name: str, most: int = RUN) -> tuple[DataFrame, DataFrame]:
    """``rows`` with part, run and at (the place in the run), and the runs: part, run, group, n, start, size.

    ``start`` is how many rows of the group stand before the run and ``size`` how many it has. Groups and orders ascend, nulls first;
    rows equal in all of that keep the order in which they were first written. Both tables are stored.
    """
    (salt,) = fresh(rows, "salt")
    stored = stage(rows.withColumn(salt, F.monotonically_increasing_id()), f"{name}-rows")
    keys = [group, *order, salt]
    dealt = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in ("part", "run", "at"))])
    table = stage(map_arrow(dealt, _counted(group, most), schema), f"{name}-numbered")
    runs = table.groupBy("part", "run").agg(F.first(group).alias(group), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = F.sum("n").over(whole.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("*", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size"))
    return table, stage(runs, f"{name}-runs")
