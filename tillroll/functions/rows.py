"""Row multiplication that spreads hot rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RUN = 100_000  # numbers one row hands out in one go


def numbered_copies(df: DataFrame, first: int, last: Column, name: str) -> DataFrame:
    """Each row once per number from ``first`` to ``last``, the number as column ``name``.

    A row is first cut into runs, which are dealt out to all tasks, and then written out;
    so a row with very many copies is neither one long array nor the work of one task.
    """
    columns = df.columns
    starts = F.when(last >= first, F.sequence(F.lit(first).cast("bigint"), last.cast("bigint"),
                                              F.lit(RUN).cast("bigint")))
    runs = df.select(*columns, last.cast("bigint").alias("_last"), F.explode(starts).alias("_start"))
    ends = F.least(F.col("_last"), F.col("_start") + (RUN - 1))
    return (runs.repartition("_start", *columns)
            .select(*columns, F.explode(F.sequence("_start", ends)).alias(name)))
