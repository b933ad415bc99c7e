"""Exact order statistics, quantiles and rank cuts by repeated narrowing.

The built-in exact percentile keeps every distinct value of a group in one task, and a
global rank needs one task for the whole sort. Here each round is one distributed count
over a bounded number of value cells, for all columns asked for at once; the cells that hold
the wanted ranks become the ranges of the next round. Only cell counts reach the driver.

A range of a double that spans signs or powers of two is cut on a signed logarithmic scale, any other
range linearly, so each round leaves a 4096th of what was open and six rounds do for 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

CELLS = 4096
RANGES_PER_JOB = 48
SAFE_GAP = 1 << 62
LEAST_STEP = 5e-324
#: Powers of two of doubles lie in -1074 .. 1023; one more on either side for infinities.
POWERS = 1080


@dataclass(frozen=True)
class Wanted:
    """Ranks asked for: ``ranks(group, n)`` names 0-based ranks among the n present values of a group."""

    column: str
    ranks: Callable[[Any, int], list[int]]
    group: str | None = None


@dataclass(frozen=True)
class _Range:
    spec: int
    group: Any
    low: Any
    high: Any
    below: int  # values of the group that are smaller than ``low``
    n: int


def _floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def _present(df: DataFrame, column: str) -> Column:
    kept = F.col(column).isNotNull()
    return kept & ~F.isnan(column) if _floating(df, column) else kept


def extents(df: DataFrame, column: str, group: str | None = None) -> dict[Any, tuple]:
    """Per group: (count, min, max) of the present values, in one pass."""
    return _extents(df, [Wanted(column, lambda *_: [], group)])[0]


def _extents(df: DataFrame, specs: list[Wanted]) -> list[dict[Any, tuple]]:
    """The same for several columns; one pass for each grouping that occurs."""
    found: list[dict[Any, tuple]] = [{} for _ in specs]
    for group in dict.fromkeys(s.group for s in specs):
        own = [(i, s) for i, s in enumerate(specs) if s.group == group]
        parts = []
        for i, s in own:
            x = F.when(_present(df, s.column), F.col(s.column))
            parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        key = F.col(group) if group else F.lit(0)
        for r in df.groupBy(key.alias("g")).agg(*parts).collect():
            for i, _ in own:
                if r[f"n{i}"]:
                    found[i][r.g] = (r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"])
    return found


def _power(x: Column) -> Column:
    """A number that does not fall as a double grows: the logarithm, with the sign of the value."""
    size = F.least(F.greatest(F.log2(F.abs(x)) + POWERS, F.lit(1.0)), F.lit(2.0 * POWERS))
    return F.when(x == 0, 0.0).when(x > 0, size).otherwise(-size)


def _power_of(x: float) -> float:
    if x == 0:
        return 0.0
    size = 2.0 * POWERS if math.isinf(x) else min(max(math.log2(abs(x)) + POWERS, 1.0), 2.0 * POWERS)
    return math.copysign(size, x)


def _cell(df: DataFrame, column: str, r: _Range) -> Column:
    x, dtype = F.col(column), df.schema[column].dataType
    low = F.lit(r.low).cast(dtype)
    if _floating(df, column):
        a, b = float(r.low), float(r.high)
        if math.isinf(a) or math.isinf(b) or a * b <= 0 or max(abs(a), abs(b)) > 4 * min(abs(a), abs(b)):
            start, step = _power_of(a), (_power_of(b) - _power_of(a)) / CELLS
            return F.floor((_power(x.cast("double")) - F.lit(start)) / F.lit(step))
        return F.floor((x.cast("double") - F.lit(a)) / F.lit(max((b - a) / CELLS, LEAST_STEP)))
    step = float(r.high - r.low) / CELLS
    # a difference that may overflow is taken between doubles; cells stay in order
    gap = x.cast("double") - low.cast("double") if r.high - r.low > SAFE_GAP else (x - low).cast("double")
    return F.floor(gap / F.lit(step))


def _count_cells(df: DataFrame, specs: list[Wanted], ranges: list[_Range]) -> list:
    """Counts and extremes of the cells of all ranges, in one pass."""
    columns = list(dict.fromkeys(specs[r.spec].column for r in ranges))
    places: dict[int, Column] = {}
    for i, r in enumerate(ranges):
        spec = specs[r.spec]
        x, dtype = F.col(spec.column), df.schema[spec.column].dataType
        inside = _present(df, spec.column) & (x >= F.lit(r.low).cast(dtype)) & (x <= F.lit(r.high).cast(dtype))
        if spec.group:
            inside = inside & F.col(spec.group).eqNullSafe(F.lit(r.group))
        cell = F.struct(F.lit(i).alias("part"), _cell(df, spec.column, r).cast("bigint").alias("cell"), *[
            (x if c == spec.column else F.lit(None)).cast(df.schema[c].dataType).alias(f"x{k}") for k, c in enumerate(columns)])
        places[r.spec] = places[r.spec].when(inside, cell) if r.spec in places else F.when(inside, cell)
    met = df.select(F.explode(F.array(*places.values())).alias("p")).where("p is not null").select("p.*")
    rows = met.groupBy("part", "cell").agg(F.count("*").alias("n"), *[
        f(f"x{k}").alias(f"{name}{k}") for k in range(len(columns)) for name, f in (("lo", F.min), ("hi", F.max))]).collect()
    place = {c: k for k, c in enumerate(columns)}
    found = []
    for row in rows:
        k = place[specs[ranges[row.part].spec].column]
        found.append((row.part, row[f"lo{k}"], row[f"hi{k}"], row.n))
    return found


def order_statistics_of(df: DataFrame, specs: list[Wanted], known: list[dict[Any, tuple]] | None = None,
                        ) -> list[dict[Any, dict[int, tuple]]]:
    """Values at the ranks wanted: per spec, group -> rank -> (value, how many values are smaller).

    ``df`` is read once per round for all specs together, so pass a stored or cached
    table. ``known`` reuses extents.
    """
    known = _extents(df, specs) if known is None else known
    found: list[dict[Any, dict[int, tuple]]] = [{g: {} for g in extent} for extent in known]
    pending: dict[_Range, list[int]] = {}
    for i, (spec, extent) in enumerate(zip(specs, known)):
        for g, (n, low, high) in extent.items():
            pending[_Range(i, g, low, high, 0, n)] = sorted(set(spec.ranks(g, n)))
    while pending:
        for r in [r for r in pending if r.low == r.high]:
            for rank in pending.pop(r):
                found[r.spec][r.group][rank] = (r.low, r.below)
        batch = [r for r in pending if pending[r]]
        narrowed: dict[_Range, list[int]] = {}
        for start in range(0, len(batch), RANGES_PER_JOB):
            ranges = batch[start:start + RANGES_PER_JOB]
            seen = [r.below for r in ranges]
            for part, low, high, n in sorted(_count_cells(df, specs, ranges), key=lambda c: (c[0], c[1])):
                r = ranges[part]
                inside = [k for k in pending[r] if seen[part] <= k < seen[part] + n]
                if inside:
                    if low == r.low and high == r.high:
                        raise ArithmeticError(f"values of {specs[r.spec].column} between {low} and {high} were not told apart")
                    narrowed[_Range(r.spec, r.group, low, high, seen[part], n)] = inside
                seen[part] += n
        pending = narrowed
    return found


def order_statistics(df: DataFrame, column: str, wanted: Callable[[Any, int], list[int]],
                     group: str | None = None, known: dict[Any, tuple] | None = None,
                     ) -> dict[Any, dict[int, tuple]]:
    """:func:`order_statistics_of` for one column."""
    return order_statistics_of(df, [Wanted(column, wanted, group)], None if known is None else [known])[0]


def _around(probabilities: list[float]) -> Callable[[Any, int], list[int]]:
    return lambda _, n: [k for p in probabilities for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))]


def _interpolated(stats: dict[int, tuple], n: int, probabilities: list[float]) -> list[float]:
    row = []
    for p in probabilities:
        k = int(p * (n - 1))
        weight = p * (n - 1) - k
        a, b = float(stats[k][0]), float(stats[min(k + 1, n - 1)][0])
        row.append(a if weight == 0 or a == b else a + (b - a) * weight)
    return row


def quantiles_of(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """Quantiles of several columns, found in the same rounds; columns without values are left out."""
    specs = [Wanted(c, _around(probabilities)) for c in columns]
    known = _extents(df, specs)
    stats = order_statistics_of(df, specs, known)
    return {s.column: _interpolated(found[0], extent[0][0], probabilities)
            for s, found, extent in zip(specs, stats, known) if extent}


def quantiles(df: DataFrame, column: str, probabilities: list[float], group: str | None = None,
              known: dict[Any, tuple] | None = None) -> dict[Any, list[float]]:
    """Quantiles with linear interpolation between neighbours, per group (key 0 without one)."""
    extent = known if known is not None else extents(df, column, group)
    stats = order_statistics(df, column, _around(probabilities), group, extent)
    return {g: _interpolated(stats[g], n, probabilities) for g, (n, _, _) in extent.items()}


def pairs_at_of(df: DataFrame, tie: str, wanted: dict[str, Callable[[int], list[int]]]) -> dict[str, list[tuple]]:
    """For each column: the (value, tie) pairs at 0-based ranks over (value, tie); ``tie`` is unique.

    The values of all columns are found together, then the ties among rows with these values.
    """
    specs = [Wanted(c, lambda _, n, f=f: f(n)) for c, f in wanted.items()]
    known = _extents(df, specs)
    values = order_statistics_of(df, specs, known)
    result: dict[str, list[tuple]] = {c: [] for c in wanted}
    tie_specs, within = [], {}
    for spec, extent, found in zip(specs, known, values):
        if not extent:
            continue
        within[spec.column] = {}
        for rank in spec.ranks(0, extent[0][0]):
            value, below = found[0][rank]
            within[spec.column].setdefault(value, set()).add(rank - below)
        tie_specs.append(Wanted(tie, lambda g, _, at=within[spec.column]: sorted(at.get(g, ())), spec.column))
    if not tie_specs:
        return result
    # rows with other values belong to no group that is asked for
    met = {s.group: F.when(F.col(s.group).isin(list(within[s.group])), F.col(s.group)) for s in tie_specs}
    tied = df.select(F.col(tie), *[c.alias(n) for n, c in met.items()])
    ties = order_statistics_of(tied, tie_specs)
    for spec, at in zip(tie_specs, ties):
        i = [s.column for s in specs].index(spec.group)
        result[spec.group] = [(values[i][0][r][0], at[values[i][0][r][0]][r - values[i][0][r][1]][0])
                              for r in specs[i].ranks(0, known[i][0][0])]
    return result


def pairs_at(df: DataFrame, column: str, tie: str, wanted: Callable[[int], list[int]]) -> list[tuple]:
    """:func:`pairs_at_of` for one column."""
    return pairs_at_of(df, tie, {column: wanted})[column]


def bucket_ends(buckets: int) -> Callable[[int], list[int]]:
    """Last rank of each rank bucket but the last one.

    Bucket ends follow linear interpolation of the ranks: rank r of n is in bucket
    ``ceil((r - 1) * buckets / (n - 1))``, at least 1.
    """
    return lambda n: [k * (n - 1) // buckets for k in range(1, buckets)]


def rank_cuts(df: DataFrame, column: str, tie: str, buckets: int = 4) -> list[tuple]:
    """Upper ends of rank buckets: the (value, tie) pairs that close bucket 1..buckets-1."""
    return pairs_at(df, column, tie, bucket_ends(buckets))
