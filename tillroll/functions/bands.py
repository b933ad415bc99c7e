"""Label rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level and closeness names with their lowest score.
LEVELS = [(9, "Can't Loose Them"), (7, "Champions"), (6, "Potential"), (5, "Promising"),
          (4, "Needs Attention")]
LOWEST_LEVEL = "Require Activation"
CLOSENESS = [(7, "Leal"), (5, "Em processo de fidelização"), (4, "Pouco relacionamento/ regular")]
LOWEST_CLOSENESS = "Clientes novos/ potenciais"
# Lower ends of the product price bands, edges of the order value ranges.
PRICE_BANDS = [0, 1, 2, 3, 5, 10]
ORDER_RANGES = [0, 50, 100, 200, 500, 1000, 5000, 50000]


def _from_top(score: Column, steps: list[tuple[int, str]], lowest: str) -> Column:
    rule = None
    for least, name in steps:
        rule = (F.when if rule is None else rule.when)(score >= least, F.lit(name))
    return rule.otherwise(F.lit(lowest))


def level(score: Column) -> Column:
    return _from_top(score, LEVELS, LOWEST_LEVEL)


def closeness(score: Column) -> Column:
    return _from_top(score, CLOSENESS, LOWEST_CLOSENESS)


def range_names(edges: list[int], open_end: bool) -> list[str]:
    names = [f"{a}<.<{b}" for a, b in zip(edges, edges[1:])]
    return names + [f".>{edges[-1]}"] if open_end else names


def price_band(price: Column, edges: list[int] = PRICE_BANDS, parity: bool = False) -> Column:
    """Band ``(lo, hi]`` of a mean price.

    A price of 0 or less belongs to the first band; ``parity=True`` puts it in the last
    one, which is what indexing bands by ``position - 1`` does.
    """
    names = range_names(edges, open_end=True)
    rule = F.when(price <= edges[0], F.lit(names[-1] if parity else names[0]))
    for name, upper in zip(names, edges[1:]):
        rule = rule.when(price <= upper, F.lit(name))
    return rule.when(price > edges[-1], F.lit(names[-1]))


def order_range(total: Column, edges: list[int] = ORDER_RANGES) -> Column:
    """Value range with both ends open: a total equal to an edge has none."""
    rule = None
    for name, (low, high) in zip(range_names(edges, open_end=False), zip(edges, edges[1:])):
        inside = (total > low) & (total < high)
        rule = (F.when if rule is None else rule.when)(inside, F.lit(name))
    return rule
