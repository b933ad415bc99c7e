"""Quartile scores, segment codes, level and closeness labels, and their reports."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.bands import closeness, level
from tillroll.operators.order_stats import bucket_ends, pairs_at_of, quantiles_of, rank_cuts

ASCENDING = [1, 2, 3, 4]
DESCENDING = [4, 3, 2, 1]


def value_edges(df: DataFrame, column: str, buckets: int = 4, on_ties: str = "raise") -> list[float]:
    """Quantile edges, smallest and largest value included."""
    return _distinct_edges(column, quantiles_of(df, [column], [k / buckets for k in range(buckets + 1)])[column], on_ties)


def _distinct_edges(column: str, edges: list[float], on_ties: str) -> list[float]:
    if len(set(edges)) < len(edges):
        if on_ties == "raise":
            raise ValueError(f"quantile edges of {column} are not unique: {edges}")
        edges = sorted(set(edges))
    return edges


def score_by_edges(column: str, edges: list[float], labels: list[int]) -> Column:
    """Label of the right-closed bin; values beyond the outer edges take the outer bins."""
    value = F.col(column).cast("double")
    rule = F.when(value.isNull(), F.lit(None).cast("int"))
    for upper, label in zip(edges[1:-1], labels):
        rule = rule.when(value <= upper, F.lit(label))
    return rule.otherwise(F.lit(labels[max(len(edges) - 2, 0)]))


def quartile_by_value(df: DataFrame, column: str, labels: list[int], on_ties: str = "raise") -> Column:
    return score_by_edges(column, value_edges(df, column, len(labels), on_ties), labels)


def score_by_cuts(column: str, tie: str, cuts: list[tuple]) -> Column:
    """Bucket of (value, tie) among cuts; null for a null value."""
    bucket = F.lit(1)
    for value, at in cuts:
        later = (F.col(column) > F.lit(value)) | ((F.col(column) == F.lit(value)) & (F.col(tie) > F.lit(at)))
        bucket = bucket + later.cast("int")
    return F.when(F.col(column).isNotNull(), bucket)


def quartile_by_rank(df: DataFrame, column: str, tie: str = "CustomerID") -> Column:
    """Quartile of the rank, equal values ranked in ``tie`` order."""
    return score_by_cuts(column, tie, rank_cuts(df, column, tie))


def join_length(rfm_table: DataFrame, length_table: DataFrame) -> DataFrame:
    """RFM rows with Lenght; null where the length table lost the customer."""
    return rfm_table.join(length_table.select("CustomerID", "Lenght"), "CustomerID", "left")


@dataclass(frozen=True)
class ScoreRules:
    """Edges and cuts of the four scores; those of one window can score another."""

    recency: list[float]
    monetary: list[float]
    frequency: list[tuple]
    length: list[tuple]


def rules_to_plain(rules: ScoreRules) -> dict:
    """As JSON takes it; decimals and large integers as text."""
    pairs = lambda cuts: [[str(v), type(v).__name__, t] for v, t in cuts]
    return {"recency": rules.recency, "monetary": rules.monetary, "frequency": pairs(rules.frequency), "length": pairs(rules.length)}


def rules_from_plain(state: dict) -> ScoreRules:
    kinds = {"int": int, "float": float, "Decimal": Decimal}
    pairs = lambda cuts: [(kinds[kind](v), t) for v, kind, t in cuts]
    return ScoreRules(state["recency"], state["monetary"], pairs(state["frequency"]), pairs(state["length"]))


def fit_rules(combined: DataFrame, on_ties: str = "raise") -> ScoreRules:
    """``combined`` is read several times: a few rounds for both pairs of columns each."""
    quarters = [k / 4 for k in range(5)]
    edges = quantiles_of(combined, ["Recency", "MonetaryValue"], quarters)
    cuts = pairs_at_of(combined, "CustomerID", {"Frequency": bucket_ends(4), "Lenght": bucket_ends(4)})
    return ScoreRules(_distinct_edges("Recency", edges["Recency"], on_ties),
                      _distinct_edges("MonetaryValue", edges["MonetaryValue"], on_ties), cuts["Frequency"], cuts["Lenght"])


def score_customers(combined: DataFrame, rules: ScoreRules) -> DataFrame:
    """R, F, M, L and everything derived from them."""
    return with_labels(combined.withColumns({
        "R": score_by_edges("Recency", rules.recency, DESCENDING),
        "F": score_by_cuts("Frequency", "CustomerID", rules.frequency),
        "M": score_by_edges("MonetaryValue", rules.monetary, ASCENDING),
        "L": score_by_cuts("Lenght", "CustomerID", rules.length),
    }))


def with_labels(scored: DataFrame) -> DataFrame:
    """Scores from R, F, M, L. A missing L adds nothing and shows as ``nan`` in the code."""
    near = F.col("R") + F.col("F")
    total = near + F.col("M") + F.coalesce("L", F.lit(0))
    code = F.concat(*[F.col(c).cast("string") for c in ("R", "F", "M")],
                    F.coalesce(F.col("L").cast("string"), F.lit("nan")))
    return scored.withColumns({
        "Proximidade_Marca_Score": near, "RFML_Segment_Concat": code, "RFML_Score": total,
        "RFML_Level": level(total), "Proximidade_Marca": closeness(near)})


def segment_count(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_distinct("RFML_Segment_Concat").alias("segments"))


def level_profile(scored: DataFrame) -> DataFrame:
    """Mean metrics per level, rounded half-even to one digit."""
    mean = {"Recency": "RecencyMean", "Frequency": "FrequencyMean", "Lenght": "LenghtMean",
            "MonetaryValue": "MonetaryMean"}
    return scored.groupBy("RFML_Level").agg(
        *[F.bround(F.avg(F.col(c).cast("double")), 1).alias(name) for c, name in mean.items()],
        F.count("MonetaryValue").alias("Count"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` x the given ``column`` values; 0 where none."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def crosstab_with_totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long crosstab with margins; the total rows carry the name All."""
    def named(c: str) -> Column:
        return F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string"))

    table = df.cube(row, column).agg(F.count("*").alias("n"), named(row).alias("r"), named(column).alias("c"))
    return table.select(F.col("r").alias(row), F.col("c").alias(column), "n")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Absolute and relative frequency of each value; the total is taken over the grouped rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
