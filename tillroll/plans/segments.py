"""Invoice lines to scored customers, for one time window."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.operators import basket, cancel, lines as line_ops, metrics, outlier, score
from tillroll.session import materialize


def clean_lines(raw: DataFrame) -> DataFrame:
    return line_ops.deduplicate(line_ops.drop_without_customer(raw))


def combine_metrics(metric_table: DataFrame, factor: float = 2) -> DataFrame:
    """RFM and length of one window without outliers, stored.

    The length table is filtered on all of its columns (CustomerID too), the RFM table on
    its three metrics; customers only the first filter dropped keep a null Lenght.
    """
    kept_rfm = outlier.remove_outliers_iqr(metrics.rfm(metric_table),
                                           ["Recency", "Frequency", "MonetaryValue"], factor)
    kept_length = outlier.remove_outliers_iqr(metrics.length(metric_table), factor=factor)
    return materialize(score.join_length(kept_rfm, kept_length), "combined")


def segment_customers(metric_table: DataFrame, factor: float = 2, on_ties: str = "raise",
                      rules: score.ScoreRules | None = None) -> DataFrame:
    """Scored customers from stored metrics: outliers out, quartiles, labels."""
    combined = combine_metrics(metric_table, factor)
    return score.score_customers(combined, rules or score.fit_rules(combined, on_ties))


def segments(lines: DataFrame, factor: float = 2, on_ties: str = "raise") -> DataFrame:
    """Scored customers of one window of clean lines."""
    cleaned = cancel.net_cancels(materialize(lines, "lines"))
    return segment_customers(metrics.customer_metrics(basket.baskets(cleaned)), factor, on_ties)
