"""Classifier quality from the confusion table, which is small whatever the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction",
              weight: str | None = None) -> DataFrame:
    """Rows per label and prediction, or the sum of their weights."""
    return (predicted.groupBy(F.col(label).cast("int").alias("label"),
                              F.col(prediction).cast("int").alias("prediction"))
            .agg((F.sum(weight) if weight else F.count("*")).alias("n")))


def balancing_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Weights with which all classes count alike: the size of the largest class over that of the row's."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    most = F.max("size").over(Window.partitionBy())
    return df.join(sizes.select(label, (most / F.col("size")).alias(name)), label)


def class_report(table: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a rate has no rows.

    Each cell counts once for its label and once for its prediction, so one grouping
    gives all sums.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast(table.schema["n"].dataType)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hits"), F.col("n").alias("labelled"),
                 none.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), none.alias("hits"), none.alias("labelled"),
                 F.col("n").alias("predicted")))
    sums = (table.select(F.inline(sides)).groupBy("class")
            .agg(*[F.sum(c).alias(c) for c in ("hits", "labelled", "predicted")]))
    zero = F.lit(0.0)
    rated = sums.select(
        "class", F.coalesce(F.try_divide("hits", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "labelled"), zero).alias("recall"),
        F.col("labelled").alias("support"))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero))


def scores(table: DataFrame) -> DataFrame:
    """Accuracy, weighted precision and recall, macro F1, precision and recall in one row."""
    report = class_report(table)
    weight = F.sum("support")

    def weighted(c: str):
        return F.sum(F.col(c) * F.col("support")) / weight

    return report.agg(
        weighted("recall").alias("accuracy"), weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"), F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))
