"""Feature tables: assembly, scaling, splits; principal components are in :mod:`tillroll.operators.components`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tillroll.operators.components import Components, fit_components
from tillroll.schema import FEATURES

__all__ = ["Components", "Scaling", "assemble", "customer_features", "fit_components", "fit_scaling", "split_by_id"]


def customer_features(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """Scored customers with their basket statistics, features as DOUBLE."""
    kept = ["CustomerID", *[c for c in FEATURES if c in scored.columns], "RFML_Level"]
    table = scored.select(*kept).join(stats, "CustomerID", "left")
    return table.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def assemble(table: DataFrame, columns: list[str] = FEATURES, incomplete: str = "skip",
             output: str = "raw_features") -> DataFrame:
    """Feature vector; rows with a missing feature are skipped or (``error``) refused."""
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid=incomplete).transform(table)


@dataclass(frozen=True)
class Scaling:
    """Column means and population standard deviations of the fitting table."""

    columns: list[str]
    means: list[float]
    deviations: list[float]

    def transform(self, table: DataFrame) -> DataFrame:
        """Standardised columns as the vector ``features``; a constant column is only centred."""
        scaled = [(F.col(c) - m) / (s or 1.0) for c, m, s in zip(self.columns, self.means, self.deviations)]
        complete = table.na.drop(subset=self.columns)
        return complete.withColumn("features", array_to_vector(F.array(*scaled)))

    def stages(self) -> list:
        """The same as pipeline stages, to be stored with the models that need it."""
        scaled = [f"scaled_{i}" for i in range(len(self.columns))]
        terms = ", ".join(f"(`{c}` - {m!r}D) / {(s or 1.0)!r}D AS {name}" for c, m, s, name in
                          zip(self.columns, self.means, self.deviations, scaled))
        return [SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__"),
                VectorAssembler(inputCols=scaled, outputCol="features", handleInvalid="skip")]

    def report(self, table: DataFrame) -> DataFrame:
        return table.sparkSession.createDataFrame(
            list(zip(self.columns, self.means, self.deviations)), "feature string, mean double, std double")


def fit_scaling(table: DataFrame, columns: list[str] = FEATURES) -> Scaling:
    """One pass: mean and population deviation of every column over complete rows."""
    row = table.na.drop(subset=columns).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    size = range(len(columns))
    return Scaling(list(columns), [row[f"m{i}"] for i in size], [row[f"s{i}"] for i in size])


def split_by_id(table: DataFrame, key: str, train: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Reproducible random split: the hash of the key decides, whatever the partitioning."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(train * 1_000_000)
    return table.where(place), table.where(~place)
