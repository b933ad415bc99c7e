"""Products: mean prices, price bands, keyword matrix and clusters."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F

from tillroll.functions.bands import PRICE_BANDS, price_band, range_names


def mean_prices(cleaned: DataFrame) -> DataFrame:
    """Mean unit price per description."""
    return (cleaned.where("Description is not null").groupBy("Description")
            .agg((F.sum("UnitPrice").cast("double") / F.count("UnitPrice")).alias("mean_price")))


def with_price_band(prices: DataFrame, parity: bool = False) -> DataFrame:
    return prices.withColumn("band", price_band(F.col("mean_price"), parity=parity))


def band_columns(banded: DataFrame) -> DataFrame:
    """One 0/1 column per band."""
    return banded.select("Description", *[(F.col("band") == b).cast("int").alias(b)
                                          for b in range_names(PRICE_BANDS, open_end=True)])


def band_counts(banded: DataFrame) -> DataFrame:
    """Products per band, empty bands included, from one pass."""
    names = range_names(PRICE_BANDS, open_end=True)
    one_row = banded.agg(*[F.count_if(F.col("band") == b).alias(f"n{i}") for i, b in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"n{i}").alias("products"))
                      for i, b in enumerate(names)])
    return one_row.select(F.inline(cells))


def product_marks(banded: DataFrame, hits: DataFrame) -> DataFrame:
    """Keywords and price band of each product as one array ``marks``.

    A product has at most as many marks as there are keywords, plus one.
    """
    found = hits.groupBy("Description").agg(F.collect_set("keyword").alias("found"))
    own = F.coalesce("found", F.array().cast("array<string>"))
    return (banded.join(found, "Description", "left")
            .select("Description", "band",
                    F.concat(own, F.array(F.concat(F.lit("price "), "band"))).alias("marks")))


def product_encoder(keywords: list[str]) -> CountVectorizerModel:
    """Turns ``marks`` into a sparse 0/1 vector: keywords first, then price bands."""
    bands = [f"price {b}" for b in range_names(PRICE_BANDS, open_end=True)]
    return CountVectorizerModel.from_vocabulary([*keywords, *bands], "marks", "features").setBinary(True)


def with_product_cluster(lines: DataFrame, assigned: DataFrame) -> DataFrame:
    """Lines with ``categ_product``, null for a description without cluster.

    A hot description joins one row; Spark broadcasts the products while they are small
    and splits skewed partitions otherwise.
    """
    return lines.join(assigned.select("Description", F.col("cluster").alias("categ_product")),
                      "Description", "left")
