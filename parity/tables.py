"""Stages shared by the queries, built on demand from one folder of tables."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillroll.operators import basket, cancel, classify, cluster, features, keywords, lines, metrics, product
from tillroll.operators.smote import smote
from tillroll.plans import period, segments
from tillroll.session import materialize, place
from tillroll.sources.invoices import from_star_schema

CUTOFF = datetime(2000, 9, 1)


class Tables:
    """Each stage that several queries read is stored once per session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def second(self) -> "LaterTables":
        """The same stages of the later window."""
        return LaterTables(self.spark, self.folder, self)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return from_star_schema(self.spark, self.folder)

    @cached_property
    def known(self) -> DataFrame:
        return lines.drop_without_customer(from_star_schema(self.spark, self.folder, with_customer=True))

    @cached_property
    def clean(self) -> DataFrame:
        return materialize(segments.clean_lines(self.known), "clean")

    @property
    def train(self) -> DataFrame:
        return lines.split_by_time(self.clean, CUTOFF)[0]

    @property
    def later(self) -> DataFrame:
        return lines.split_by_time(self.clean, CUTOFF)[1]

    @cached_property
    def matches(self) -> DataFrame:
        return materialize(cancel.match_cancels(self.train), "matches")

    @cached_property
    def cleaned(self) -> DataFrame:
        return materialize(basket.with_line_value(cancel.net_cancels(self.train, self.matches)), "cleaned")

    @cached_property
    def baskets(self) -> DataFrame:
        return materialize(basket.baskets(self.cleaned), "baskets")

    @cached_property
    def metrics(self) -> DataFrame:
        return materialize(metrics.customer_metrics(self.baskets), "metrics")

    @cached_property
    def scored(self) -> DataFrame:
        return materialize(segments.segment_customers(self.metrics), "scored")

    @cached_property
    def inventory(self) -> DataFrame:
        return materialize(keywords.keyword_inventory(self.train), "inventory")

    @cached_property
    def useful(self) -> DataFrame:
        return materialize(keywords.useful_keywords(self.inventory), "useful")

    @cached_property
    def banded(self) -> DataFrame:
        return materialize(product.with_price_band(product.mean_prices(self.cleaned)), "banded")

    @cached_property
    def hits(self) -> DataFrame:
        return materialize(keywords.keyword_hits(self.banded, self.useful), "hits")

    @cached_property
    def assigned(self) -> DataFrame:
        """Products in five groups by a rule that SQL can repeat."""
        return self.banded.select("Description", (F.length("Description") % 5).alias("cluster"))

    @property
    def categorised(self) -> DataFrame:
        """Not stored: every query reads it once."""
        return basket.with_category_spend(product.with_product_cluster(self.cleaned, self.assigned))

    @cached_property
    def stats(self) -> DataFrame:
        return materialize(basket.basket_stats(basket.baskets(self.categorised)), "stats")

    @cached_property
    def features(self) -> DataFrame:
        """Features with a cluster column by a rule that SQL can repeat."""
        joined = features.customer_features(self.scored, self.stats)
        return materialize(joined.withColumn("cluster", (F.col("CustomerID") % 3).cast("int")), "features")

    @cached_property
    def scaled(self) -> DataFrame:
        table = self.features.drop("cluster")
        return materialize(features.fit_scaling(table).transform(table), "scaled")

    @cached_property
    def product_vectors(self) -> DataFrame:
        words = [r.keyword for r in self.useful.orderBy(F.desc("n"), "keyword").collect()]
        marks = product.product_marks(self.banded, self.hits)
        return materialize(product.product_encoder(words).transform(marks).drop("marks"), "products")

    @cached_property
    def labelled(self) -> DataFrame:
        """Customers with the label their k-means cluster gives them."""
        model = cluster.fit_kmeans(self.scaled, 3, restarts=10)
        found = model.transform(self.scaled).withColumn("label", F.col("cluster").cast("double"))
        return materialize(found.select("CustomerID", "label", "features"), "labelled")

    @cached_property
    def learning(self) -> tuple[DataFrame, DataFrame]:
        train, test = features.split_by_id(self.labelled, "CustomerID")
        return materialize(smote(train), "train"), materialize(test, "test")

    @cached_property
    def placed_later(self) -> DataFrame:
        """Models fitted on the first period, stored, loaded and applied to the later one."""
        fitted = period.fit_period(self.train, models={"svm": classify.fit_svm})
        path = place(self.spark, "models")
        fitted.save(path)
        return materialize(period.score_period(self.later, period.load(self.spark, path), "svm", on_ties="drop"), "placed")

    @cached_property
    def points(self) -> DataFrame:
        return self.source("embeddings")

    @cached_property
    def placed(self) -> DataFrame:
        """Every embedding with the label whose mean vector is nearest."""
        size = self.points.select(F.size("embedding").alias("n")).first().n
        centers = (self.points.groupBy("label").agg(F.array(*[
            F.avg(F.col("embedding")[i].cast("double")) for i in range(size)]).alias("c"))
            .orderBy("label").collect())
        labels = F.array(*[F.lit(r.label) for r in centers])
        index = cluster.nearest_center(F.col("embedding").cast("array<double>"), [r.c for r in centers])
        return materialize(self.points.select("vec_id", "label", labels[index].alias("prediction")), "placed")


class LaterTables(Tables):
    """All stages of the later window, from the same cleaned lines."""

    def __init__(self, spark: SparkSession, folder: str, first: Tables):
        super().__init__(spark, folder)
        self.first = first

    @property
    def train(self) -> DataFrame:
        return self.first.later

    @cached_property
    def scored(self) -> DataFrame:
        return materialize(segments.segment_customers(self.metrics, on_ties="drop"), "scored")


_STORE: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORE:
        _STORE[key] = Tables(spark, folder)
    return _STORE[key]


def forget() -> None:
    """Start over, so that the next query computes all of its stages."""
    _STORE.clear()


def _plain(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        shown = c.cast("string")
        c = F.rpad(F.when(F.length(shown) == 19, F.concat(shown, F.lit("."))).otherwise(shown), 26, "0")
    elif isinstance(kind, T.DateType):
        c = c.cast("string")
    elif isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        c = F.round(c.cast("double"), 6) + F.lit(0.0)
    elif isinstance(kind, T.IntegralType):
        c = c.cast("bigint")
    elif isinstance(kind, T.ArrayType):
        c = F.concat_ws(",", c.cast("array<string>"))
    return c.alias(field.name)


def plain(df: DataFrame) -> DataFrame:
    """Same rows in types that compare easily: BIGINT, DOUBLE (6 digits) and STRING."""
    return df.select(*[_plain(f) for f in df.schema])
