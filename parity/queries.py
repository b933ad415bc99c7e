"""One query per operator; names match the statements in ``parity.sql``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parity.tables import Tables, plain, tables
from tillroll.functions.bands import CLOSENESS, LOWEST_CLOSENESS
from tillroll.functions.vectors import numbers
from tillroll.operators import (basket, cancel, classify, cluster, distinct, evaluation, features, keywords,
                                kmeans, lines, metrics, outlier, product, score, silhouette, ward)
from tillroll.operators.density import density
from tillroll.operators.smote import smote
from tillroll.operators.splits import best_splits, fit_exact_tree
from tillroll.plans import segments
from tillroll.schema import FEATURES, LINE_COLUMNS
from tillroll.session import place
from tillroll.sources import invoices

Query = Callable[[SparkSession, str], DataFrame]
CATEGORIES = [f"categ_{i}" for i in range(5)]
SCORED = ["CustomerID", "Recency", "Frequency", "MonetaryValue", "Lenght", "R", "F", "M", "L",
          "Proximidade_Marca_Score", "RFML_Segment_Concat", "RFML_Score", "RFML_Level", "Proximidade_Marca"]

SCORED_NUMBERS = ["Recency", "Frequency", "MonetaryValue", "Lenght", "R", "F", "M", "L", "Proximidade_Marca_Score", "RFML_Score"]

BY_NAME: dict[str, Callable[[Tables], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    BY_NAME[build.__name__] = build
    return build


def simple(name: str, build: Callable[[Tables], DataFrame]) -> None:
    BY_NAME[name] = build


# sources and inspection
simple("invoice_lines", lambda t: t.raw)
simple("table_size", lambda t: lines.table_size(t.raw))
simple("preview_by_customer", lambda t: lines.preview(t.train, ["CustomerID"], 5))
simple("column_profile", lambda t: lines.column_profile(t.raw))
simple("constant_columns", lambda t: lines.constant_columns(t.raw))

# cleaning
simple("lines_with_customer", lambda t: t.known)
simple("duplicate_count", lambda t: lines.duplicate_count(t.known))
simple("duplicate_lines", lambda t: lines.duplicate_lines(t.known))
simple("deduplicated_lines", lambda t: lines.deduplicate(t.known))
simple("no_duplicates_left", lambda t: lines.duplicate_count(t.clean))
simple("negative_prices", lambda t: lines.negative_prices(t.known))
simple("training_lines", lambda t: t.train)
simple("later_lines", lambda t: t.later)
simple("column_selection", lambda t: t.train.where("Quantity < 0").select(
    "CustomerID", "Quantity", "StockCode", "Description", "UnitPrice"))
simple("customer_lookup", lambda t: lines.lookup(t.train, CustomerID=7))
simple("renamed_columns", lambda t: lines.rename(
    cancel.lines_per_basket(t.train),
    {"CustomerID": "customer", "InvoiceNo": "invoice", "n_products": "products"}, ["order_canceled"]))
simple("orders_per_country", lambda t: lines.orders_per_country(t.train))
simple("distinct_totals", lambda t: lines.distinct_totals(t.train))
simple("special_stock_codes", lambda t: lines.special_codes(t.cleaned))
simple("distinct_descriptions", lambda t: lines.distinct_values(t.cleaned, "Description"))


@query
def date_ranges(t: Tables) -> DataFrame:
    parts = [lines.date_range(df).select(F.lit(name).alias("part"), "*")
             for name, df in (("train", t.train), ("later", t.later))]
    return parts[0].unionByName(parts[1])


# cancellations
simple("lines_per_basket", lambda t: cancel.lines_per_basket(t.train))
simple("cancelled_order_rate", lambda t: cancel.cancelled_orders(cancel.lines_per_basket(t.train)))
simple("returns_without_counterpart", lambda t: cancel.without_counterpart(t.train))
simple("returns_without_counterpart_no_discount",
       lambda t: cancel.without_counterpart(t.train, skip_discounts=True))
simple("returns_without_counterpart_by_stock_code",
       lambda t: cancel.without_counterpart(t.train, by="StockCode"))
simple("first_return_without_counterpart", lambda t: cancel.first_without_counterpart(t.train))
simple("cancel_census", lambda t: cancel.cancel_census(t.matches))
simple("doubtful_cancels", lambda t: cancel.doubtful_cancels(t.train, t.matches))
simple("matched_cancels", lambda t: cancel.matched_cancels(t.train, t.matches))
simple("netted_lines", lambda t: basket.with_line_value(cancel.net_cancels(t.train)))
simple("remaining_returns", lambda t: cancel.remaining_returns(t.cleaned))


@query
def cancel_matches(t: Tables) -> DataFrame:
    order = "order_line"
    return cancel.cancel_lines(t.train, t.matches).select(
        *LINE_COLUMNS, "status", "n_candidates", F.col(f"{order}.InvoiceNo").alias("order_invoice"),
        F.col(f"{order}.Quantity").alias("order_quantity"), F.col(f"{order}.InvoiceDate").alias("order_date"))


# baskets and metrics
simple("baskets", lambda t: basket.baskets(t.cleaned))
simple("order_value_ranges", lambda t: basket.order_ranges(t.baskets))
simple("customer_metrics", lambda t: metrics.customer_metrics(t.baskets))
simple("recency_frequency_monetary", lambda t: metrics.rfm(t.metrics))
simple("relationship_length", lambda t: metrics.length(t.metrics))
simple("snapshot_date", lambda t: metrics.snapshot(t.baskets))
simple("customer_reconciliation", lambda t: metrics.reconciliation(t.baskets))

# outliers and distributions
simple("rfm_without_outliers", lambda t: outlier.remove_outliers_iqr(
    metrics.rfm(t.metrics), ["Recency", "Frequency", "MonetaryValue"]))
simple("length_without_outliers", lambda t: outlier.remove_outliers_iqr(metrics.length(t.metrics)))
simple("metric_description", lambda t: outlier.describe(t.metrics, ["Recency", "Frequency", "MonetaryValue"]))
simple("monetary_box", lambda t: outlier.box_stats(t.metrics, "MonetaryValue"))
simple("recency_box_by_score", lambda t: outlier.box_stats(t.scored, "Recency", "R"))
simple("monetary_box_by_level", lambda t: outlier.box_stats(t.scored, "MonetaryValue", "RFML_Level"))
simple("monetary_histogram", lambda t: outlier.histogram(t.metrics, "MonetaryValue"))
simple("frequent_customers_below_30", lambda t: t.scored.where("Frequency < 30").select(*SCORED))

# scores
simple("rfm_with_length", lambda t: t.scored.select(*SCORED[:5]))
simple("scored_customers", lambda t: segments.segments(t.train).select(*SCORED))
simple("segment_count", lambda t: score.segment_count(t.scored))
simple("level_profile", lambda t: score.level_profile(t.scored))
simple("level_frequencies", lambda t: score.frequencies(t.scored, "RFML_Level"))
simple("customer_key_check", lambda t: lines.key_repeats(t.metrics, "CustomerID"))


@query
def quartile_by_value(t: Tables) -> DataFrame:
    return t.scored.select("CustomerID", "Recency", "MonetaryValue",
                           score.quartile_by_value(t.scored, "Recency", score.DESCENDING).alias("R"),
                           score.quartile_by_value(t.scored, "MonetaryValue", score.ASCENDING).alias("M"))


@query
def quartile_by_rank(t: Tables) -> DataFrame:
    return t.scored.select("CustomerID", "Frequency", "Lenght",
                           score.quartile_by_rank(t.scored, "Frequency").alias("F"),
                           score.quartile_by_rank(t.scored, "Lenght").alias("L"))


@query
def score_counts(t: Tables) -> DataFrame:
    """All four scores from one pass: unpivot, then count."""
    long = t.scored.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in "RFML"])))
    return long.groupBy("score", "value").agg(F.count("*").alias("n"))


@query
def level_by_closeness(t: Tables) -> DataFrame:
    names = dict(zip([v for _, v in CLOSENESS] + [LOWEST_CLOSENESS], ["leal", "fidelizacao", "regular", "novos"]))
    return score.crosstab(t.scored, "RFML_Level", "Proximidade_Marca", list(names)).withColumnsRenamed(names)


# text and products
simple("keyword_inventory", lambda t: keywords.keyword_inventory(t.train))
simple("document_keyword_inventory", lambda t: keywords.keyword_inventory(t.source("documents"), "text"))
simple("top_keywords", lambda t: keywords.top_keywords(t.inventory))
simple("useful_keywords", lambda t: keywords.useful_keywords(t.inventory))
simple("product_keyword_hits", lambda t: keywords.keyword_hits(t.banded, t.useful))
simple("mean_product_prices", lambda t: product.mean_prices(t.cleaned))
simple("price_band_columns", lambda t: product.band_columns(t.banded))
simple("price_band_counts", lambda t: product.band_counts(t.banded))
simple("cluster_keywords", lambda t: keywords.cluster_keywords(t.hits, t.assigned))
simple("category_spend_per_line", lambda t: basket.with_category_spend(
    product.with_product_cluster(t.cleaned, t.assigned)).select(
        "InvoiceNo", "Description", "categ_product", *CATEGORIES))
simple("category_baskets", lambda t: basket.baskets(t.categorised).drop("InvoiceDate"))
simple("basket_statistics", lambda t: basket.basket_stats(basket.baskets(t.categorised)))


@query
def description_words(t: Tables) -> DataFrame:
    return keywords.description_words(t.train).groupBy("text", "word").agg(F.count("*").alias("n"))


@query
def words_without_stop_words(t: Tables) -> DataFrame:
    stop = t.source("part").select(F.lower("p_type").alias("word")).distinct()
    return (keywords.description_words(t.train, stop_words=stop).groupBy("word")
            .agg(F.count("*").alias("n")))


# features and clusters
simple("customer_features", lambda t: features.customer_features(t.scored, t.stats).select(
    "CustomerID", "RFML_Level", *FEATURES))
simple("feature_scaling", lambda t: features.fit_scaling(t.features).report(t.features))
simple("cluster_profile", lambda t: cluster.cluster_profile(t.features, ["sum", *FEATURES]))
simple("cluster_drill_down", lambda t: cluster.cluster_means(t.features, 2, ["RFML_Score", "categ_1"]))
simple("nearest_center", lambda t: t.placed)
simple("row_silhouettes", lambda t: cluster.silhouettes(t.points, "embedding", "label").drop("embedding"))


@query
def segment_names(t: Tables) -> DataFrame:
    names = cluster.names_by_spend(cluster.cluster_profile(t.features, ["sum"]))
    return score.frequencies(cluster.with_segment(t.features, names), "segment")


@query
def single_cluster_cost(t: Tables) -> DataFrame:
    vectors = t.points.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return t.spark.createDataFrame([(1, cluster.single_cluster_cost(vectors))], "k int, wcss double")


# evaluation
simple("confusion_table", lambda t: evaluation.confusion(t.placed))
simple("confusion_with_totals", lambda t: score.crosstab_with_totals(t.placed, "prediction", "label"))
simple("class_report", lambda t: evaluation.class_report(evaluation.confusion(t.placed)))
simple("classifier_scores", lambda t: evaluation.scores(evaluation.confusion(t.placed)))
simple("accuracy", lambda t: evaluation.accuracy(t.placed))
simple("class_balance", lambda t: lines.value_counts(t.source("labels").select("quality"), "quality"))


simple("product_vectors", lambda t: _vectors(t.product_vectors, "Description"))
simple("feature_vectors", lambda t: _vectors(features.assemble(t.features), "CustomerID", "raw_features"))
simple("standardised_features", lambda t: _vectors(t.scaled, "CustomerID"))


@query
def balanced_classes(t: Tables) -> DataFrame:
    vectors = t.points.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return smote(vectors, key="vec_id").groupBy("label", "synthetic").agg(F.count("*").alias("n"))


# models: no SQL says what a fit must give, so these have no statement
simple("product_cluster_sweep", lambda t: cluster.kmeans_sweep(t.product_vectors, restarts=30))
simple("product_components", lambda t: features.fit_components(t.product_vectors).explained(t.spark))
simple("product_projection", lambda t: _vectors(
    features.fit_components(t.product_vectors, _at_most(t.product_vectors, 50)).transform(t.product_vectors),
    "Description", "pca"))
simple("customer_components", lambda t: features.fit_components(t.scaled).explained(t.spark))
simple("customer_projection", lambda t: _vectors(
    features.fit_components(t.scaled, 2).transform(t.scaled), "CustomerID", "pca"))
simple("customer_cluster_sweep", lambda t: cluster.kmeans_sweep(t.scaled))
simple("hierarchical_sweep", lambda t: cluster.hierarchical_sweep(t.scaled))
simple("customer_clusters", lambda t: t.labelled.select("CustomerID", "label"))
simple("hierarchical_clusters", lambda t: cluster.fit_hierarchical(t.scaled).transform(t.scaled).select(
    "CustomerID", "cluster"))
simple("customer_silhouettes", lambda t: cluster.silhouettes(t.labelled, cluster="label").drop("features"))
simple("linear_svm", lambda t: _predictions(t, classify.fit_svm))
simple("linear_svm_pairwise", lambda t: _predictions(t, classify.fit_pairwise_svm))
simple("adaboost", lambda t: _predictions(t, classify.fit_adaboost))
simple("decision_tree_gini", lambda t: _predictions(t, lambda df: classify.fit_tree(df, "gini")))
simple("decision_tree_entropy", lambda t: _predictions(t, classify.fit_tree))
simple("random_forest", lambda t: _predictions(t, classify.fit_forest))
simple("model_comparison", lambda t: classify.compare(*t.learning)[0])


def _vectors(df: DataFrame, key: str, column: str = "features") -> DataFrame:
    """One row per vector entry that is not 0."""
    return df.select(key, F.posexplode(vector_to_array(column)).alias("position", "value")).where("value <> 0")


def _at_most(vectors: DataFrame, k: int) -> int:
    """Components asked for, or as many as the vectors have entries."""
    return min(k, vectors.select(F.size(vector_to_array("features")).alias("n")).first().n)


def _predictions(t: Tables, fit: classify.Fitter) -> DataFrame:
    train, test = t.learning
    return fit(train).transform(test).select("CustomerID", "label", "prediction")


@query
def product_clusters(t: Tables) -> DataFrame:
    """Five product groups: the cheapest of 30 fits."""
    model, _ = cluster.fit_until_separated(t.product_vectors, 5)
    return model.transform(t.product_vectors).select("Description", "cluster")


@query
def random_split(t: Tables) -> DataFrame:
    train, test = features.split_by_id(t.metrics, "CustomerID")
    return (train.select("CustomerID", F.lit("train").alias("part"))
            .unionByName(test.select("CustomerID", F.lit("test").alias("part"))))


simple("later_period", lambda t: t.placed_later)


# the CSV source: the lines written as text and read back
@query
def invoice_lines_csv(t: Tables) -> DataFrame:
    path = place(t.spark, "csv")
    dated = t.raw.withColumn("InvoiceDate", F.date_format("InvoiceDate", "M/d/yyyy H:mm"))
    dated.select(*reversed(LINE_COLUMNS)).write.option("header", True).option("escape", '"').csv(path)
    return invoices.read_csv(t.spark, path, encoding="UTF-8")


# the later window, step by step
LATER = ["lines_per_basket", "cancelled_order_rate", "netted_lines", "baskets", "order_value_ranges", "customer_metrics",
         "rfm_without_outliers", "length_without_outliers", "metric_description", "mean_product_prices", "price_band_counts",
         "keyword_inventory", "customer_reconciliation"]
for _name in LATER:
    simple(f"later_{_name}", lambda t, build=BY_NAME[_name]: build(t.second))

simple("line_reconciliation", lambda t: metrics.line_reconciliation(t.categorised))
simple("later_line_reconciliation", lambda t: metrics.line_reconciliation(t.second.categorised))

# more distributions
simple("scored_description", lambda t: outlier.describe(t.scored, SCORED_NUMBERS))
simple("recency_histogram", lambda t: outlier.histogram(t.metrics, "Recency"))
simple("frequency_histogram", lambda t: outlier.histogram(t.metrics, "Frequency"))
simple("length_histogram", lambda t: outlier.histogram(t.metrics, "Lenght"))
simple("monetary_box_by_level_and_closeness", lambda t: outlier.box_stats(t.scored.withColumn(
    "level_closeness", F.concat_ws("|", "RFML_Level", "Proximidade_Marca")), "MonetaryValue", "level_closeness"))
simple("cluster_profile_report", lambda t: cluster.profile_report(cluster.cluster_profile(t.features, ["sum", *FEATURES])))


# density curves
simple("recency_density", lambda t: density(t.metrics, "Recency"))
simple("frequency_density", lambda t: density(t.metrics, "Frequency"))
simple("monetary_density", lambda t: density(t.metrics, "MonetaryValue"))
simple("length_density", lambda t: density(t.metrics, "Lenght"))

# Euclidean silhouettes, and Ward's clusters
simple("row_euclidean_silhouettes", lambda t: silhouette.euclidean_silhouettes(t.points, "vec_id", "embedding", "label"))
simple("ward_sweep", lambda t: ward.ward_sweep(t.scaled))
simple("ward_linkage", lambda t: ward.fit_ward(t.scaled).linkage(t.spark))
simple("ward_clusters", lambda t: ward.fit_ward(t.scaled).transform(t.scaled, 3).select("CustomerID", "cluster"))


@query
def embedding_silhouette(t: Tables) -> DataFrame:
    """Mean Euclidean silhouette of the labels, with its standard error."""
    found = silhouette.mean_euclidean_silhouette(t.points, "embedding", "label")
    return t.spark.createDataFrame([(found.mean, found.error, found.sampled, found.rows)], "mean double, error double, sampled long, rows long")


@query
def ward_total(t: Tables) -> DataFrame:
    """The costs of all merges, and the spread inside the summaries, add up to the spread of the table."""
    n, total = ward.fit_ward(t.scaled).spread()
    return t.spark.createDataFrame([(n, round(total, 4))], "n long, total double")


@query
def cluster_cost_split(t: Tables) -> DataFrame:
    """For each k: costs inside the clusters of the best of ten fits and between their means add up to the spread of the table."""
    runs = kmeans.fit_runs(t.scaled, range(2, 10), 10)
    chosen = [min((r for r in runs if r.k == k), key=lambda r: r.cost) for k in range(2, 10)]
    rows = []
    for run, (sizes, costs, sums) in zip(chosen, kmeans.features_of(t.scaled.select(numbers(t.scaled, "features").alias("x")), [r.centers for r in chosen])):
        means, grand = sums / sizes[:, None], sums.sum(0) / sizes.sum()
        inside = costs.sum() - (sizes * ((means - run.centers) ** 2).sum(1)).sum()
        rows.append((run.k, int(sizes.sum()), round(float(inside + (sizes * ((means - grand) ** 2).sum(1)).sum()), 4)))
    return t.spark.createDataFrame(rows, "k int, n long, total double")


# distinct counts from stored sketches of days
@query
def period_totals_from_sketches(t: Tables) -> DataFrame:
    """Totals of a year from the sketches of its days, beside the exact ones: lines, and whether estimates lie within 4 standard errors."""
    path = place(t.spark, "sketches")
    distinct.daily_sketches(t.known).write.parquet(path)
    year = F.col("InvoiceDate").between("1997-01-01", "1997-12-31 23:59:59")
    found = distinct.period_totals(t.spark.read.parquet(path), "1997-01-01", "1997-12-31")
    exact = t.known.where(year).agg(*[F.count_distinct(c).alias(f"exact_{n}") for n, c in distinct.TOTALS.items()])
    near = [(F.abs(F.col(n) - F.col(f"exact_{n}")) <= 4 * 1.04 / 2 ** (distinct.SIZE / 2) * F.col(f"exact_{n}") + 1).alias(f"{n}_near") for n in distinct.TOTALS]
    return found.join(exact).select("n_lines", *[F.col(f"exact_{n}") for n in distinct.TOTALS], *near)  # one row each


# exact thresholds of trees
def _first_split(impurity: str) -> Callable[[Tables], DataFrame]:
    def build(t: Tables) -> DataFrame:
        rows = t.points.select(F.lit(0).alias("node"), F.col("embedding").cast("array<double>").alias("x"), "label")
        classes = sorted(r.label for r in rows.select("label").distinct().where("label IS NOT NULL").collect())
        found = best_splits(rows, classes, impurity)
        return found.select("feature", "threshold", F.round("impurity", 8).alias("impurity"), "n_left", "n")
    return build


simple("best_splits_gini", _first_split("gini"))
simple("best_splits_entropy", _first_split("entropy"))


@query
def exact_tree_facts(t: Tables) -> DataFrame:
    """Trees grown to the end over all thresholds give every customer their own cluster."""
    parts = [fit_exact_tree(t.labelled, impurity).transform(t.labelled).agg(
        F.lit(impurity).alias("impurity"), F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("long")).alias("right"))
        for impurity in ("gini", "entropy")]
    return reduce(DataFrame.unionByName, parts)


# what must hold for any fit, so that SQL can state it
@query
def hierarchical_counts(t: Tables) -> DataFrame:
    """For each k: clusters found and rows placed."""
    parts = [cluster.fit_hierarchical(t.scaled, k).transform(t.scaled).agg(
        F.lit(k).alias("k"), F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n")) for k in (2, 3, 5, 8)]
    return reduce(DataFrame.unionByName, parts)


@query
def customer_cluster_facts(t: Tables) -> DataFrame:
    return t.labelled.agg(F.count("*").alias("n"), F.count_distinct("label").alias("clusters"),
                          F.count_distinct("CustomerID").alias("customers"))


@query
def random_split_facts(t: Tables) -> DataFrame:
    """A split leaves no customer out and none twice, and has about the share asked for."""
    parts = BY_NAME["random_split"](t).groupBy("CustomerID").agg(F.count("*").alias("n"), F.max("part").alias("part"))
    share = F.avg((F.col("part") == "train").cast("double"))
    return parts.agg(F.sum("n").alias("n"), F.count("*").alias("customers"), share.between(0.5, 0.95).alias("near_share"))


@query
def component_facts(t: Tables) -> DataFrame:
    """Shares of the variance add up to 1 and do not rise."""
    found = BY_NAME["customer_components"](t)
    share, place = [c for c in found.columns if found.schema[c].dataType.simpleString() == "double"][0], found.columns[0]
    before = F.lag(share).over(Window.orderBy(place))
    return found.select(share, (F.col(share) > before + 1e-9).alias("rises")).agg(
        F.count("*").alias("components"), F.round(F.sum(share), 6).alias("total"), F.coalesce(F.max("rises"), F.lit(False)).alias("any_rise"))


@query
def projection_facts(t: Tables) -> DataFrame:
    return BY_NAME["customer_projection"](t).agg(F.count_distinct("CustomerID").alias("customers"), (F.max("position") + 1).alias("dimensions"))


@query
def sweep_facts(t: Tables) -> DataFrame:
    """Costs of k-means on the customers fall with k."""
    found = cluster.kmeans_sweep(t.scaled, range(2, 10), 10)
    before = F.lag("wcss").over(Window.orderBy("k"))
    return found.select("k", F.coalesce(F.col("wcss") < before, F.lit(True)).alias("cheaper"))


@query
def classifier_facts(t: Tables) -> DataFrame:
    """Every classifier gives each test row a known label and is right in more than half of the cases."""
    train, test = t.learning
    fits = classify.MODELS | {"svm_pairwise": classify.fit_pairwise_svm, "decision_tree_gini": lambda df: classify.fit_tree(df, "gini")}
    rows = [fit(train).transform(test).agg(
        F.lit(name).alias("model"), (F.count("*") == F.count("prediction")).alias("all_labelled"),
        F.min(F.col("prediction").isin(0.0, 1.0, 2.0)).alias("known_labels"),
        (F.avg((F.col("label") == F.col("prediction")).cast("double")) > 0.5).alias("useful")) for name, fit in fits.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def product_cluster_facts(t: Tables) -> DataFrame:
    return BY_NAME["product_clusters"](t).agg(F.count_distinct("Description").alias("products"), F.count_distinct("cluster").alias("clusters"))


@query
def customer_silhouette_facts(t: Tables) -> DataFrame:
    """The mean of the rows' silhouettes is the one Spark computes for the whole."""
    rows = cluster.silhouettes(t.labelled, cluster="label").agg(F.avg("silhouette").alias("mean"), F.count("*").alias("n"))
    whole = cluster.mean_silhouette(t.labelled, cluster="label")
    return rows.select("n", (F.abs(F.col("mean") - whole) < 1e-6).alias("same_mean"))


@query
def later_period_facts(t: Tables) -> DataFrame:
    """All customers of the later window that have features are placed, under names of segments."""
    return t.placed_later.agg((F.count("*") == F.count_distinct("CustomerID")).alias("once"), (F.count("*") > 0).alias("some"),
                     F.min(F.col("segment").isin(*cluster.SEGMENT_NAMES)).alias("named"))


simple("product_silhouettes", lambda t: cluster.silhouettes(
    t.product_vectors.join(t.assigned, "Description"), cluster="cluster").select("Description", "cluster", "silhouette"))


def registered() -> dict[str, Query]:
    def bind(build: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: plain(build(tables(spark, folder)))
    return {name: bind(build) for name, build in BY_NAME.items()}
