"""Fit segments and classifiers on one period, place the customers of a later one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.operators import (basket, cancel, classify, cluster, evaluation, features, keywords,
                                metrics, product, score)
from tillroll.operators.smote import bounded, smote
from tillroll.plans.segments import combine_metrics
from tillroll.schema import CATEGORIES
from tillroll.session import materialize


@dataclass(frozen=True)
class Window:
    """One period of clean lines on its way to customer features."""

    cleaned: DataFrame
    banded: DataFrame
    scored: DataFrame
    rules: score.ScoreRules
    descriptions: DataFrame


def open_window(lines: DataFrame, rules: score.ScoreRules | None = None, on_ties: str = "raise",
                parity: bool = False) -> Window:
    stored = materialize(lines, "lines")
    cleaned = materialize(basket.with_line_value(cancel.net_cancels(stored)), "cleaned")
    combined = combine_metrics(metrics.customer_metrics(basket.baskets(cleaned)))
    rules = rules or score.fit_rules(combined, on_ties)
    banded = materialize(product.with_price_band(product.mean_prices(cleaned), parity), "banded")
    return Window(cleaned, banded, score.score_customers(combined, rules), rules,
                  stored.select("Description"))


def useful_keywords(window: Window, stop_words: DataFrame | None = None) -> DataFrame:
    return materialize(keywords.useful_keywords(
        keywords.keyword_inventory(window.descriptions, stop_words=stop_words)), "keywords")


def fit_products(window: Window, useful: DataFrame, k: int = CATEGORIES, restarts: int = 30, seed: int = 1) -> PipelineModel:
    """Encoder and clusters of the products of a window.

    The keyword list becomes the encoder's vocabulary, which every fit needs as a whole;
    it grows with the language, not with the lines.
    """
    words = [r.keyword for r in useful.orderBy(F.desc("n"), "keyword").collect()]
    encoder = product.product_encoder(words)
    hits = keywords.keyword_hits(window.banded, useful)
    vectors = materialize(encoder.transform(product.product_marks(window.banded, hits)), "products")
    model, _ = cluster.fit_until_separated(vectors, k, restarts, seed=seed)
    return PipelineModel([encoder, model])


def assign_products(window: Window, model: PipelineModel, useful: DataFrame) -> DataFrame:
    """(Description, cluster) of the window's products under a fitted model and its table of keywords."""
    hits = keywords.keyword_hits(window.banded, useful)
    return model.transform(product.product_marks(window.banded, hits)).select("Description", "cluster")


def window_features(window: Window, assigned: DataFrame) -> DataFrame:
    lines = basket.with_category_spend(product.with_product_cluster(window.cleaned, assigned))
    stats = basket.basket_stats(basket.baskets(lines))
    return materialize(features.customer_features(window.scored, stats), "features")


@dataclass(frozen=True)
class Fitted:
    """What a period leaves behind: product clusters, scaler with segments, classifiers."""

    products: PipelineModel
    segmenter: PipelineModel
    classifiers: dict[str, object]
    rules: score.ScoreRules
    names: dict[int, str]
    comparison: DataFrame | None
    keywords: DataFrame

    def save(self, path: str) -> None:
        self.products.write().overwrite().save(f"{path}/products")
        self.segmenter.write().overwrite().save(f"{path}/segmenter")
        spark = self.comparison.sparkSession
        for name, model in self.classifiers.items():
            classify.save_model(spark, model, f"{path}/{name}")
        self.keywords.write.mode("overwrite").parquet(f"{path}/keywords")
        names = [[cluster_id, name] for cluster_id, name in self.names.items()]
        state = {"rules": score.rules_to_plain(self.rules), "names": names, "classifiers": sorted(self.classifiers)}
        classify._save_text(spark, f"{path}/state", state)


def load(spark: SparkSession, path: str, only: list[str] | None = None) -> Fitted:
    """What :meth:`Fitted.save` wrote, with all classifiers or those named; the comparison is not stored."""
    state = classify._load_text(spark, f"{path}/state")
    return Fitted(PipelineModel.load(f"{path}/products"), PipelineModel.load(f"{path}/segmenter"),
                  {name: classify.load_model(spark, f"{path}/{name}") for name in only or state["classifiers"]},
                  score.rules_from_plain(state["rules"]), dict(map(tuple, state["names"])), None, spark.read.parquet(f"{path}/keywords"))


def learning_sets(labelled: DataFrame, smote_before_split: bool = False, seed: int = 0, most_rows: int | None = None,
                  ) -> tuple[DataFrame, DataFrame]:
    """(train, test) with balanced classes in train, from all rows, or from at most ``most_rows`` of each class if asked for.

    Such a bound holds for fitting only; every row of a period is scored.

    Splitting comes first, so no test row has synthetic neighbours in train.
    ``smote_before_split`` does it the other way round and balances test as well.
    """
    if most_rows is not None:
        labelled = materialize(bounded(labelled, most_rows, seed=seed), "bounded")
    if smote_before_split:
        balanced = smote(labelled, seed=seed)
        row = F.xxhash64(vector_to_array("features"), "synthetic")
        train, test = features.split_by_id(balanced.withColumn("row", row), "row", seed=seed)
        return train.drop("row"), test.drop("row")
    train, test = features.split_by_id(labelled, "CustomerID", seed=seed)
    return smote(train, seed=seed), test


def fit_period(lines: DataFrame, k: int = 3, restarts: int = 10, product_restarts: int = 30,
               models: dict[str, classify.Fitter] = classify.MODELS, seed: int = 1,
               smote_before_split: bool = False, on_ties: str = "raise", most_rows: int | None = None) -> Fitted:
    """Everything the later period needs, from the clean lines of the first one.

    Classifiers are fitted on all rows, or on at most ``most_rows`` of each class if asked for.
    """
    window = open_window(lines, on_ties=on_ties)
    useful = useful_keywords(window)
    products = fit_products(window, useful, restarts=product_restarts, seed=seed)
    table = window_features(window, assign_products(window, products, useful))
    scaling = features.fit_scaling(table)
    scaled = materialize(scaling.transform(table), "scaled")
    clusters = cluster.fit_kmeans(scaled, k, restarts, seed)
    labelled = materialize(clusters.transform(scaled).withColumn("label", F.col("cluster").cast("double")), "labelled")
    names = cluster.names_by_spend(cluster.cluster_profile(labelled, ["MonetaryValue"], by="MonetaryValue"), by="MonetaryValue")
    train, test = learning_sets(labelled, smote_before_split, most_rows=most_rows)
    comparison, fitted = classify.compare(materialize(train, "train"), materialize(test, "test"), models)
    segmenter = PipelineModel([*scaling.stages(), clusters])
    return Fitted(products, segmenter, fitted, window.rules, names, comparison, useful)


def score_period(lines: DataFrame, fitted: Fitted, classifier: str, refit_products: bool = False, balanced: bool = False,
                 same_rules: bool = False, on_ties: str = "raise") -> DataFrame:
    """Customers of a later period with label (stored clusters), segment (its name) and prediction (classifier).

    By default products keep their clusters, quartiles are those of the new window and the
    rows are the real customers, all of them. ``refit_products`` clusters products anew, ``same_rules``
    scores with the edges of the first window, ``balanced`` adds the weights with which all
    labels count alike, in place of synthetic rows.
    """
    window = open_window(lines, fitted.rules if same_rules else None, on_ties)
    useful, products = fitted.keywords, fitted.products
    if refit_products:
        useful = useful_keywords(window)
        products = fit_products(window, useful)
    table = fitted.segmenter.transform(window_features(window, assign_products(window, products, useful)))
    table = cluster.with_segment(table, fitted.names).withColumn("label", F.col("cluster").cast("double"))
    table = materialize(table.select("CustomerID", "label", "segment", "features"), "later")
    predicted = fitted.classifiers[classifier].transform(evaluation.balancing_weights(table) if balanced else table)
    return predicted.select(*[c for c in ("CustomerID", "label", "segment", "weight", "prediction") if c in predicted.columns])


def period_quality(predicted: DataFrame) -> DataFrame:
    """Accuracy, weighted and macro scores of a scored period, by the weights if it has some."""
    return evaluation.scores(evaluation.confusion(predicted, weight="weight" if "weight" in predicted.columns else None))
