"""Options of the two-period plan, and a session with foreign defaults."""

import glob
from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from parity.tables import tables
from tillroll.operators import classify
from tillroll.operators.smote import bounded
from tillroll.plans import period
from tillroll.session import materialize, stages


def test_options_of_the_original_method(spark, small):
    t = tables(spark, small)
    fitted = period.fit_period(t.train, restarts=2, product_restarts=2, smote_before_split=True,
                               models={"adaboost": partial(classify.fit_adaboost, rounds=5)})
    assert fitted.comparison.first().accuracy > 0.5 and sorted(fitted.names.values()) == ["bronze", "gold", "silver"]
    later = period.score_period(t.later, fitted, "adaboost", same_rules=True, balanced=True)
    assert set(later.columns) == {"CustomerID", "label", "segment", "weight", "prediction"} and later.count() > 0
    sums = [r.w for r in later.groupBy("label").agg(F.sum("weight").alias("w")).collect()]
    assert max(sums) - min(sums) < 1e-6 * max(sums)
    quality = period.period_quality(later).first()
    assert 0 <= quality.accuracy <= 1


def test_everything_fitted_is_stored(spark, small, tmp_path):
    t = tables(spark, small)
    kinds = {"svm": classify.fit_svm, "pairwise": classify.fit_pairwise_svm, "boost": partial(classify.fit_adaboost, rounds=3),
             "tree": classify.fit_tree, "forest": partial(classify.fit_forest, trees=3)}
    fitted = period.fit_period(t.train, restarts=2, product_restarts=2, models=kinds)
    fitted.save(str(tmp_path / "m"))
    again = period.load(spark, str(tmp_path / "m"))
    assert again.names == fitted.names and again.rules == fitted.rules and set(again.classifiers) == set(kinds)
    _, test = period.learning_sets(t.labelled)
    for name in kinds:
        old, new = (m.classifiers[name].transform(test).select("CustomerID", "prediction").collect() for m in (fitted, again))
        assert sorted(old) == sorted(new)


def test_rows_for_fitting_are_bounded(spark, small):
    t = tables(spark, small)
    few = bounded(t.labelled, 20)
    counts = {r.label: r["count"] for r in few.groupBy("label").count().collect()}
    whole = {r.label: r["count"] for r in t.labelled.groupBy("label").count().collect()}
    assert counts == {k: min(20, n) for k, n in whole.items()}
    assert bounded(t.labelled, 10**6).count() == t.labelled.count()


def test_classifiers_learn_from_all_rows(spark):
    table = spark.range(50_200).select(F.col("id").alias("CustomerID"), (F.col("id") >= 50_100).cast("double").alias("label"),
                                       array_to_vector(F.array(F.col("id") / 1000.0, F.lit(1.0))).alias("features"))
    train, test = period.learning_sets(materialize(table, "many"))
    real = train.where("NOT synthetic").select("label").unionByName(test.select("label"))
    assert {r.label: r["count"] for r in real.groupBy("label").count().collect()} == {0.0: 50_100, 1.0: 100}


def test_stages_are_removed_after_a_scope(spark, tmp_path):
    with stages(spark) as folder:
        assert materialize(spark.range(5), "x").count() == 5
        assert glob.glob(f"{folder}/*")
    assert not glob.glob(folder)
