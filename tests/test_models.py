import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tillroll.operators import classify, cluster, evaluation, features, keywords
from tillroll.operators import smote as oversampling


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(1)
    centres = [(0.0, 0.0, 0.0), (8.0, 0.0, 1.0), (0.0, 9.0, 2.0)]
    rows = []
    for label, (c, n) in enumerate(zip(centres, (60, 35, 20))):
        rows += [(len(rows) + i, float(label), Vectors.dense([v + rng.gauss(0, 1) for v in c])) for i in range(n)]
    return spark.createDataFrame(rows, ["CustomerID", "label", "features"]).persist()


@pytest.mark.parametrize("cell_rows,copies", [(2000, 0), (15, 0), (15, 60)])
def test_neighbours_equal_brute_force(spark, cell_rows, copies):
    rng = random.Random(3)
    points = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(120)] + [[0.5] * 5] * copies
    df = spark.createDataFrame(list(enumerate(points)), "id long, x array<double>")
    found = {}
    for r in oversampling.nearest_neighbours(df, 4, cell_rows).collect():
        assert r.id != r.neighbour
        found.setdefault(r.id, []).append(r.distance)
    x = np.array(points)
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(distance, np.inf)
    assert len(found) == len(points)
    for i, row in enumerate(np.sort(distance)[:, :4]):
        assert np.allclose(sorted(found[i]), row, atol=1e-9)


def test_neighbours_of_many_blocks_equal_brute_force_from_few_candidates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)) * [1, 5, 1, 0.1]
    x[:500, 1] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(distance, np.inf)
    got = oversampling.nearest_neighbours(df, 5, 75).collect()
    assert len(got) == 5 * len(x)
    for r in got:
        assert abs(r.distance - np.sort(distance[r.id])[r.place - 1]) < 1e-9
        assert np.array_equal(r.x, x[r.neighbour])
    # 40 blocks sent on 5 * 40 rows per point
    assert oversampling._candidates(df, 5, 75).count() < 5 * 5 * len(x)


def test_smote_balances_and_stays_between_neighbours(spark, blobs):
    rows = oversampling.smote(blobs).collect()
    sizes = {c: sum(r.label == c for r in rows) for c in (0.0, 1.0, 2.0)}
    assert set(sizes.values()) == {60}
    again = oversampling.smote(blobs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for c in (1.0, 2.0):
        real = np.array([r.features.toArray() for r in rows if r.label == c and not r.synthetic])
        for s in (r.features.toArray() for r in rows if r.label == c and r.synthetic):
            gap = min(abs(np.linalg.norm(a - s) + np.linalg.norm(s - b) - np.linalg.norm(a - b))
                      for a in real for b in real)
            assert gap < 1e-9


def test_silhouettes_equal_pairwise_means_and_evaluator(spark, blobs):
    lone = spark.createDataFrame([(999, 7.0, Vectors.dense([30.0, 30.0, 30.0]))], blobs.schema)
    table = blobs.unionByName(lone)
    got = {r.CustomerID: r.silhouette for r in cluster.silhouettes(table, cluster="label").collect()}
    rows = table.collect()
    x, labels = np.array([r.features.toArray() for r in rows]), np.array([r.label for r in rows])
    squared = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i, r in enumerate(rows):
        same = labels == labels[i]
        if same.sum() == 1:
            assert got[r.CustomerID] == 0
            continue
        a = squared[i, same].sum() / (same.sum() - 1)
        b = min(squared[i, labels == c].mean() for c in set(labels) - {labels[i]})
        assert got[r.CustomerID] == pytest.approx((b - a) / max(a, b))
    assert cluster.mean_silhouette(table, cluster="label") == pytest.approx(np.mean(list(got.values())))


def test_kmeans_invariants(spark, blobs):
    sweep = cluster.kmeans_sweep(blobs, range(2, 5)).orderBy("k").collect()
    assert [r.k for r in sweep] == [1, 2, 3, 4]
    assert all(a.wcss >= b.wcss - 1e-9 for a, b in zip(sweep, sweep[1:]))
    assert all(-1 <= r.silhouette <= 1 for r in sweep[1:])
    first, second = cluster.fit_kmeans(blobs, 3, 3), cluster.fit_kmeans(blobs, 3, 3)
    assert first.summary.trainingCost == pytest.approx(second.summary.trainingCost)
    profile = cluster.cluster_profile(first.transform(blobs), ["CustomerID"], by="CustomerID")
    assert sum(r["size"] for r in profile.collect()) == 115
    names = cluster.names_by_spend(profile, by="CustomerID")
    assert sorted(names.values()) == ["bronze", "gold", "silver"]


def test_all_classifiers_separate_blobs(spark, blobs):
    train, test = features.split_by_id(blobs, "CustomerID")
    assert train.count() + test.count() == 115 and train.join(test, "CustomerID").count() == 0
    table, fitted = classify.compare(train, test, {**classify.MODELS, "pairwise": classify.fit_pairwise_svm})
    assert all(r.accuracy > 0.85 for r in table.collect()), table.collect()


def test_boosted_stumps_survive_storage(spark, blobs, tmp_path):
    model = classify.fit_adaboost(blobs, rounds=5)
    assert 1 <= len(model.stumps) <= 5
    model.save(spark, str(tmp_path / "m"))
    assert classify.BoostedStumps.load(spark, str(tmp_path / "m")) == model


def test_boosting_equals_a_plain_one_and_shuffles_nothing(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 2, (600, 3)), 1)
    y = ((x[:, 0] + x[:, 1] > 1).astype(int) + (x[:, 2] > 0.5) * 2) * 3  # classes 0, 3, 6, 9
    table = spark.createDataFrame([(float(c), Vectors.dense(r)) for r, c in zip(x.tolist(), y)], ["label", "features"]).repartition(3)
    model = classify.fit_adaboost(table, rounds=12)
    weight, classes = np.ones(len(x)), model.classes
    assert classes == [0, 3, 6, 9] and len(model.stumps) == 12
    for stump in model.stumps:
        said = np.where(x[:, stump.feature] <= stump.threshold, stump.left, stump.right)
        error = weight[said != y].sum() / weight.sum()
        assert stump.weight == pytest.approx(np.log((1 - error) / error) + np.log(3))
        sides = [x[:, stump.feature] <= stump.threshold, x[:, stump.feature] > stump.threshold]
        for side, own in zip(sides, (stump.left, stump.right)):
            sums = [weight[side & (y == c)].sum() for c in classes]
            assert sums[classes.index(own)] == pytest.approx(max(sums))
        weight = weight * np.exp(np.where(said != y, stump.weight, 0.0))
    edges = [[-1.0, 0.0, 1.0], [0.5], []]
    bins = table.select(F.col("label").cast("int").alias("label"), F.array(F.lit(2), F.lit(1), F.lit(0)).alias("bins"))
    cells = {(c.feature, c.bin, c.label): c.weight for c in classify._cells(bins, classes, edges, [classify.Stump(0, 0.0, 3, 6, 2.0)])}
    for j, i in ((0, 2), (1, 1), (2, 0)):  # all rows lie right of the stump, which says 6
        assert [cells[j, i, c] for c in classes] == pytest.approx([(y == c).sum() * (1 if c == 6 else np.exp(2)) for c in classes])
    assert cells[0, 0, 0] == cells[1, 0, 9] == 0


def test_components_are_centred(spark, blobs):
    parts = features.fit_components(blobs)
    x = np.array([r.pca.toArray() for r in parts.transform(blobs).collect()])
    assert np.allclose(x.mean(0), 0)
    data = np.array([r.features.toArray() for r in blobs.collect()])
    assert np.allclose(x.var(0), np.linalg.eigvalsh(np.cov(data.T, bias=True))[::-1])
    assert parts.explained(spark).orderBy(F.desc("component")).first().cumulative == pytest.approx(1)


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0), (None, 1.0)], "a double, b double")
    scaling = features.fit_scaling(df, ["a", "b"])
    assert scaling.deviations == pytest.approx([np.std([1, 2, 6]), 0])
    by_rows = sorted(r.features.toArray()[0] for r in scaling.transform(df).collect())
    from pyspark.ml import PipelineModel
    by_stages = sorted(r.features.toArray()[0] for r in PipelineModel(scaling.stages()).transform(df).collect())
    assert np.allclose(by_rows, by_stages) and len(by_rows) == 3


def test_scores_of_a_known_confusion(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, 0)] * 1
    table = evaluation.confusion(spark.createDataFrame(rows, "label int, prediction int"))
    got = evaluation.scores(table).first()
    assert got.accuracy == pytest.approx(7 / 11)
    assert got.weighted_precision == pytest.approx((6 * 5 / 8 + 4 * 2 / 3 + 0) / 11)
    assert got.macro_recall == pytest.approx((5 / 6 + 2 / 4 + 0) / 3)


def test_keyword_hits_equal_containment(spark):
    texts = ["RED MUGS", "MUG", "GARDEN SMUG", None, ""]
    words = ["mug", "mugs", "garden", "n s"]
    df = spark.createDataFrame([(t,) for t in texts], "Description string")
    hits = keywords.keyword_hits(df, spark.createDataFrame([(w,) for w in words], "keyword string"))
    want = {(t, w) for t in texts if t for w in words if w.upper() in t}
    assert {tuple(r) for r in hits.collect()} == want


def test_keyword_inventory_takes_the_shortest_word(spark):
    df = spark.createDataFrame([("Red MUGS, mug",), ("mugs+tea",), ("mugs red",), (None,)], "Description string")
    got = {r.root: (r.words, r.keyword, r.n) for r in keywords.keyword_inventory(df).collect()}
    assert got["mug"] == (["mug", "mugs"], "mug", 3) and got["mugs+tea"][2] == 1


@pytest.mark.parametrize("k", range(2, 11))
def test_hierarchical_gives_k_clusters_on_standardised_data(spark, k):
    rng = random.Random(k)
    x = np.array([[rng.gauss(0, 1) for _ in range(4)] for _ in range(200)])
    x = (x - x.mean(0)) / x.std(0)
    table = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x.tolist())], ["CustomerID", "features"])
    found = cluster.fit_hierarchical(table, k).transform(table)
    assert found.columns == ["CustomerID", "features", "cluster"]
    assert found.select("cluster").distinct().count() == k


def test_hierarchical_finds_blobs_and_refuses_too_few_rows(spark, blobs):
    found = cluster.fit_hierarchical(blobs, 3).transform(blobs)
    assert found.groupBy("label").agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        cluster.fit_hierarchical(blobs.limit(2), 5)


def test_a_silhouette_that_is_not_reached_is_an_error(spark, blobs):
    _, score = cluster.fit_until_separated(blobs, 3, restarts=2, least=0.5)
    assert score >= 0.5
    with pytest.raises(ValueError):
        cluster.fit_until_separated(blobs, 3, restarts=1, least=1.1, max_tries=2)
