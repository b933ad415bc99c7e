"""Euclidean silhouettes, joint k-means fits and Ward merges against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from tillroll.functions.vectors import sampled
from tillroll.operators import cluster, kmeans, silhouette, ward


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("features", VectorUDT())])


def frame(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(i, int(c), Vectors.dense(r)) for i, (r, c) in enumerate(zip(x.tolist(), labels))], SCHEMA)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    parts = [rng.normal(c, 1.0, (n, 4)) for c, n in ((0, 150), (5, 90), (-4, 60))]
    return np.concatenate(parts), np.repeat([0, 1, 2], [150, 90, 60])


def plain_silhouettes(x, labels):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            found.append(0.0)
            continue
        a = apart[i, own].sum() / (own.sum() - 1)
        b = min(apart[i, labels == o].mean() for o in set(labels.tolist()) - {c})
        found.append((b - a) / max(a, b))
    return np.array(found)


def test_silhouettes_equal_pairwise_means(spark, points):
    x, labels = points
    labels = np.append(labels, 7)
    x = np.vstack((x, [[30.0] * 4]))  # a lone row
    table = frame(spark, x, labels).repartition(3)
    got = {r.id: r.silhouette for r in silhouette.euclidean_silhouettes(table, "id").collect()}
    want = plain_silhouettes(x, labels)
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], want, atol=1e-7)
    whole = silhouette.mean_euclidean_silhouette(table)
    assert whole.mean == pytest.approx(want.mean()) and whole.error == 0 and whole.sampled == whole.rows == len(x)


def test_error_of_a_sample_covers_the_mean(spark):
    rng = np.random.default_rng(9)
    labels = np.repeat([0, 1, 2], [1200, 900, 300])
    x = rng.normal(0, 1.5, (2400, 3)) + np.array([[0, 0, 0], [2, 2, 0], [0, -3, 3]])[labels]
    table = frame(spark, x, labels).persist()
    want = plain_silhouettes(x, labels).mean()
    found = [silhouette.mean_euclidean_silhouette(table, most_rows=400, seed=s) for s in range(8)]
    assert all(300 < f.sampled < 520 and f.rows == 2400 and 0 < f.error < 0.03 for f in found)
    assert sum(abs(f.mean - want) <= 2 * f.error for f in found) >= 6 and all(abs(f.mean - want) <= 4 * f.error for f in found)


def test_empty_and_single_clusters(spark, points):
    x, _ = points
    assert silhouette.mean_euclidean_silhouette(frame(spark, x[:0])).rows == 0
    assert silhouette.mean_euclidean_silhouette(frame(spark, x[:5])).mean == 0


def plain_lloyd(x, centers, variance):
    while True:
        near = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        now = np.array([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(len(centers))])
        moved = ((now - centers) ** 2).sum()
        centers = now
        if moved <= kmeans.TOLERANCE * variance:
            return ((x[:, None] - centers[None]) ** 2).sum(-1).min(1).sum()


def test_joint_fits_equal_separate_ones(spark, points):
    x, _ = points
    table = frame(spark, x).repartition(3).persist()
    ks, restarts = [2, 3, 5], 6
    starts, variance = kmeans.start_runs(table, ks, restarts, 1, "features")
    want = [plain_lloyd(x, r.centers.copy(), variance) for r in starts]
    runs = kmeans.fit_runs(table, ks, restarts)
    assert np.allclose([r.cost for r in runs], want)
    sweep = {r.k: r.wcss for r in cluster.kmeans_sweep(table, ks, restarts).collect()}
    for k in ks:
        assert sweep[k] == pytest.approx(min(w for w, r in zip(want, starts) if r.k == k))


def test_jobs_do_not_grow_with_restarts(spark, points):
    x, _ = points
    table = frame(spark, x).persist()
    counts = []
    for restarts in (1, 25):
        spark.sparkContext.setJobGroup(f"restarts-{restarts}", "")
        runs = kmeans.fit_runs(table, range(2, 6), restarts)
        spark.sparkContext._jsc.clearJobGroup()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"restarts-{restarts}"))
        counts.append((jobs, max(r.steps for r in runs)))
    (few, steps), (many, more_steps) = counts
    assert many - few <= 3 * (more_steps - steps) + 3  # 25 times the runs: more jobs only for the steps of the longest one


def test_centres_place_rows_and_survive_storage(spark, points, tmp_path):
    x, _ = points
    table = frame(spark, x).drop("cluster")
    model = cluster.fit_kmeans(table, 3, restarts=4)
    got = np.array([r.cluster for r in model.transform(table).orderBy("id").collect()])
    centers = np.array(model.clusterCenters())
    assert (got == ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)).all()
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.array_equal(np.array(again.stages[0].clusterCenters()), centers) and again.stages[0].trainingCost == model.trainingCost
    assert [r.cluster for r in again.transform(table).orderBy("id").collect()] == got.tolist()
    assert Pipeline(stages=[model]).fit(table).transform(table).count() == len(x)


def test_more_centres_than_distinct_rows(spark):
    x = np.array([[1.0, 1.0]] * 5 + [[4.0, 2.0]] * 3)
    runs = kmeans.fit_runs(frame(spark, x), [3], 2)
    assert all(r.cost == pytest.approx(0) for r in runs)
    with pytest.raises(ValueError):
        kmeans.fit_runs(frame(spark, x[:0]), [2], 1)


def plain_ward(x):
    """Merge the pair of least cost until one is left."""
    sets = {i: [i] for i in range(len(x))}
    heights, parts = [], [{frozenset(s) for s in sets.values()}]
    while len(sets) > 1:
        keys = sorted(sets)
        best = min(((len(sets[a]) * len(sets[b]) / (len(sets[a]) + len(sets[b])) * ((x[sets[a]].mean(0) - x[sets[b]].mean(0)) ** 2).sum(), a, b)
                    for i, a in enumerate(keys) for b in keys[i + 1:]))
        heights.append(np.sqrt(2 * best[0]))
        sets[best[1]] += sets.pop(best[2])
        parts.append({frozenset(s) for s in sets.values()})
    return heights, parts


def test_ward_equals_plain_merges(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 3))
    x = x[np.lexsort(x.T[::-1])]
    table = frame(spark, x).repartition(3)
    fitted = ward.fit_ward(table)
    heights, parts = plain_ward(x)
    assert fitted.within == pytest.approx(0, abs=1e-9) and np.allclose([m[2] for m in fitted.merges], heights)
    assert [r.height for r in fitted.linkage(spark).orderBy("step").collect()] == pytest.approx(heights)
    for k in range(2, 11):
        rows = fitted.transform(table.drop("cluster"), k).collect()
        found = {frozenset(r.id for r in rows if r.cluster == c) for c in range(k)}
        assert found == parts[60 - k]
    total = ((x - x.mean(0)) ** 2).sum()
    assert sum(m[2] ** 2 / 2 for m in fitted.merges) == pytest.approx(total)


def test_ward_on_repeated_rows_counts_them(spark):
    x = np.array([[0.0]] * 10 + [[1.0]] * 2 + [[9.0]] * 4)
    fitted = ward.fit_ward(frame(spark, x))
    assert len(fitted.merges) == 2 and fitted.merges[-1][3] == 16
    assert sum(m[2] ** 2 / 2 for m in fitted.merges) == pytest.approx(((x - x.mean()) ** 2).sum())
    assert fitted.labels(3).tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        fitted.labels(4)
    with pytest.raises(ValueError):
        ward.fit_ward(frame(spark, x[:0]))


def test_summaries_of_a_larger_table_lose_little(spark, points):
    """Rows in other clusters than with every row a summary of its own: under 3 % for three groups; spread is accounted for."""
    x, _ = points
    table = frame(spark, x).drop("cluster").persist()
    exact, few = ward.fit_ward(table), ward.fit_ward(table, most_leaves=60)
    assert len(few.sizes) <= 60 and few.sizes.sum() == len(x)
    total = ((x - x.mean(0)) ** 2).sum()
    assert sum(m[2] ** 2 / 2 for m in few.merges) + few.within == pytest.approx(total)
    a = np.array([r.cluster for r in exact.transform(table, 3).orderBy("id").collect()])
    b = np.array([r.cluster for r in few.transform(table, 3).orderBy("id").collect()])
    same = sum(max(((a == c) & (b == d)).sum() for d in range(3)) for c in range(3))
    assert same >= 0.97 * len(x)
    sweep = ward.ward_sweep(table, range(2, 5)).orderBy("k").collect()
    assert [r.k for r in sweep] == [2, 3, 4] and max(sweep, key=lambda r: r.silhouette).k == 3
    assert sweep[0].height > sweep[1].height > sweep[2].height


def test_samples_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    x = np.array([[rng.random(), rng.random()] for _ in range(500)])
    one = sampled(frame(spark, x), "features", 500, 100, 3)
    assert np.array_equal(one, sampled(frame(spark, x).repartition(7), "features", 500, 100, 3)) and 60 < len(one) < 140
    assert len(sampled(frame(spark, x), "features", 500, 500, 3)) == 500


def test_ward_sweep_places_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    table = frame(spark, np.concatenate([rng.normal(c, 1, (60, 3)) for c in (0, 6, 12)]))
    fitted, calls = ward.fit_ward(table), []
    kept = ward.Ward.placed
    monkeypatch.setattr(ward.Ward, "placed", lambda self, *a, **k: calls.append(1) or kept(self, *a, **k))
    sweep = {r.k: r for r in ward.ward_sweep(table, range(2, 6)).collect()}
    assert len(calls) == 1
    for k, r in sweep.items():
        want = silhouette.mean_euclidean_silhouette(fitted.transform(table, k)).mean
        assert r.silhouette == pytest.approx(want, abs=1e-12)


def test_sweeps_take_the_silhouettes_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (10_600, 2)) + rng.integers(0, 2, (10_600, 1)) * 3.0
    table = frame(spark, x).drop("cluster").repartition(5).persist()
    found = {r.k: r.silhouette for r in cluster.kmeans_sweep(table, [2, 3], 2).collect()}
    for k in (2, 3):
        model = cluster.fit_kmeans(table, k, 2)
        labels = ((x[:, None] - np.array(model.clusterCenters())[None]) ** 2).sum(-1).argmin(1)
        sizes, total = np.bincount(labels, minlength=k), 0.0
        for start in range(0, len(x), 500):
            apart, rows = np.sqrt(((x[start:start + 500, None] - x[None]) ** 2).sum(-1)), np.arange(len(x[start:start + 500]))
            sums, own = np.stack([apart[:, labels == c].sum(1) for c in range(k)], 1), labels[start:start + 500]
            a, others = sums[rows, own] / (sizes[own] - 1), sums / sizes
            others[rows, own] = np.inf
            total += ((others.min(1) - a) / np.maximum(a, others.min(1))).sum()
        assert found[k] == pytest.approx(total / len(x), abs=1e-9)
        assert cluster.fit_until_separated(table, k, 2)[1] == pytest.approx(found[k], abs=1e-12)


def test_whole_silhouettes_equal_sampled_ones_of_a_small_table(spark, points, monkeypatch):
    x, labels = points
    labels, x = np.append(labels, 7), np.vstack((x, [[30.0] * 4]))  # a lone row
    table = frame(spark, x, labels).repartition(3).withColumn("one", F.lit(0))
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 40)
    monkeypatch.setattr(silhouette, "READ", 3000)
    assert silhouette.whole_means(table, ["cluster", "one"]) == pytest.approx([plain_silhouettes(x, labels).mean(), 0.0], abs=1e-7)
    assert silhouette.whole_means(table.limit(0), ["cluster"]) == [0.0]


def test_starts_are_drawn_from_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (100, 3)) for c in (0, 8, 20)] + [np.ones((40, 3))])
    table = frame(spark, x).withColumn("id", F.when(F.col("id") < 300, F.col("id"))).repartition(3)  # the last rows are equal
    whole, _ = kmeans.start_runs(table, [2, 6], 8, 1, "features")
    monkeypatch.setattr(kmeans, "BLOCK", 120)
    found, _ = kmeans.start_runs(table, [2, 6], 8, 1, "features")
    assert kmeans._blocks(table, "features", len(x), 1)[1] == 9
    for a, b in zip(whole, found):
        assert (a.k, a.seed) == (b.k, b.seed) and np.array_equal(a.centers, b.centers) and len(a.centers) == a.k
    few = frame(spark, np.ones((50, 3))).repartition(3)
    assert all((r.centers == 1).all() and len(r.centers) == 4 for r in kmeans.start_runs(few, [4], 2, 1, "features")[0])


def test_ward_of_many_rows_is_exact(spark, monkeypatch):
    """Rounds over blocks give the merges and clusters of the plain ones; no representative stands for other rows."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 1, (50, 3)) for c in (0, 4, 9)] + [[[60.0, 0, 0], [75.0, 0, 0]]])
    x = x[np.lexsort(x.T[::-1])]
    twice = frame(spark, np.concatenate((x, x[:30]))).drop("cluster").repartition(3).persist()
    exact = ward.fit_ward(twice)
    assert isinstance(exact, ward.Ward)
    monkeypatch.setattr(ward, "MOST_LEAVES", 20)
    monkeypatch.setattr(ward, "LAST_SETS", 50)
    monkeypatch.setattr(ward, "BLOCK_ROWS", 40)
    found = ward.fit_ward(twice)
    assert len(found.rounds) > 1 and found.n == len(x)
    got, want = (f.linkage(spark).orderBy("step").collect() for f in (found, exact))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r.rows for r in got] == [r.rows for r in want]
    assert np.allclose([r.height for r in got], [r.height for r in want])
    for k in (1, 3, 60):
        a, b = (sorted((r.id, r.cluster) for r in f.transform(twice, k).collect()) for f in (found, exact))
        assert a == b and found.height(k) == pytest.approx(exact.height(k))
    assert found.spread() == pytest.approx(exact.spread())
    with pytest.raises(ValueError):
        found.labels(len(x) + 1)
