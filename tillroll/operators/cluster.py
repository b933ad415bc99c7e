"""k-means and hierarchical clusters, their quality, profiles and names."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.operators.kmeans import Centers, best, fit_runs
from tillroll.operators.silhouette import whole_means

SEGMENT_NAMES = ["bronze", "silver", "gold"]  # fixed values, by rising spend


FITS_AT_ONCE = 4


def side_by_side(fit: Callable, items: Iterable) -> list:
    """Results of independent fits, a few of them in the cluster at a time."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(fit), items))


def _summary(table: DataFrame, column: str = "features"):
    row = table.agg(F.count(column).alias("n"), Summarizer.mean(F.col(column)).alias("mean"),
                    Summarizer.variance(F.col(column)).alias("variance")).first()
    return row.n, row["mean"], row["variance"]


def single_cluster_cost(table: DataFrame, column: str = "features") -> float:
    """Sum of squared distances to the mean: the k = 1 end of the elbow curve."""
    n, _, variance = _summary(table, column)
    return float(sum(variance.toArray())) * (n - 1)


def fit_kmeans(table: DataFrame, k: int, restarts: int = 1, seed: int = 1,
               column: str = "features") -> Centers:
    """Cheapest of ``restarts`` fits with consecutive seeds; one job per step for all of them."""
    return best(fit_runs(table, [k], restarts, seed, column), column)


def mean_silhouette(clustered: DataFrame, column: str = "features", cluster: str = "cluster") -> float:
    """Squared-Euclidean silhouette; one linear pass, no pairs. See :mod:`tillroll.operators.silhouette` for the Euclidean one."""
    return ClusteringEvaluator(featuresCol=column, predictionCol=cluster).evaluate(clustered)


def fit_until_separated(table: DataFrame, k: int, restarts: int = 30, least: float | None = None,
                        max_tries: int = 5, seed: int = 1, column: str = "features",
                        ) -> tuple[Centers, float]:
    """Model and mean Euclidean silhouette, over all rows, of one fit, or of the first of at most ``max_tries`` that reaches ``least``.

    Raises if none does.
    """
    best, score = None, -2.0
    for attempt in range(max_tries if least is not None else 1):
        model = fit_kmeans(table, k, restarts, seed + attempt * restarts, column)
        value = whole_means(model.transform(table), ["cluster"], column)[0]
        if value > score:
            best, score = model, value
        if least is None or score >= least:
            return best, score
    raise ValueError(f"silhouette {score:.4f} after {max_tries} tries, {least} was asked for")


def kmeans_sweep(table: DataFrame, ks=range(2, 10), restarts: int = 10, seed: int = 1,
                 column: str = "features") -> DataFrame:
    """(k, wcss, silhouette), k = 1 with its cost only; silhouettes are mean Euclidean ones over all rows.

    All restarts of all k take their steps together, so the jobs are those of the longest fit. The distances between rows, which are
    quadratic in their number, are computed once for all k.
    """
    ks = list(ks)
    runs = fit_runs(table, ks, restarts, seed, column)
    models = [best([r for r in runs if r.k == k], column) for k in ks]
    placed = table.select(column)
    for k, model in zip(ks, models):
        placed = model.setOutput(f"cluster_{k}").transform(placed)
    means = whole_means(placed, [f"cluster_{k}" for k in ks], column) if ks else []
    rows = [(1, single_cluster_cost(table, column), None)] + [(k, m.trainingCost, mean) for k, m, mean in zip(ks, models, means)]
    return table.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")


def hierarchical_sweep(table: DataFrame, ks=range(2, 11), seed: int = 1,
                       column: str = "features") -> DataFrame:
    """(k, wcss, silhouette) for top-down hierarchical clustering; silhouettes are squared-Euclidean ones."""
    table = table.persist()
    table.count()

    def measure(k: int) -> tuple:
        model = fit_hierarchical(table, k, seed, column)
        return k, float(model.stages[2].summary.trainingCost), float(mean_silhouette(model.transform(table), column))

    rows = side_by_side(measure, ks)
    table.unpersist()
    return table.sparkSession.createDataFrame(rows, "k int, wcss double, silhouette double")


def fit_hierarchical(table: DataFrame, k: int = 3, seed: int = 1, column: str = "features") -> PipelineModel:
    """Top-down hierarchical clusters, exactly ``k`` of them, as a pipeline that can be stored.

    A split moves two centres apart in proportion to the norm of the mean, which is 0 for standardised data. So the
    vectors get one more entry, a constant: distances stay as they are and the mean is away from the origin.
    """
    fitted = Pipeline(stages=[
        SQLTransformer(statement="SELECT *, CAST(1 AS DOUBLE) AS beside_origin FROM __THIS__"),
        VectorAssembler(inputCols=[column, "beside_origin"], outputCol="off_origin"),
        BisectingKMeans(k=k, seed=seed, featuresCol="off_origin", predictionCol="cluster"),
        SQLTransformer(statement=f"SELECT {', '.join(f'`{c}`' for c in table.columns)}, cluster FROM __THIS__"),
    ]).fit(table)
    found = len(fitted.stages[2].clusterCenters())
    if found != k:
        raise ValueError(f"{found} clusters instead of {k}: too few distinct rows")
    return fitted


def squared_distance(point: Column, center: list[float]) -> Column:
    target = F.array(*[F.lit(float(v)) for v in center])
    return F.aggregate(F.zip_with(point, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                       lambda s, v: s + v)


def nearest_center(point: Column, centers: list[list[float]]) -> Column:
    """Index of the nearest of fixed centers, the first one on ties."""
    distances = F.array(*[squared_distance(point, c) for c in centers])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def silhouettes(clustered: DataFrame, column: str = "features", cluster: str = "cluster") -> DataFrame:
    """Squared-Euclidean silhouette of every row, in linear time.

    The mean squared distance of x to a cluster follows from its size, vector sum and sum
    of squared norms, so only one row per cluster leaves the executors.
    """
    point = vector_to_array(column) if clustered.schema[column].dataType.typeName() != "array" \
        else F.col(column).cast("array<double>")
    table = clustered.withColumn("_x", point).withColumn(
        "_norm", F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))
    # one vector sum per cluster, whatever the number of dimensions
    stats = (table.groupBy(cluster).agg(F.count("*").alias("n"), F.sum("_norm").alias("q"), Summarizer.sum(array_to_vector("_x")).alias("s"))
             .withColumn("s", vector_to_array("s")).collect())

    def mean_distance(r) -> Column:
        mean = F.lit([v / r.n for v in r.s])
        dot = F.aggregate(F.zip_with("_x", mean, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.col("_norm") - 2 * dot + F.lit(r.q / r.n)

    own = other = F.lit(None).cast("double")
    single = F.lit(False)
    for r in stats:
        here = F.col(cluster) == F.lit(r[cluster])
        distance = mean_distance(r)
        own = F.when(here, distance * (r.n / (r.n - 1)) if r.n > 1 else F.lit(0.0)).otherwise(own)
        other = F.least(other, F.when(~here, distance))
        if r.n == 1:
            single = single | here
    value = F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b"))
    return (table.withColumn("_a", own).withColumn("_b", other)
            .withColumn("silhouette", F.when(single, 0.0).otherwise(F.coalesce(value, F.lit(0.0))))
            .drop("_x", "_norm", "_a", "_b"))


def cluster_profile(clustered: DataFrame, columns: list[str], by: str = "sum") -> DataFrame:
    """Mean of every column and size per cluster, by rising ``by``."""
    profile = clustered.groupBy("cluster").agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in columns], F.count("*").alias("size"))
    return profile.orderBy(by, "cluster")


def profile_report(profile: DataFrame) -> DataFrame:
    """Profile rounded to one digit, best scores first."""
    means = [c for c in profile.columns if c not in ("cluster", "size")]
    return (profile.withColumns({c: F.bround(c, 1) for c in means})
            .orderBy(F.desc("RFML_Score"), F.desc("Proximidade_Marca_Score")))


def cluster_means(clustered: DataFrame, wanted: int, columns: list[str]) -> DataFrame:
    return clustered.where(F.col("cluster") == wanted).agg(*[F.avg(c).alias(c) for c in columns])


def names_by_spend(profile: DataFrame, names: list[str] = SEGMENT_NAMES, by: str = "sum") -> dict[int, str]:
    """Cluster -> name by rising mean spend; ids of a fit carry no meaning of their own."""
    order = [r.cluster for r in profile.orderBy(by, "cluster").select("cluster").collect()]
    return dict(zip(order, names))


def with_segment(clustered: DataFrame, names: dict[int, str]) -> DataFrame:
    """``segment`` from a cluster -> name map; null for other clusters."""
    pairs = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return clustered.withColumn("segment", pairs[F.col("cluster")])
