"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each text is reduced to four transformed statistics: log of the mean word length, and the square roots of
symbols per word, of repeated words per word and of repeated lines per line, each damped by pseudo-counts so
that short texts do not swing. Per language and source a minimum-covariance-determinant estimate is made of
them: from each of several starts (the quartiles of each statistic, and the mean and covariance of all rows), steps keep the share ``SHARE`` of
rows nearest to the current centre by Mahalanobis distance and take their mean and covariance. A step counts only if it lowers the determinant; a
start rests as soon as one does not, so every start ends, and the estimate is the state of least determinant of all. A row is rejected if its distance exceeds the
chi-square quantile ``CUTOFF``. ``RESOLUTION`` is the standard deviation below which differences of a statistic mean
nothing; it keeps the covariance regular where a statistic is constant. It is so small that each statistic alone can pass the cutoff
where the others of its group have none of it: 0.29 of the lines (plus five) repeated, or 0.19 of the words (plus twenty).

Only built-in functions are used. Nearest rows are found by counts over bins of the logarithm of the distance, which hold the
sums of the moments too: one aggregation per step for all starts, with a few hundred rows per group whatever its size, no sort of rows. The rows
of the last bin (a sixteenth of a unit wide) count in part, all alike, so that the share is met exactly.

Defined cases: null text has no words and fails the base limits, as do texts of fewer than ten words; rows that fail take
no part in the estimates; null language or source is a value of its own; groups with fewer than ``LEAST`` rows are
estimated together per language, and if these are too few, with all such rows; if those are too few too, base limits
decide alone; an empty table gives no rows; repeated rows count each; texts of any length are counted whole, by one task each; of starts
with the same determinant the first one counts; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillroll.llm.common import column, fresh, stage, words

SHARE = 0.6
CUTOFF = 0.99999
LEAST = 60
#: A step counts if the log determinant falls by more than this.
FALL = 1e-6
#: Quantiles of the statistics to start from; one more start is the mean of all rows.
STARTS = (0.5, 0.25, 0.75)
PSEUDO = 20
RESOLUTION = (0.1, 0.05, 0.08, 0.1)
D = len(RESOLUTION)
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: Bins of a statistic and of the logarithm of a squared distance, per unit; further out there is one bin.
BINS, FARTHEST = 16, 2_000
BROADCAST_GROUPS = 50_000


def chi2_cdf(x: float, d: int) -> float:
    """For even d."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float, d: int) -> float:
    """By what the covariance of the nearest ``share`` of normal rows is to be multiplied."""
    return share / chi2_cdf(chi2_quantile(share, d), d + 2)


def statistics(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """``docs`` with a struct ``name`` of the base statistics, computed in one pass over each text."""
    work = fresh(docs, "q_words", "q_hash", "q_windows", "q_repeats", "q_lines", "q_some")
    w, h, win, rep, lines, some = work
    table = docs.withColumns({w: words(text), lines: F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    table = table.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    at = F.col(h)
    table = table.withColumn(win, F.when(F.size(w) >= 5, F.transform(
        F.slice(at, F.lit(1), F.greatest(F.size(w) - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(at, i + 1), F.get(at, i + 2), F.get(at, i + 3), F.get(at, i + 4))))
        .otherwise(F.array().cast("array<bigint>")))
    # only texts that repeat a window go through the search for its places
    table = table.withColumn(some, F.size(win) > F.size(F.array_distinct(win)))
    sorted_places = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    table = table.withColumn(rep, F.when(F.col(some), sorted_places))
    places = F.array_sort(F.transform(F.filter(F.col(rep), lambda x, i: (
        (i > 0) & (F.get(F.col(rep), i - 1)["h"] == x["h"]))
        | F.coalesce(F.get(F.col(rep), i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    table = table.withColumn(rep, places)
    covered = F.aggregate(F.transform(F.col(rep), lambda p, i: F.least(
        F.coalesce(F.get(F.col(rep), i + 1) - p, F.lit(5)), F.lit(5))), F.lit(0), lambda a, b: a + b)
    table = table.withColumn(name, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size(F.split(F.coalesce(text, F.lit("")), "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines")))
    return table.drop(*work)


def vector(base: Column) -> list[Column]:
    """The transformed statistics of a base struct."""
    n = base["n_words"] + PSEUDO
    return [
        F.log((base["word_chars"] + 5 * PSEUDO) / n),
        F.sqrt(base["n_symbols"] / n),
        F.sqrt(base["n_repeat_words"] / n),
        F.sqrt(base["n_dup_lines"] / (base["n_lines"] + 5)),
    ]


def failed(base: Column) -> Column:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def _clipped(value: Column) -> Column:
    return F.greatest(F.least(F.floor(value), F.lit(FARTHEST)), F.lit(-FARTHEST)).cast("int")


def distance(x: list[Column], named: dict[str, str] | None = None) -> Column:
    """Squared Mahalanobis distance by forward substitution in the triangular factor."""
    of = lambda key: F.col(named[key] if named else key)
    z: list[Column] = []
    for i in range(D):
        rest = x[i] - of(f"m{i}")
        for j in range(i):
            rest = rest - of(f"l{i}{j}") * z[j]
        z.append(rest / of(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factored(state: DataFrame) -> DataFrame:
    """Adds the lower triangular factor l and the log determinant of the covariance s."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the resolution on the diagonal keeps every pivot positive; the floor is for rounding
            state = state.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return state.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")))


def _starts(rows: DataFrame) -> DataFrame:
    """Starts of each cell: centres at quantiles with the resolution as covariance, and the moments of all rows."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _clipped(F.col(X[i]) / RESOLUTION[i] * BINS).alias("b")) for i in range(D)]))
    counts = rows.select("cell", values.alias("v")).groupBy("cell", "v").count()
    part = Window.partitionBy("cell", "v.i")
    reached = counts.withColumns({"upto": F.sum("count").over(part.orderBy("v.b")), "all": F.sum("count").over(part)})
    places = reached.groupBy("cell", F.col("v.i").alias("i")).agg(F.max("all").alias("n"), F.array(*[
        F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v.b"))) for q in STARTS]).alias("at"))
    places = places.select("cell", "i", "n", F.posexplode("at").alias("start", "b"))
    centres = places.groupBy("cell", "start").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("i") == i, (F.col("b") + 0.5) / BINS * RESOLUTION[i])).alias(f"m{i}") for i in range(D)]).withColumns({
            f"s{i}{j}": F.lit(RESOLUTION[i] ** 2 if i == j else 0.0) for i, j in PAIRS})
    whole = rows.groupBy("cell").agg(F.lit(len(STARTS)).alias("start"), F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *[
        (F.covar_pop(X[i], X[j]) + (RESOLUTION[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in PAIRS])
    # a start has no subset yet, so any step lowers its determinant
    return _factored(centres.unionByName(whole)).withColumns({"logdet": F.lit(float("inf")), "moving": F.lit(True)})


def _closer(rows: DataFrame, state: DataFrame, factor: float, share: float, near: Callable) -> DataFrame:
    """One step of all starts that still move: moments of the nearest rows of each cell."""
    moving = state.where("moving")
    small = moving.select("cell", "start", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])
    joined = rows.join(near(small), "cell")
    away = _clipped(F.log(distance([F.col(x) for x in X]) + 1e-12) * BINS)
    # moments about the centre of the last step, which keeps their sums small
    gap = {f"g{i}": F.col(X[i]) - F.col(f"m{i}") for i in range(D)}
    sums = joined.withColumns(gap | {"bin": away}).groupBy("cell", "start", "bin").agg(
        F.count(F.lit(1)).alias("k"), *[F.sum(f"g{i}").alias(f"a{i}") for i in range(D)],
        *[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"b{i}{j}") for i, j in PAIRS])
    cell = Window.partitionBy("cell", "start")
    inner = sums.withColumns({"before": F.sum("k").over(cell.orderBy("bin")) - F.col("k"), "all": F.sum("k").over(cell)})
    # whole bins while they fit, and the part of the next one that is left of the share
    inner = inner.withColumn("w", F.least(F.lit(1.0), (F.ceil(share * F.col("all")) - F.col("before")) / F.col("k"))).where("w > 0")
    total = F.sum(F.col("w") * F.col("k"))
    moments = inner.groupBy("cell", "start").agg(
        *[(F.sum(F.col("w") * F.col(f"a{i}")) / total).alias(f"a{i}") for i in range(D)],
        *[(F.sum(F.col("w") * F.col(f"b{i}{j}")) / total).alias(f"b{i}{j}") for i, j in PAIRS])
    old = moving.select("cell", "start", "n", *[F.col(f"m{i}").alias(f"o{i}") for i in range(D)])
    new = moments.join(old, ["cell", "start"]).select("cell", "start", "n", *[(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(D)], *[
        (factor * (F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) + (RESOLUTION[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}")
        for i, j in PAIRS])
    return _factored(new)


def estimates(rows: DataFrame, share: float = SHARE, near: Callable = lambda df: df) -> DataFrame:
    """Robust centre (m), covariance (s), its triangular factor (l) and log determinant of each cell, from rows (cell, x0 ...).

    ``near`` marks the table of cells for broadcast, where their number is known to be small. Ends when no step lowers a determinant, which
    is bounded from below by the resolution.
    """
    factor = consistency(share, D)
    values = ["n", *[f"m{i}" for i in range(D)], *[f"s{i}{j}" for i, j in PAIRS], *[f"l{i}{j}" for i, j in PAIRS], "logdet"]
    state = stage(_starts(rows).select("cell", "start", "moving", *values), "quality-start")
    while not state.where("moving").isEmpty():
        new = _closer(rows, state, factor, share, near).select("cell", "start", F.struct(*values).alias("new"))
        lower = F.coalesce(F.col("new.logdet") < F.col("logdet") - FALL, F.lit(False))
        met = state.join(new, ["cell", "start"], "left")
        state = stage(met.select("cell", "start", (F.col("moving") & lower).alias("moving"), *[
            F.when(lower, F.col(f"new.{v}")).otherwise(F.col(v)).alias(v) for v in values]), "quality-step")
    best = state.groupBy("cell").agg(F.min_by(F.struct(*values), F.struct("logdet", "start")).alias("best"))
    return stage(best.select("cell", "best.*"), "quality-estimates")


def assess(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None,
           share: float = SHARE, cutoff: float = CUTOFF, least: int = LEAST) -> tuple[DataFrame, str]:
    """The columns ``carry`` of all rows (default: all) and, under the name returned, a struct of the base statistics with
    base_failed, distance (null if there is no estimate) and kept."""
    carry = docs.columns if carry is None else carry
    (name,) = fresh(docs, "quality")
    base = statistics(docs, column(docs, text), name)
    by, where = fresh(base, "q_lang", "q_source")
    held = stage(base.select(*[column(base, c) for c in carry], name, column(base, lang).alias(by), column(base, source).alias(where)), "quality-base")
    clean = held.where(~failed(F.col(name))).select(F.col(by).alias("lang"), F.col(where).alias("source"), *[
        v.alias(x) for v, x in zip(vector(F.col(name)), X)])
    groups = clean.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= least
    language = F.sum(F.when(~own, F.col("n"))).over(Window.partitionBy("lang"))
    rest = F.sum(F.when(~own & (F.coalesce(F.col("in_lang"), F.lit(0)) < least), F.col("n"))).over(Window.partitionBy())
    groups = groups.withColumn("in_lang", language).withColumn("rest", rest)
    groups = stage(groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.when(own, F.struct(
        F.lit(2).alias("level"), F.col("lang").alias("a"), F.col("source").alias("b")))
        .when(F.col("in_lang") >= least, F.struct(F.lit(1).alias("level"), F.col("lang").alias("a"), F.lit(None).cast("string").alias("b")))
        .when(F.col("rest") >= least, F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
        .alias("cell")).where(F.col("cell").isNotNull()).withColumn("cell", F.to_json("cell")), "quality-groups")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    few = groups.count() <= BROADCAST_GROUPS
    near = F.broadcast if few else (lambda df: df)
    rows = stage(clean.join(near(groups), same).select("cell", *X), "quality-vectors")
    state = groups.join(estimates(rows, share, near=near), "cell")
    params = state.select("g_lang", "g_source", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])
    names = fresh(held, *[f"q_{c}" for c in params.columns])
    params = stage(params.toDF(*names), "quality-params")
    far = distance(vector(F.col(name)), dict(zip([f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in PAIRS], names[2:])))
    joined = held.join(near(params), F.col(by).eqNullSafe(F.col(names[0])) & F.col(where).eqNullSafe(F.col(names[1])), "left")
    limit = chi2_quantile(cutoff, D)
    bad = failed(F.col(name))
    verdict = F.struct(F.col(f"{name}.*"), bad.alias("base_failed"), far.alias("distance"),
                       (~bad & ~F.coalesce(far > limit, F.lit(False))).alias("kept"))
    return joined.select(*[column(held, c) for c in carry], verdict.alias(name)), name


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    judged, name = assess(docs, **options)
    return judged.where(F.col(f"{name}.kept")).select(*[column(judged, c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged, name = assess(docs, carry=["doc_id"])
    return judged.select("doc_id", *[f"{name}.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col(f"{name}.distance").alias("distance"))
