"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a number of 60 bits from a digest of its id and text. Per source the sizes are summed by
the leading bits of that number; running sums over the buckets show in which one the budget ends, and only
rows of that boundary bucket are summed again by their next bits, until a single number is left. Rows
below the threshold found are taken once more than the others: one filter, no sort of rows. A larger
budget has a larger threshold, so mixes of growing budgets are nested.

Only built-in functions are used. The rows of a source are never brought together: what leaves a task are
sums by source and bucket.

Defined cases: null or empty texts have size 0 and take nothing; rows without a source form a source of
their own, placed last; an empty table gives an empty mix; rows equal in id and text have the same number
and are taken together; clashing extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillroll.llm.common import column, fresh, stage, words

WEIGHTS = (5, 2, 1)
BITS = 60
STEP = 12
#: Thresholds of so many sources at most are sent to all executors, some 100 bytes each.
BROADCAST_SOURCES = 20_000


def number(identity: Column, text: Column) -> Column:
    """Sixty bits that depend on nothing but id and text."""
    seed = F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, halves: int = 3, most: int = 2) -> DataFrame:
    """Target of each source from rows (source, source_size).

    Sources in the order of their code points, null last, weigh ``weights`` over and over and share
    ``halves``/2 of all sizes. No target exceeds ``most`` times its source's size; what is over goes to the
    others by weight. In the order of size per weight, the first sources are the full ones, so running
    sums over the sources give the level at which the others stand. Needs halves <= 2 * most.
    """
    everywhere = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(everywhere) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), place + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    run = weighed.withColumns({
        "place": F.row_number().over(order),
        "before": F.sum("source_size").over(order) - F.col("source_size"),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    share = halves * F.col("total") - 2 * most * F.col("before")  # twice what is left for this source and those after
    run = run.withColumns({"share": share, "fits": F.col("weight") * share <= 2 * most * F.col("source_size") * F.col("rest")})
    level = F.min(F.when(F.col("fits"), F.struct("place", "share", "rest"))).over(Window.partitionBy())
    run = run.withColumn("level", level)
    capped = (most * F.col("source_size")).cast("double")
    shared = (F.col("weight") * F.col("level.share")).cast("double") / (2 * F.col("level.rest")).cast("double")
    target = F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), capped).otherwise(shared)
    return run.select("source", "source_size", "weight", target.alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Copies that all rows of a source get and the number below which rows get one more.

    ``rows`` has source, size and number; ``plan`` has source, source_size and target. The row at the
    threshold is taken if that brings the source nearer to its target.
    """
    whole = F.when(F.col("source_size") <= 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")).cast("int"))
    state = stage(plan.withColumn("copies", whole).select(
        "source", "source_size", "target", "copies", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"),
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"),
        F.lit(None).cast("long").alias("threshold")), "mix-plan")
    shift = BITS
    while True:
        wide, shift = shift, max(0, shift - STEP)
        pending = state.where(F.col("threshold").isNull()).select(F.col("source").alias("of"), "prefix", "below", "budget")
        open_rows = rows.join(pending, F.col("source").eqNullSafe(F.col("of"))
                              & (F.shiftright(F.col("number"), wide) == F.col("prefix")))
        sums = open_rows.groupBy("of", "below", "budget", F.shiftright(F.col("number"), shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("number").alias("low"), F.max("number").alias("high"))
        run = Window.partitionBy("of").orderBy("bucket")
        reach = sums.withColumn("upto", F.col("below") + F.sum("size").over(run))
        ends = reach.where(F.col("upto") > F.col("budget")).groupBy("of").agg(
            F.min(F.struct("bucket", "upto", "size", "low", "high")).alias("end"))
        before = F.col("end.upto") - F.col("end.size")
        nearer = F.col("end.upto") - F.col("budget") < F.col("budget") - before
        one = F.when(F.col("end.low") == F.col("end.high"), F.col("end.low") + F.when(nearer, 1).otherwise(0))
        found = state.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
        state = stage(found.select(
            "source", "source_size", "target", "copies", F.coalesce("end.bucket", "prefix").alias("prefix"),
            F.coalesce(before, "below").alias("below"), "budget",
            # no bucket passes the budget: all rows of the source stand below the threshold
            F.coalesce("threshold", F.when(F.col("end").isNull(), F.lit(1 << BITS)).otherwise(one)).alias("threshold")), "mix-level")
        if shift == 0 or state.where(F.col("threshold").isNull()).isEmpty():
            return state.select("source", "source_size", "target", "copies", "threshold")


def decide(docs: DataFrame, identity: str = "doc_id", text: str = "text", source: str = "source",
           weights: Sequence[int] = WEIGHTS, halves: int = 3, most: int = 2, keep: bool = False) -> DataFrame:
    """Size, source's size, target and copies taken of each row.

    ``keep`` returns all columns of the input with ``copies`` under an unused name, which comes last;
    otherwise (id, size, source_size, target, copies).
    """
    of, size, num, copies = fresh(docs, "mix_source", "mix_size", "mix_number", "mix_copies")
    texts = column(docs, text)
    table = docs.withColumns({of: column(docs, source), size: F.size(words(texts)).cast("long"),
                              num: number(column(docs, identity), texts)})
    small = table.select(F.col(f"`{identity}`").alias("id"), F.col(of).alias("source"),
                         F.col(size).alias("size"), F.col(num).alias("number"))
    rows = stage(small, "mix-sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, halves, most)
    cut = thresholds(rows.where(F.col("size") > 0), plan).withColumnsRenamed(
        {"source": "cut_source", "copies": "cut_copies", "threshold": "cut_number"})
    if cut.count() <= BROADCAST_SOURCES:
        cut = F.broadcast(cut)
    if keep:
        more = F.col("cut_copies") + F.when(F.col(num) < F.col("cut_number"), 1).otherwise(0)
        joined = table.join(cut.select("cut_source", "cut_copies", "cut_number"), F.col(of).eqNullSafe(F.col("cut_source")))
        return joined.select(*[column(docs, c) for c in docs.columns], more.alias(copies))
    more = F.col("cut_copies") + F.when(F.col("number") < F.col("cut_number"), 1).otherwise(0)
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("cut_source")))
    return joined.select(F.col("id").alias(identity), "size", "source_size", "target", more.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each row as often as it is taken, with the columns of ``docs``."""
    taken = decide(docs, keep=True, **options)
    copies = taken.columns[-1]
    many = taken.withColumn(copies, F.explode(F.expr(f"if({copies} > 0, sequence(1, {copies}), array())")))
    return many.drop(copies)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decide(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sources),
run AS (
  SELECT *, row_number() OVER o AS place, CAST(sum(s) OVER o AS BIGINT) - s AS before,
         CAST(sum(w) OVER (ORDER BY s / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest,
         CAST(sum(s) OVER () AS BIGINT) AS total
  FROM weighed WINDOW o AS (ORDER BY s / w, source IS NULL, encode(source))),
level AS (
  SELECT place, 3 * total - 4 * before AS share, rest FROM run
  WHERE w * (3 * total - 4 * before) <= 4 * s * rest ORDER BY place LIMIT 1),
plan AS (
  SELECT source, s, CASE WHEN l.place IS NULL OR r.place < l.place THEN CAST(2 * s AS DOUBLE)
                         ELSE CAST(w * l.share AS DOUBLE) / CAST(2 * l.rest AS DOUBLE) END AS target
  FROM run r LEFT JOIN level l ON true),
budget AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target / s) AS BIGINT) END AS copies FROM plan),
cum AS (
  SELECT d.*, b.s, b.target, b.copies, b.target - b.copies * b.s AS b,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS upto,
         CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS unit
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, s AS source_size, target,
       size * (copies + CASE WHEN upto <= b OR (upto - unit <= b AND upto - b < b - (upto - unit)) THEN 1 ELSE 0 END) AS taken
FROM cum
"""
