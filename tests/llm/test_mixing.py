import random
import re
from fractions import Fraction

from pyspark.sql import functions as F, types as T

from tillroll.llm import mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("copies", T.StringType()), T.StructField("mix_source", T.StringType())])


def plain_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, capped at twice the size, what is over reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_ones, target = Fraction(3 * sum(sizes.values()), 2), list(order), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        share = {s: left * weight[s] / total for s in open_ones}
        over = [s for s in open_ones if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
            open_ones.remove(s)
    return target


def plain_mix(rows, target):
    """Rows in the order of their numbers until the source is nearest to its target; equal numbers go together."""
    taken = {}
    for s in target:
        own = sorted((r for r in rows if r.source == s and r.size), key=lambda r: r.number)
        total = sum(r.size for r in own)
        goal, base = float(target[s]), 0
        if total:
            base = int(goal // total)
            goal -= base * total
        reach, limit, i = 0, None, 0
        while i < len(own):
            j = i
            while j < len(own) and own[j].number == own[i].number:
                j += 1
            unit = sum(r.size for r in own[i:j])
            if reach + unit > goal:
                limit = own[i].number + (1 if reach + unit - goal < goal - reach else 0)
                break
            reach, i = reach + unit, j
        for r in rows:
            if r.source == s:
                taken[r.key] = r.size * (base + (limit is None or r.number < limit))
    return taken


def check(spark, data):
    docs = spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in data], DOCS).repartition(3)
    found = mixing.decide(docs)
    numbered = docs.select(mixing.number(F.col("doc_id"), F.col("text")).alias("number"), "doc_id", "text", "source").collect()
    from collections import namedtuple
    Row = namedtuple("Row", "key source size number")
    rows = [Row((r.doc_id, r.text, r.source), r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.number) for r in numbered]
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = plain_targets(sizes)
    got = found.collect()
    assert len(got) == len(rows)
    want = plain_mix(rows, target)
    texts = {r.doc_id: (r.doc_id, r.text, r.source) for r in numbered if r.doc_id is not None}
    for r in got:
        if r.doc_id is None:
            continue
        key = texts[r.doc_id]
        assert r.source_size == sizes[key[2]]
        assert abs(r.target - float(target[key[2]])) <= 1e-9 * max(1, r.target)
        assert r.size * r.copies == want[key], (r, want[key])
        assert r.copies <= 2
    return got, sizes, target, docs


def test_equals_a_plain_mix(spark):
    rng = random.Random(4)
    for kind in range(5):
        data = []
        for i in range(rng.randint(30, 200)):
            source = rng.choice(["a", "b", "B", "é", "", None, "zz"][:kind + 3])
            n = rng.choice([0, 1, 3, 50, 2000 if source == "a" else 20])
            data.append((i, rng.choice([None, ""]) if n == 0 else "w " * n, source))
        check(spark, data)


def test_one_source_holds_most_and_one_document_is_a_source(spark):
    data = [(i, "w " * 100, "hot") for i in range(300)] + [(1000, "w " * 7, None), (1001, "w " * 9, "one"), (1002, "", "empty")]
    got, sizes, target, docs = check(spark, data)
    by = {}
    for r in got:
        by[r.source_size] = by.get(r.source_size, 0) + r.size * r.copies
    for s, size in sizes.items():
        assert abs(by[size] - float(target[s])) <= 100
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {r.doc_id: r.copies for r in got if r.copies}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "w w", "a")] * 3 + [(5, "w w w", "a")] * 4 + [(i, "w", "b") for i in range(10, 50)]
    docs = spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], DOCS)
    got = mixing.decide(docs).collect()
    assert len(got) == len(rows)
    assert len({r.copies for r in got if r.doc_id == 5}) == 1  # equal rows are taken together
    assert mixing.decide(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.decide(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("size")).first()[0] == 0


def test_reruns_and_other_partitions_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = mixing.decide(docs).collect(), mixing.decide(docs.repartition(7)).collect()
    assert sorted(a) == sorted(b)


def test_no_python_in_the_plan(spark, small):
    plan = mixing.op7_mixing(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
