import hashlib
import random

import numpy as np
from pyspark.sql import types as T

from tillroll.llm import exact

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()),
                     T.StructField("keep_id", T.StringType()), T.StructField("chunk", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "k", "c") for i, t in rows], DOCS)


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = lambda ids: max(ids, key=lambda x: (x is not None, x))
    return sorted(((i, best(groups[(t or "").translate(LOWER)]), len(groups[(t or "").translate(LOWER)]),
                    hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()) for i, t in rows), key=str)


def decided(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def sample():
    rng = random.Random(1)
    pool = ["", None, "A b", "a B", "a b ", "É", "é", "x" * 200_000, "X" * 200_000, "x" * 199_999 + "y", "x" * 65_536, "x" * 65_537, "\x00", "日本"]
    return [(i, rng.choice(pool)) for i in range(150)] + [(None, "A b"), (None, "null id only"), (7, "twice"), (7, "TWICE")]


def test_equals_plain_grouping(spark):
    rows = sample()
    found = exact.decide(table(spark, rows).repartition(4))
    assert decided(found) == plain(rows)
    kept = [r for r in found.collect() if r.kept]
    assert len(kept) == len({(t or "").translate(LOWER) for _, t in rows})


def test_colliding_fingerprints_are_told_apart(spark):
    rows = sample()
    assert decided(exact.decide(table(spark, rows), primes=(3, 3), bases=(2, 2))) == plain(rows)


def test_fingerprints_combine():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    printer = exact.Printer()
    whole = printer(data)
    for cut in (0, 1, 65_536, 100_001, 300_000):
        left, right = printer(data[:cut]), printer(data[cut:])
        for k, (prime, base, _) in enumerate(printer.parts):
            assert exact.combine(left[k], right[k], 300_000 - cut, base, prime) == whole[k]
    prime, base, _ = printer.parts[0]
    value = 0
    for b in data[:2000].tolist():
        value = (value * base + b + 1) % prime
    assert printer(data[:2000])[0] == value
    assert printer(np.zeros(3, np.uint8)) != printer(np.zeros(4, np.uint8))


def test_rows_that_stay_keep_their_columns(spark):
    rows = sample()
    docs = table(spark, rows)
    got = exact.deduplicate(docs)
    assert got.columns == docs.columns
    stay = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert len(stay) == len({(t or "").translate(LOWER) for _, t in rows})
    assert (7, "twice") in stay or (7, "TWICE") in stay
    assert exact.deduplicate(docs.limit(0)).count() == 0 and exact.decide(docs.limit(0)).count() == 0


def test_a_large_group(spark):
    docs = table(spark, [(i, "Same TEXT") for i in range(5_000)] + [(9_000, "other")])
    got = exact.decide(docs).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(4_999, 5_000), (9_000, 1)}


def test_rows_of_files_are_not_stored_again(spark, tmp_path):
    """Keys of rows come from their files; repeated rows are told apart, and projected tables are stored."""
    from tillroll.llm.common import keyed

    rows = sample()
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert keyed(docs, "k").select("k").distinct().count() == len(rows)
    assert sorted(keyed(docs, "k").collect(), key=str) == sorted(keyed(docs, "k").collect(), key=str)
    repeated = docs.select("*").union(docs)
    assert keyed(repeated, "k").select("k").distinct().count() == 2 * len(rows)
    got = sorted(((r.doc_id, r.text) for r in exact.deduplicate(docs).collect()), key=str)
    assert len(got) == len({(t or "").translate(LOWER) for _, t in rows})
    assert exact.deduplicate(repeated).count() == len(got)
