"""Merkle manifests against a plain tree, and proofs on their own."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tillroll.llm import merkle
from tillroll.llm.ranks import numbered

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()), T.StructField("leaf", T.StringType()),
                     T.StructField("part", T.StringType()), T.StructField("index", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    found = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8:i // 8 * 8 + 8]
        found.append((i % 8, run[:i % 8] + run[i % 8 + 1:]))
        i //= 8
    return found


def folded(value, proof):
    for place, others in proof:
        value = h("".join(others[:place] + [value] + others[place:]))
    return value


def plain(rows):
    """Rows of the query, from the definition."""
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row, row[4]), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order]
    upper = climb([t[-1][0] for t in trees])
    found = []
    for j, g in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(langs[g], key=lambda x: x[:3])):
            proof = siblings(trees[j], i) + siblings(upper, j)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            claimed = plain_leaf(row, row[4].translate(LOWER)) if bad and row[4] is not None else leaf
            root = folded(claimed, proof)
            found.append((row[0], leaf, trees[j][-1][0], upper[-1][0], h("".join("".join(o) for _, o in proof)), root, root == upper[-1][0]))
    return sorted(found, key=str)


def sample(n=700, seed=3):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", "é", None, ""] + [f"x{i}" for i in range(12)]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Text A", "lower only", "ÄÖ Über", "Long TEXT " * 2000, "日本"])
        rows.append((rng.choice([None, 5, i, i, i, i, -i]), rng.choice([None, "web", ""]), rng.choice(langs), rng.choice([None, 3, 12]), text, "l", "p", "x"))
    rows += [(77, "s", "hot", 1, "Same Row", "l", "p", "x")] * 90 + [(9, "s", "only one", 1, "X", "l", "p", "x")]
    return rows


def results(spark, rows, folder):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(spark, str(folder)).collect()), key=str)


def test_equals_a_plain_tree(spark, tmp_path):
    rows = sample()
    assert results(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, "l", "p", "x")], [(i, "s", "en", 1, "A", "l", "p", "x") for i in range(9)]])
def test_small_tables(spark, tmp_path, rows):
    assert results(spark, rows, tmp_path) == plain(rows)


def test_short_runs_give_the_same_places(spark):
    rows = spark.createDataFrame([(i % 3, i % 50, str(i)) for i in range(400)] + [(None, None, "n")] * 40, "g long, o long, v string")
    table, runs = numbered(rows, "g", ["o", "v"], "test", most=7)
    found = table.join(runs.drop("g"), ["part", "run"]).select("g", "o", "v", (F.col("start") + F.col("at")).alias("place"), "size", "at", "n").collect()
    assert max(r.at for r in found) < 7 and max(r.n for r in found) <= 7
    for g in (0, 1, 2, None):
        own = sorted((r for r in found if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(own[0]["size"])) and len(own) == own[0]["size"]
        assert [(r.o, r.v) for r in own] == sorted((r.o, r.v) for r in own)


def test_least_coordinates():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 9, 64, 65, 700):
        for n in {1, min(size, 5), size}:
            places = rng.choice(size, n, replace=False)
            found = set(merkle.missing(places, size))
            # from the definition: siblings of known nodes that cannot be derived from the leaves at hand
            derived, level, now, wanted = set(places.tolist()), 0, size, set()
            while now > 1:
                for i in derived:
                    wanted |= {(level, j) for j in range(i // 8 * 8, min(i // 8 * 8 + 8, now)) if j not in derived}
                derived, now, level = {i // 8 for i in derived}, -(-now // 8), level + 1
            assert found == wanted


def test_proofs_of_some_rows(spark):
    rows = sample(300, 5)
    docs = spark.createDataFrame(rows, DOCS)
    made = merkle.manifest(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf([docs[c] for c in merkle.FIELDS]).alias("leaf")))
    root = made.root()
    assert root == plain(rows)[0][3]
    assert {r.subroot for r in made.subroots().collect()} == {r[2] for r in plain(rows)}
    some = merkle.proofs(made, made.leaves.where("id % 5 = 0")).collect()
    assert len(some) == sum(r[0] is not None and r[0] % 5 == 0 for r in rows)
    for r in some:
        assert merkle.fold(r.leaf, r.path, r.siblings) == root == r.folded_root == r.root
        assert merkle.fold(h("other"), r.path, r.siblings) != root


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(f"k{i}", "en", f"t{i}") for i in range(20)], "key string, lang string, text string")
    made = merkle.manifest(docs.select(F.col("lang").alias("group"), F.col("key").alias("id"), merkle.leaf([docs["key"], docs["text"]]).alias("leaf")))
    found = merkle.proofs(made).collect()
    assert {r.id for r in found} == {f"k{i}" for i in range(20)} and all(r.folded_root == r.root for r in found)
