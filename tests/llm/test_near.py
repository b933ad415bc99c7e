import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tillroll.llm import graph, near

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()),
                     T.StructField("mark", T.StringType()), T.StructField("registers", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", "m", "r") for i, t in rows], DOCS)


def shingle_set(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, size, percent):
    """(sizes, smallest id of the group) by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def prose(rng, n):
    return [("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))) for _ in range(n)]


def sample(seed, groups=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        first = prose(rng, rng.randint(1, 250))
        rows.append(first)
        for _ in range(rng.randint(0, 8)):
            other = list(first)
            for _ in range(rng.randint(0, max(1, len(first) // 25))):
                other[rng.randrange(len(other))] = rng.choice(["new", "word", "Here"])
            rows.append([w.upper() if rng.random() < 0.2 else w for w in other])
    texts = [rng.choice([" ", "\n", "  "]).join(r) for r in rows] + ["", None, " \n", "a", "A", "a b", "a  b", "b a"]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_equals_all_pairs(spark, seed, size, percent):
    rows = sample(seed)
    found = near.decide(table(spark, rows).repartition(3), size=size, percent=percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert got == plain(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """More members than a block, with pairs on both sides of the threshold."""
    monkeypatch.setattr(near, "BLOCK", 40)
    rng = random.Random(5)
    first = prose(rng, 150)
    rows = []
    for i in range(150):
        other = list(first)
        for k in rng.sample(range(150), rng.randint(0, 7)):
            other[k] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(other)))
    want = plain(rows, 3, 85)
    assert 1 < len({g for _, g in want.values()}) < 150
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.decide(table(spark, rows), size=3, percent=85).collect()}
    assert got == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rng = random.Random(6)
    text = " ".join(prose(rng, 60))
    rows = [(5, text), (5, text), (None, text), (9, text + " end"), (5, "another text with the same id"), (None, None), (11, "")]
    docs = table(spark, rows)
    got = [(r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in near.decide(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 5, True, True), (5, 5, True, True), (None, 5, False, True), (9, 5, False, True), (5, 5, True, True),
                                           (None, None, True, False), (11, 11, True, False)], key=str)
    stay = near.deduplicate(docs)
    assert stay.columns == docs.columns and stay.count() == 5
    assert near.decide(docs.limit(0)).count() == 0 and near.deduplicate(docs.limit(0)).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(7)
    for n, overlap in ((40, 30), (600, 540), (5_000, 1_000), (20_000, 19_000)):
        errors = []
        for _ in range(8):
            pool = rng.integers(0, 2**63, 2 * n - overlap).astype(np.uint64)
            a, b = pool[:n], pool[n - overlap:]
            x, y = near.sketch(a), near.sketch(b)
            assert (near.merge(x, y) == near.sketch(pool)).all()
            more, less = np.array([(x > y).sum()]), np.array([(x < y).sum()])
            errors.append(near.estimate(more, less, len(x) - more - less, np.array([float(n)]), np.array([float(n)]))[0] - overlap / (2 * n - overlap))
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < near.margin(0.5)


def test_rising_likelihood_is_the_estimate():
    rng = np.random.default_rng(9)
    equal = rng.integers(60, 320, 300)
    more = rng.binomial(320 - equal, 0.5)
    n_a, n_b = rng.integers(90, 110, 300).astype(float), rng.integers(90, 110, 300).astype(float)
    best = near.estimate(more, 320 - equal - more, equal, n_a, n_b, np.linspace(0, 1, 1001))
    for t in (0.5, 0.7, 0.74):
        clear = np.abs(best - t) > 0.01
        assert ((best >= t) == near.at_least(more, 320 - equal - more, equal, n_a, n_b, t))[clear].all()


@pytest.mark.parametrize("hubs,slab", [(0, 7), (8, 4096)])
def test_links_connect_what_pairs_connect(monkeypatch, hubs, slab):
    """Both ways of verification, against all pairs."""
    monkeypatch.setattr(near, "HUBS", hubs)
    monkeypatch.setattr(near, "SLAB", slab)
    rng = np.random.default_rng(4)
    for size, copies in ((150, 60), (40, 12), (2_000, 10)):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        elements = []
        for _ in range(copies):
            own = base.copy()
            changed = rng.integers(0, size, rng.integers(0, size // 6))
            own[changed] = rng.integers(0, 2**63, len(changed)).astype(np.uint64)
            elements.append(np.unique(own))
        registers = np.stack([near.sketch(e) for e in elements])
        links = near.verified_links(elements, registers, 85, np.ones(copies, bool))
        up = list(range(copies))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            same = len(np.intersect1d(elements[a], elements[b]))
            assert 100 * same >= 85 * (len(elements[a]) + len(elements[b]) - same)
            assert find(a) != find(b)
            up[find(a)] = find(b)
        for a in range(copies):
            for b in range(a):
                same = len(np.intersect1d(elements[a], elements[b]))
                if 100 * same >= 85 * (len(elements[a]) + len(elements[b]) - same):
                    assert find(a) == find(b)


def test_bands_miss_less_than_one_pair_in_a_million():
    for s in (0.8, 0.85):
        r = near.band_rows(s)
        assert r >= 6 and (1 - s**r) ** (near.REGISTERS // r) <= near.MISS


def test_components_equal_a_plain_search(spark):
    rng = random.Random(8)
    for n, m in ((60, 40), (200, 210), (50, 49)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 50 else [(i, i + 1) for i in range(49)]
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        met = {v for a, b in edges if a != b for v in (a, b)}
        got = graph.components(spark.createDataFrame(edges, "a int, b int")).collect()
        assert {r.node: r.root for r in got} == {v: find(v) for v in met} and len(got) == len(met)
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_unrelated_sketches_form_no_family(spark):
    """Bands of few registers, so that unrelated texts meet in most buckets: families do not grow past the true groups."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    rows, of = [], {}
    for g in range(500):
        pool = rng.integers(0, 2**63, 150).astype(np.uint64)
        for k in range(1 + (g % 25 == 0) * 3):  # twenty groups of four near copies among 480 single ones
            own = np.concatenate((pool[:146], rng.integers(0, 2**63, 4).astype(np.uint64)))
            node = bytes(rng.integers(0, 256, 16).astype(np.uint8))
            of[node] = g
            rows.append((bytearray(node), 150, bytearray(near.sketch(own).tobytes())))
    classes = spark.createDataFrame(rows, "node binary, n_shingles long, registers binary").repartition(3)
    bands = F.transform(F.sequence(F.lit(0), F.lit(159)), lambda i: F.xxhash64(i, F.substring("registers", i * 2 + 1, F.lit(2))))
    entries = classes.select(F.explode(bands).alias("b")).groupBy("b").count()
    assert entries.where("count > 1").count() > 5_000  # nearly all buckets are met by unrelated texts
    edges = near.candidates(classes, bands, 0.8, rounds=60).collect()
    assert {of[bytes(e.a)] == of[bytes(e.b)] for e in edges} == {True}
    roots = {bytes(r.node): bytes(r.root) for r in graph.components(spark.createDataFrame(edges)).collect()}
    sizes = {}
    for node, root in roots.items():
        sizes.setdefault(root, []).append(of[node])
    assert sorted(len(v) for v in sizes.values()) == [4] * 20 and all(len(set(v)) == 1 for v in sizes.values())
    # after the last round what is left is joined unseen, which loses nothing
    again = graph.components(near.candidates(classes, bands, 0.8, rounds=1)).collect()
    joined = {bytes(r.node): bytes(r.root) for r in again}
    assert all(joined[a] == joined[b] for v in sizes for a in roots for b in [v] if roots[a] == v)


def test_registers_grow_with_the_documents():
    counts = [near.registers_for(0.8, n) for n in (0, 10_000, 10**6, 10**9, 5 * 10**10)]
    assert counts[:3] == [near.REGISTERS] * 3 and counts[2] < counts[3] < counts[4] < 1_000
    for n, count in ((10**9, counts[3]), (5 * 10**10, counts[4])):
        rows = near.band_rows(0.8, count)
        assert n * 0.0455 ** rows <= near.MEETINGS and (1 - 0.8 ** rows) ** (count // rows) <= near.MISS
    least, close = near.bounds(0.8, 320)
    assert 0.4 < least < 0.6 < 0.8 < close < 0.9
