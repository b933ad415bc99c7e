"""Prefix trie against a plain one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from tillroll.llm import trie as module

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("depth", T.StringType()), T.StructField("n", T.StringType())])


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def whole(rows):
    """Turns of each conversation in order, from the definition."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    found = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else convs.get(int(c / 100) * 100, [])
        found[c] = base[:h] + own[h:]
    return found


def plain(convs):
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    least = lambda m: min(m, key=lambda c: (c is None, c or 0))
    children = {n: 0 for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    leaves, saved = {n: 0 for n in nodes}, {n: 0 for n in nodes}
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    found = []
    for n, members in nodes.items():
        ids = sorted(c for c in members if c is not None and len(convs[c]) == len(n))
        found.append((least(members), len(n), least(nodes[n[:-1]]) if n else None, len(members), children[n], leaves[n], saved[n],
                      hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    return sorted(found, key=str)


def sample(seed=1, n=130):
    rng = random.Random(seed)
    pool = [("user", "a"), ("assistant", "b"), ("user", "ü" * 30), (None, None), ("", ""), ("user", "A" * 5000)]
    rows = []
    for c in [*range(n), 205, 300, -5, -150, None]:
        first = rng.choice([[0], [0, 1], [0, 1, 2, 0, 1, 2, 0, 1, 2], [3]])
        path = first + [rng.randrange(len(pool)) for _ in range(rng.choice([0, 0, 1, 3, 9]))]
        for i, k in enumerate(path):
            rows.append((c, rng.choice([None, i]) if c == 7 else i, *pool[k], "x", "y"))
    rows += [(60, 0, "user", "again", "x", "y")] * 3  # ties and repeated rows
    return rows


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_a_plain_trie(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert results(module.op11_prefix_trie(spark, str(tmp_path))) == plain(rebuilt(whole(rows)))


@pytest.mark.parametrize("block,stretch", [(1, 1), (2, 1), (3, 2), (4, 4096)])
def test_blocks_of_any_length(spark, block, stretch):
    """Long conversations are carried from stretch to stretch, whatever the blocks."""
    rows = sample(4, 30)
    said = module.turns(spark.createDataFrame(rows, TURNS))
    assert results(module.trie(*module.as_they_are(*module.placed(said, 4)), block, stretch)) == plain(whole(rows))


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", str(t)) for c in range(300) for t in range(6)] + [(1000 + c, t, "user", str(t) if t < 5 else f"other {c}") for c in range(40) for t in range(7)]
    said = module.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert results(module.trie(*module.as_they_are(*module.placed(said)))) == plain(whole(rows))


def test_empty_table(spark):
    said = module.turns(spark.createDataFrame([], TURNS))
    assert module.trie(*module.as_they_are(*module.placed(said))).count() == 0


def test_pieces_of_ids_are_one_text(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 10)
    last = spark.createDataFrame([(1, 2, 3, i) for i in range(200)] + [(1, 2, 4, 7)], "depth long, a long, b long, conv_id long")
    found = {r.b: r.ends_sha256 for r in module.ends(last).collect()}
    assert found == {3: hashlib.sha256(",".join(map(str, range(200))).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}
