"""Fingerprints against plain ones, from the definition."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from parity.check import connect
from tillroll.llm import fingerprint as module

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("part", T.StringType())])
AMOUNT = [0] + [round(c * math.log2(c) * (1 << 20)) for c in range(1, 65)]


def windows(data):
    return [data[i:i + 64] for i in range(len(data) - 63)]


def entropy(window):
    return 1000 - sum(AMOUNT[c] for c in Counter(window).values()) * 1000 // AMOUNT[64]


def plain_ranks(texts):
    counts = Counter(entropy(w) for t in texts for w in windows(t))
    order = sorted(range(1001), key=lambda b: (b < 100, counts[b], b))
    return {b: i for i, b in enumerate(order)}


def plain_places(data, ranks):
    found = [ranks[entropy(w)] for w in windows(data)]
    points = Counter()
    for s in range(len(found)):
        near = found[s:s + 64]
        points[s + near.index(min(near))] += 1
    places = sorted(p for p, n in points.items() if n >= 16)
    return places or ([max(points, key=lambda p: (points[p], -p))] if points else [])


def plain_fingerprint(data, ranks):
    features = [data[p:p + 64] for p in plain_places(data, ranks)] if len(data) >= 64 else [data] if data else []
    features = list(dict.fromkeys(features))
    out = b""
    for i in range(0, len(features), 160):
        bits = np.zeros(2048, np.uint8)
        for f in features[i:i + 160]:
            value = int(module.hashes(np.frombuffer(f.ljust(64, b"\0"), np.uint8)[None])[0])
            value = (value + len(f)) % 2**64 if len(f) < 64 else value
            for k in range(5):
                bits[(value >> (11 * k)) % 2048] = 1
        out += len(features[i:i + 160]).to_bytes(2, "big") + np.packbits(bits).tobytes()
    return base64.b64encode(out).decode()


def plain_likeness(left, right):
    def read(text):
        raw = base64.b64decode(text)
        return [(int.from_bytes(raw[i:i + 2], "big"), int.from_bytes(raw[i + 2:i + 258], "big")) for i in range(0, len(raw), 258)]

    a, b = read(left), read(right)
    if [x[1] for x in a] == [x[1] for x in b]:
        return 1.0
    if not a or not b:
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    total = 0.0
    for n, x in small:
        best = 0.0
        for _, y in large:
            s, t, both = x.bit_count(), y.bit_count(), (x & y).bit_count()
            chance = s * t / 2048
            if both > chance + 4 * math.sqrt(chance) + 1 and min(s, t) > chance:
                best = max(best, (both - chance) / (min(s, t) - chance))
        total += n * best
    return min(1.0, total / sum(n for n, _ in small))


def sample(n=60):
    rng = random.Random(2)
    syllables = ["ta", "ko", "ré", "ing", "Schl", "日", "x7", " "]
    make = lambda k: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(k))
    texts = [None, "", "short", "a" * 64, "b" * 500, "ab" * 40, make(4000)] + [make(rng.choice([3, 12, 20, 60, 200])) for _ in range(n)]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    return rows + [(1000, "twice " * 30)] * 3 + [(2000 + i, texts[9]) for i in range(4)] + [(None, "without an id " * 9)]


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [t or "" for _, t in order]
    ranks = plain_ranks([t.encode() for t in texts])
    prints = [plain_fingerprint(t.encode(), ranks) for t in texts]
    found = []
    for i, (identity, _) in enumerate(order):
        j = (i + 1) % len(order)
        half = len(texts[i]) // 2
        other = texts[i][:len(texts[i]) - half] + texts[j][:half]
        p = plain_fingerprint(other.encode(), ranks)
        found.append((identity, len(texts[i]), hashlib.sha256(other.encode()).hexdigest(), prints[i], p,
                      plain_likeness(prints[i], p), plain_likeness(prints[i], prints[j])))
    return sorted(found, key=str)


def results(spark, rows, folder, parts=3):
    docs = spark.createDataFrame([(*r, "i", "r", "p") for r in rows], DOCS)
    docs.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in module.op13_fingerprint(spark, str(folder)).collect()), key=str)


def same(found, wanted):
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in wanted])


def test_equals_plain_fingerprints(spark, tmp_path):
    rows = sample()
    found = results(spark, rows, tmp_path)
    same(found, plain(rows))
    by_text = {}
    for f in found:
        by_text.setdefault(dict((r[0], r[1]) for r in rows)[f[0]], set()).add(f[3])
    assert all(len(p) == 1 for p in by_text.values())  # equal texts have equal fingerprints


@pytest.mark.parametrize("rows", [[], [(1, "alone " * 40)], [(1, None), (2, "x" * 70)]])
def test_small_tables(spark, tmp_path, rows):
    same(results(spark, rows, tmp_path), plain(rows))


def test_tables_that_are_not_files(spark):
    rows = [(r[0], r[1], "i", "r", "p") for r in sample(10)]
    found = module.with_next(spark.createDataFrame(rows, DOCS).where("text is not null"))
    same(sorted((tuple(r) for r in found.collect()), key=str), plain([r[:2] for r in rows if r[1] is not None]))


def test_pieces_of_long_texts_give_the_same():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 104, n).astype(np.uint8).tobytes() for n in (10, 64, 65, 700, 5000, 20_000)] + [b"abc" * 900]
    body, ends = module._joined(texts)
    counts = np.bincount(np.concatenate([module.entropies(body[a:b]) for a, b in zip(ends, ends[1:])]), minlength=module.BINS)
    ranks = module.ranked(counts)
    table = dict(enumerate(ranks.tolist()))
    whole = module.selected(body, ends, ranks)
    for t, text in enumerate(texts[:5]):
        assert (whole[0][whole[1] == t] - ends[t]).tolist() == plain_places(text, table)
    for block in (130, 1000, 6000):
        pieces = module.selected(body, ends, ranks, block)
        assert (pieces[0] == whole[0]).all() and (pieces[1] == whole[1]).all()


def test_copies_edited_and_other_documents(spark, small):
    """On whole given tables: half of an edited document's features remain, other documents share next to none, equal texts all."""
    found = module.op13_fingerprint(spark, small).toPandas()
    docs = connect(small).execute("SELECT doc_id, coalesce(text, '') AS text FROM documents ORDER BY doc_id DESC").df()
    docs["next"] = np.roll(docs.text, -1)
    docs["half"] = docs.text.str.len() // 2
    docs["other"] = [t[:len(t) - h] + n[:h] for t, n, h in zip(docs.text, docs.next, docs.half)]
    both = found.merge(docs, on="doc_id")
    assert len(both) == len(found) == len(docs)
    assert (both.edited_sha256 == [hashlib.sha256(t.encode()).hexdigest() for t in both.other]).all() and (both.n_chars == both.text.str.len()).all()
    assert both.groupby("text").fingerprint.nunique().max() == 1
    differ = both[(both.text != both.next) & (both.n_chars > 600)]
    assert 0.4 < differ.near_edited.mean() < 0.65 and differ.near_next.mean() < 0.05
    assert ((differ.near_edited > differ.near_next).mean()) > 0.95
