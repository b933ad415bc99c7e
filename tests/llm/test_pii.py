import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tillroll.llm import pii

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()),
                     T.StructField("id", T.StringType())])
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("0123459@@..+-() ab%é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), repr(text)
    for text in ("a@b.c@d.e", "x@y.z.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (743) 555-3824",
                 "+1+1 2345678901", "a@b@c.d", "..@a.b", "@a.b", "4111111111111111" * 3):
        assert pii.base_spans(text) == plain(text)


def test_scans_are_linear():
    for text in ("a" * 400_000, "a." * 200_000, "@" * 300_000, "1" * 400_000, "+" * 300_000, "1." * 200_000, "1 " * 200_000, "a@" * 150_000, "+1 (" * 100_000):
        pii.label_batch([text], FLAT)


FLAT = pii.fit([], np.zeros((5, 5)), np.zeros((5, 5)))


def test_message_passing_is_exact_on_trees_and_close_on_a_loop():
    rng = np.random.default_rng(1)
    for edges in ([(0, 1), (1, 2), (1, 3)], [(0, 1), (1, 2), (2, 3), (0, 3)]):
        node, tables = rng.normal(size=(4, 3)), rng.normal(size=(len(edges), 3, 3)) * 0.4
        weights = {}
        for states in itertools.product(range(3), repeat=4):
            weights[states] = np.exp(sum(node[i, s] for i, s in enumerate(states)) + sum(t[states[a], states[b]] for (a, b), t in zip(edges, tables)))
        exact = np.zeros((4, 3))
        for states, w in weights.items():
            for i, s in enumerate(states):
                exact[i, s] += w
        exact /= exact.sum(1, keepdims=True)
        got = pii.marginals(node, np.array(edges), tables, rounds=60)
        assert np.abs(got - exact).max() < (1e-6 if len(edges) == 3 else 0.05)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))


def test_other_writings_and_repeats_are_found_in_held_out_texts(field):
    rng = random.Random(7)
    hits = {"phone": 0, "email": 0}
    for i in range(100):
        fill = lambda n: " ".join(word(rng) for _ in range(n))
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        mail = f"{word(rng)}.{i}(at)mail{i % 9}.example.com"
        text = f"{fill(20)} +1 {number} {fill(30)} {number}, {fill(20)} {mail} {fill(9)}."
        (base, extra), = pii.label_batch([text], field)
        assert base == plain(text)
        said = {(pii.KINDS[k], text[a:b]) for k, a, b in extra}
        hits["phone"] += any(k == "phone" and s in number and "555-" in s for k, s in said)
        hits["email"] += ("email", mail) in said
    assert hits["phone"] > 90 and hits["email"] > 90


def test_clean_texts_get_no_further_spans(field):
    rng = random.Random(8)
    texts = [" ".join(rng.choice([word(rng), str(rng.randint(0, 3000)), "12.5", "2011-10-01", "v1.2.3", "1,234", "10:30"]) for _ in range(80)) for _ in range(200)]
    assert sum(bool(extra) for _, extra in pii.label_batch(texts, field)) <= 2


def test_repeats_carry_the_label(field):
    """The same field without skip edges is less sure of a number that another place names."""
    text = "call +1 (743) 555-3824 now and later " + "word " * 30 + "(743) 555-3824 again"
    spans = pii.candidates(text)
    own, bare = pii.features(text, spans)
    chain, skip = pii._edges(text, spans, bare)
    assert skip  # the number's later tokens are joined with its first
    node = np.stack([field.node[r].sum(0) for r in own])
    given = np.array(pii._labels(spans, pii.base_spans(text)))
    for i in np.flatnonzero(given):
        node[i] -= pii.GIVEN
        node[i, given[i]] += 2 * pii.GIVEN
    tables = lambda n, t: np.repeat(t[None], n, axis=0)
    without = pii.marginals(node, np.array(chain), tables(len(chain), field.chain))
    both = pii.marginals(node, np.array(chain + skip), np.concatenate([tables(len(chain), field.chain), tables(len(skip), field.skip)]))
    last = len(spans) - 1
    assert both[last, 4] >= without[last, 4]


def test_a_label_reaches_far_occurrences():
    rng = np.random.default_rng(2)
    for n in (50, 3_000):  # exact marginals of a chain, forwards and backwards
        node, tables = rng.normal(size=(n, 3)) * 0.01, np.repeat(np.eye(3)[None] * 8, n - 1, axis=0)
        node[0] = (40, 0, 0)
        ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
        for i in range(1, n):
            ahead[i] = np.logaddexp.reduce((node[i - 1] + ahead[i - 1])[:, None] + tables[i - 1], axis=0)
            behind[n - 1 - i] = np.logaddexp.reduce((node[n - i] + behind[n - i])[None] + tables[n - 1 - i], axis=1)
        exact = node + ahead + behind
        exact = np.exp(exact - exact.max(1, keepdims=True))
        got = pii.marginals(node, np.array([(i, i + 1) for i in range(n - 1)]), tables)
        assert np.abs(got - exact / exact.sum(1, keepdims=True)).max() < 1e-3
    sure = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), np.eye(5) * 8)
    for between in (" word ", " v7 word "):
        text = "+17435553824" + (between + "17435553824") * 49
        (base, extra), = pii.label_batch([text], sure)
        assert base == [(3, 0, 12)]
        assert [text[a:b] for k, a, b in extra if k == 3] == ["17435553824"] * 49


def test_long_tokens_are_compared_whole():
    head = "https://example.org/" + "path/" * 20 + "item-2345678"
    text = f"{head}?one {'word ' * 9}{head}?two {'word ' * 9}{head}?one"
    spans = pii.candidates(text)
    _, bare = pii.features(text, spans)
    assert bare == text.replace("word ", "").split()
    letters = [f"{'x' * 90}@{c}" for c in "aba"]
    spans = pii.candidates(" - ".join(letters))
    _, bare = pii.features(" - ".join(letters), spans)
    assert pii._edges(" - ".join(letters), spans, bare)[1] == [(0, 2)]
    own, _ = pii.features("x" * 90 + "@" + "1" * 9, [(0, 100)])
    assert 3 * pii.N_SHAPES + len(pii.CUES) + 16 + 1 in own[0]  # the at sign stands after 80 characters


def test_message_passing_comes_to_rest_on_any_graph():
    rng = np.random.default_rng(3)
    edges = np.array([(a, b) for a in range(30) for b in range(a) if rng.random() < 0.4])
    got = pii.marginals(rng.normal(size=(30, 5)), edges, rng.normal(size=(len(edges), 5, 5)) * 3)
    assert np.isfinite(got).all() and np.allclose(got.sum(1), 1)


def test_rows_nulls_and_empty_tables(spark, small):
    rows = [(1, None, "s", "i"), (2, "", "s", "i"), (None, "mail a@b.co", "s", "i"), (3, "mail a@b.co", "s", "i"), (3, "mail a@b.co", "s", "i"),
            (4, "x" * 200_000 + " 10.0.0.1", "s", "i")]
    got = pii.find(spark.createDataFrame(rows, DOCS)).collect()
    by = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got]
    assert sorted(by, key=str) == sorted([(1, []), (2, []), (None, [("email", 5, 11)]), (3, [("email", 5, 11)]), (3, [("email", 5, 11)]),
                                          (4, [("ip", 200_001, 200_009)])], key=str)
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in pii.op9_pii(spark, small).collect():
        kinds = [k for k, *_ in plain(docs[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in range(4)]
