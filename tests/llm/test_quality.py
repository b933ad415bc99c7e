import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tillroll.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("quality", T.StringType()), T.StructField("cell", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    hit = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def texts():
    rng = random.Random(4)
    made = []
    for n in (0, 1, 4, 5, 6, 9, 10, 30, 200, 2000):
        for _ in range(6):
            w = ["".join(rng.choice("abcé#|") for _ in range(rng.randint(1, 3))) for _ in range(n)]
            made.append(rng.choice([" ", "\n", "\t"]).join(w) + rng.choice(["", "\n", " \n\n", "\r\n"]))
    return made + [None, "", "\n\n", "a b c d e " * 7, "x " * 50, "one two three four five one two three four five", "w\n" * 40, "\x0b\x0c a b  ", "z" * 100_000]


def test_base_statistics_equal_a_plain_count(spark):
    made = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", "q", "c") for i, t in enumerate(made)], DOCS)
    found, name = quality.assess(docs, carry=["doc_id", "quality"])
    assert name not in docs.columns
    for r in found.collect():
        got = r[name]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == base(made[r.doc_id]), repr(made[r.doc_id])[:100]
        n, rep = base(made[r.doc_id])[0], base(made[r.doc_id])[4]
        assert got.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (got.base_failed and got.kept)


def prose(rng, n, junk=False):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) + ("***" if junk and i % 2 else "") for i in range(n))


def brute(x, share, starts=60, seed=1):
    """Minimum covariance determinant from its definition: the best subset of the share's size, from many random starts, rows chosen exactly."""
    draw = np.random.default_rng(seed)
    h, res = math.ceil(share * len(x)), np.array(quality.RESOLUTION)
    best = (np.inf, None, None)
    for k in range(starts):
        chosen = x[draw.choice(len(x), 6 if k % 2 else h, replace=False)]
        m, s, last = chosen.mean(0), np.cov(chosen.T, bias=True) + np.diag(res**2), np.inf
        while True:
            d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)
            near = x[np.argsort(d2, kind="stable")[:h]]
            m, s = near.mean(0), quality.consistency(share, 4) * np.cov(near.T, bias=True) + np.diag(res**2)
            now = np.linalg.slogdet(s)[1]
            if now >= last - 1e-9:
                break
            last = now
        if last < best[0]:
            best = (last, m, s)
    return best


def far(x, m, s):
    return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)


def test_least_determinant_of_many_starts(spark):
    """Cells of several shapes, outliers in a third of the rows: no start of the definition finds a determinant that is clearly less."""
    rng = np.random.default_rng(3)
    cells = {}
    for c, n in (("a", 400), ("b", 90), ("c", 1500), ("d", 64)):
        shape = rng.normal(0, 0.3, (4, 4))
        x = rng.normal(0, 1, (n, 4)) @ shape + rng.normal(0, 2, 4)
        x[: n // 3] += rng.normal(0, 3, 4) if c != "d" else 0
        cells[c] = x
    cells["same"] = np.tile([1.0, 0.2, 0.0, 0.0], (80, 1))
    rows = [(c, *map(float, r)) for c, x in cells.items() for r in x]
    found = {r.cell: r for r in quality.estimates(spark.createDataFrame(rows, ["cell", *quality.X]).repartition(3)).collect()}
    for c, x in cells.items():
        logdet, _, _ = brute(x, quality.SHARE)
        assert found[c].logdet <= logdet + 0.1, (c, found[c].logdet, logdet)
        m = np.array([found[c][f"m{i}"] for i in range(4)])
        low = np.array([[found[c][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.linalg.slogdet(low @ low.T)[1] == pytest.approx(found[c].logdet)
        # the state returned is the one whose determinant it is: moments of the share nearest to some centre
        assert np.isfinite(m).all() and found[c].n == len(x)


def test_verdicts_equal_numpy(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(12, 300), junk=i % 5 == 0), "en", "s", "q", "c") for i in range(300)]
    found, name = quality.assess(spark.createDataFrame(rows, DOCS).repartition(3), carry=["doc_id"])
    got = {r.doc_id: r[name] for r in found.collect()}
    vectors = []
    for i, text, *_ in rows:
        n, chars, symbols, dup, rep = base(text)
        lines = len([x for x in text.split("\n") if WORD.search(x)])
        vectors.append([math.log((chars + 100) / (n + 20)), math.sqrt(symbols / (n + 20)), math.sqrt(rep / (n + 20)), math.sqrt(dup / (lines + 5))])
    x = np.array(vectors)
    _, m, s = brute(x, quality.SHARE)
    d2, limit = far(x, m, s), quality.chi2_quantile(quality.CUTOFF, 4)
    for i in range(300):
        assert got[i].kept == (d2[i] <= limit) == (i % 5 != 0)
    mine = np.array([got[i].distance for i in range(300)])
    assert np.corrcoef(np.log(mine + 1), np.log(d2 + 1))[0, 1] > 0.999


def test_outliers_in_one_statistic_only_are_rejected(spark):
    rng = random.Random(10)
    lined = lambda n: "\n".join(prose(rng, 4) for _ in range(n))
    rows = [(i, lined(rng.randint(20, 80)), "en", "s", "q", "c") for i in range(200)]
    same = prose(rng, 3)
    lines = "\n".join(f"{same}\n{prose(rng, 4)}" for _ in range(60))
    passage = "\n".join(prose(rng, 5) for _ in range(38))
    words = f"{lined(200)}\n{passage}\n{lined(202)}\n" + passage.replace("\n", " ")  # the passage again, but on one line
    assert base(lines)[3:] == (59, 0) and base(words)[3] == 0 and 0.19 < base(words)[4] / base(words)[0] < 0.2
    docs = spark.createDataFrame(rows + [(1000, lines, "en", "s", "q", "c"), (1001, words, "en", "s", "q", "c")], DOCS)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(200))


def test_small_groups_are_pooled_and_nulls_are_a_value(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60, junk=i % 10 == 0), ["en", None][i % 2], f"s{i % 30}" if i % 3 else None, "q", "c") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i in range(400) if i % 10}
    assert quality.keep_good(docs).columns == docs.columns
    few = spark.createDataFrame(rows[:20], DOCS)  # too few for any estimate
    assert quality.keep_good(few).count() == 20
    assert quality.keep_good(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert quality.keep_good(twice).count() == 720


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.op4_quality_rules(spark, folder).join(labels, "doc_id")
    good = found.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = found.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and bad < 0.1


def test_no_python_in_the_plan(spark, small):
    found = quality.op4_quality_rules(spark, small)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


def test_chi_square():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert quality.chi2_cdf(quality.chi2_quantile(0.5, 6), 6) == pytest.approx(0.5)
