import random

import pytest
from pyspark.sql import functions as F, types as T

from tillroll.llm import secrets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("word", T.StringType()), T.StructField("candidate", T.StringType()), T.StructField("path", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "w", "c", "p") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def sampled(spark):
    return secrets._sampled(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", 500)


@pytest.fixture(scope="module")
def model(sampled):
    return secrets.train(sampled)


def test_candidates_with_their_neighbours(spark):
    rows = [(1, "set token = \"abc123def456ghi\" now please", "s"), (2, "x key=Ab1Cd2Ef3Gh4Ij5==;", None), (3, None, "s"), (4, "", "s"),
            (5, "abcdefghijklmnop 1234567890123456 short1", "s"), (6, "abc123def456ghi abc123def456ghi", "s"), (None, "first1234567 z", "s")]
    got = {(r.id, r.word): r for r in secrets.candidates(table(spark, rows)).collect()}
    assert set(got) == {(1, 3), (2, 1), (6, 0), (6, 1), (None, 0)}
    assert (got[(1, 3)].candidate, got[(1, 3)].before, got[(1, 3)].after) == ("abc123def456ghi", "set token = \"", "now please")
    assert (got[(2, 1)].candidate, got[(2, 1)].before) == ("Ab1Cd2Ef3Gh4Ij5==", "x key=")
    assert got[(None, 0)].before == "" and got[(6, 1)].before == "abc123def456ghi "


def test_each_occurrence_has_its_own_neighbours(spark):
    key = "ab12cd34ef56gh78"
    rows = [(1, f'see k="{key}";password="{key}" and then more', "s"), (2, ",".join([key] * 5), "s"), (3, f"a b {key}:{key}==", "s")]
    got = secrets.candidates(table(spark, rows)).collect()
    assert [(r.before, r.after) for r in got if r.id == 1] == [('see k="', '";password="'), (f'see k="{key}";password="', "and then")]
    assert [r.candidate for r in got if r.id == 2] == [key] * 5
    assert [(r.before, r.after) for r in got if r.id == 2] == [("", ","), (key + ",", ","), (key + ",", ","), (key + ",", ","), (key + ",", "")]
    assert [(r.candidate, r.before) for r in got if r.id == 3] == [(key, "a b "), (key + "==", f"a b {key}:")]


def test_a_word_of_many_runs_stays_linear(spark):
    runs = [f"run{i}abcdefghi" for i in range(30_000)]
    got = secrets.candidates(table(spark, [(1, "x " + ";".join(runs) + " y", "s")])).agg(
        F.count("*").alias("n"), F.sum(F.length("before") + F.length("after") + F.length("candidate")).alias("size")).first()
    assert got.n == 30_000 and got.size < 4 * sum(map(len, runs))


def test_values_of_long_names_equal_a_plain_search(spark):
    import re

    rng = random.Random(5)
    run = lambda n: "".join(rng.choice("abXY019+/_-") for _ in range(n))
    texts = ["AWS_SECRET_ACCESS_KEY=wJalr1K7MDENGbPxRfi", "GITHUB_TOKEN=ghp_1a2b3c4d5e6f", "NAME_OF_12_CHARS=abc123def456ghi==", "abc123def456ghi=x",
             "A_LONG_NAME_1=abc123def456ghi=", "PASSWORD_LONG==abc123def456ghi", "abc123def456ghi==="]
    texts += ["".join(run(rng.randint(1, 20)) + rng.choice(["=", "==", "===", ",", "=\"", ":"]) for _ in range(6)) for _ in range(300)]
    got = sorted((r.id, r.candidate) for r in secrets.candidates(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect())
    want = []
    for i, text in enumerate(texts):
        parts = re.split("([A-Za-z0-9+/_-]+)", text)
        for part, after, following in zip(parts[1::2], parts[2::2], [*parts[3::2], ""]):
            pad = after[:2] if after[:2] == "==" else after[:1] if after[:1] == "=" else ""
            if len(part) >= 12 and re.search("[0-9]", part) and re.search("[A-Za-z]", part):
                want.append((i, part + (pad if len(pad) < len(after) or not following else "")))
    assert got == sorted(want)
    assert (0, "wJalr1K7MDENGbPxRfi") in want and (1, "ghp_1a2b3c4d5e6f") in want


def test_dictionary_and_transitions_equal_a_plain_count(spark):
    import math
    import re
    from collections import Counter

    rng = random.Random(6)
    made = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(4_000)] + ["internationalisation"]
    texts = [" ".join(rng.choices(made, k=900) + ["zyxwv" * (i == 7), "x1y2", "Z"]) for i in range(30)] + [" ".join(made), None, ""]
    words = secrets.dictionary_of(table(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    want = Counter(w for t in texts for w in re.findall(r"\S+", (t or "").lower()) if re.fullmatch("[a-z]{2,}", w))
    assert {r.word: r["count"] for r in words.collect()} == want and want["zyxwv"] == 1 and len(want) > 2_000
    pairs = Counter()
    for w, n in want.items():
        for a, b in zip(w, w[1:]):
            pairs[a, b] += n
    line = sum(pairs["a", b] + 0.5 for b in " " + secrets.ALPHABET)
    at = lambda c: secrets.ALPHABET.index(c) + 1
    assert secrets._transitions(words)[at("a") * secrets.SIDE + at("b")] == pytest.approx(math.log((pairs["a", "b"] + 0.5) / line))
    findings = spark.createDataFrame([("zyxwv_internationalisation_qqqq_zyxwv_1",), ("QQQQQQQQQQQ1",)], "candidate string")
    got = secrets._covered(findings, words).collect()
    assert [(r.x_letters, r.x_longest) for r in got] == [(30, 20)]


def test_held_out_findings(sampled):
    findings = secrets.labelled(sampled)
    held = F.pmod("seed", F.lit(3)) == 0
    model = secrets.train(sampled, findings.where(~held).drop("seed"))
    judged = secrets.judge(findings.where(held).drop("seed"), model)
    right = judged.groupBy("label").agg(F.avg((F.col("secret").cast("double") == F.col("label")).cast("double")).alias("right"), F.count("*").alias("n")).collect()
    assert {r.label for r in right} == {0.0, 1.0} and all(r.right > 0.97 and r.n > 300 for r in right)


def test_false_positives_go_and_secrets_stay(spark, model):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"some words here token = \"{hexes(40)}\" and more", "s") for i in range(30)]
    rows += [(100 + i, f"the commit {hexes(40)} was merged", "s") for i in range(30)]
    rows += [(200 + i, f"call the_thing_handler{i} of src/the/and/of{i}/that then", "s") for i in range(30)]
    judged = secrets.judge(secrets.candidates(table(spark, rows)), model).collect()
    rate = lambda low: sum(r.secret for r in judged if low <= r.id < low + 100) / sum(low <= r.id < low + 100 for r in judged)
    assert rate(0) > 0.9 and rate(100) < 0.1 and rate(200) < 0.1


def test_planted_tokens_are_all_found(spark):
    import re

    folder = "/root/testdata/sf0.01"
    want = sorted((r.doc_id, t) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
                  for t in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text or ""))
    found = secrets.op6_secret_scan(spark, folder)
    got = sorted((r.doc_id, r.candidate) for r in found.where("secret").collect())
    assert [w for w in want if w not in got] == [] and want


def test_long_texts_repeats_clashing_columns_and_empty_tables(spark, model):
    long = "word " * 100_000 + "password=" + "a1B2" * 2_000 + " end"
    rows = [(1, long, "s"), (2, "key: abc123def456ghi", "s"), (2, "key: abc123def456ghi", "s")]
    got = secrets.find(table(spark, rows), model=model, path="path").collect()
    assert sorted((r.doc_id, len(r.candidate), r.path) for r in got) == [(1, 8_000, "p"), (2, 15, "p"), (2, 15, "p")]
    assert secrets.find(table(spark, [])).count() == 0
    assert secrets.find(table(spark, [(1, None, None), (2, "", "")])).count() == 0


def test_no_python_in_the_plan(spark, model):
    plan = secrets.judge(secrets.candidates(table(spark, [(1, "a", "s")])), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
