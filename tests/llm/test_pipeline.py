import random

import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tillroll.llm import bpe, mixing, near, quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("copies", T.StringType())])


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def folder_with(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def staged(spark, folder, tmp_path):
    """Rows after each stage, written and read as the driver does."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for number, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(str(tmp_path / f"out{number}"))
        docs = spark.read.parquet(str(tmp_path / f"out{number}"))
        out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows, clean = [], []
    for i in range(120):
        text = prose(rng, rng.randint(40, 200))
        rows.append((i, text, "en", f"s{i % 3}", len(text), "a", "b", "c"))
        clean.append(i)
    for k, i in enumerate(range(0, 30)):  # copies, in other case
        rows.append((1000 + k, rows[i][1].upper() if k % 2 else rows[i][1], "en", "s0", 1, "a", "b", "c"))
    for k, i in enumerate(range(40, 60)):  # one word changed in the middle of a long text
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((2000 + k, " ".join(w), "en", "s1", 1, "a", "b", "c"))
    rows += [(3000, None, "en", "s0", 0, "a", "b", "c"), (3001, "", None, None, 0, "a", "b", "c"), (3002, "### " * 60, "en", "s0", 0, "a", "b", "c"),
             (None, prose(rng, 70), None, None, None, None, None, None)]
    out = staged(spark, folder_with(spark, tmp_path, rows), tmp_path)
    names = [f.name for f in DOCS]
    assert all(df.columns == names for df in out[:4])
    texts = {r[0]: r[1] for r in rows}

    kept = {r.doc_id for r in out[0].collect()}
    assert kept == set(texts) - {3000, 3001, 3002}

    groups = {}
    for r in out[0].collect():
        groups.setdefault(r.text.lower(), []).append(r.doc_id)
    once = {max(g, key=lambda x: (x is not None, x)) for g in groups.values()}
    assert {r.doc_id for r in out[1].collect()} == once and out[1].count() == len(once)

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    ids = [r.doc_id for r in out[1].collect()]
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    parts = {}
    for i in ids:
        parts.setdefault(find(i), []).append(i)
    stay = {min(p, key=lambda x: (x is None, x if x is not None else 0)) for p in parts.values()}
    assert {r.doc_id for r in out[2].collect()} == stay and len(stay) < len(ids)

    taken = {(r.doc_id): r.copies for r in mixing.decide(out[2]).collect()}
    assert {r.doc_id: r["count"] for r in out[3].groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    assert max(taken.values()) == 2

    library = Tokenizer.from_file(bpe.default_tokenizer())
    last = out[4].collect()
    assert len(last) == out[3].count()
    for r in last:
        assert r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_run_equals_its_stages_on_documents(spark, small, tmp_path):
    got = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("t")).collect()
    again = staged(spark, small, tmp_path)[-1].groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_tokens").alias("t")).collect()
    assert sorted(got) == sorted(again) and len(got) > 20


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_with(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("module", [quality, near])
def test_columns_pass_through(spark, module):
    rng = random.Random(1)
    rows = [(i, prose(rng, 50), "en", "s", 1, "n", "r", "c") for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    found = quality.keep_good(docs) if module is quality else near.deduplicate(docs)
    assert sorted(found.collect()) == sorted(docs.collect())
