import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tillroll.llm import license

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def base(text):
    w = words(text)
    return sorted((i, i + len(p.split()), label) for p, label in license.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def scanned(text):
    return license._scanner().scan(np.frombuffer(text.encode(), np.uint8))


def test_automaton_gives_the_longest_run_everywhere():
    rng = random.Random(2)
    for _ in range(200):
        sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        a = license.Automaton(sequences)
        text = [rng.randint(0, 3) for _ in range(30)]
        state, run = 0, 0
        for i, w in enumerate(text):
            while state and w not in a.next[state]:
                state = a.link[state]
                run = a.length[state]
            if w in a.next[state]:
                state, run = a.next[state][w], run + 1
            longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n:i + 1]) in runs))
            assert run == longest
            if run:
                ends = {(k, j) for k, s in enumerate(sequences) for j in range(len(s)) if s[max(0, j + 1 - run):j + 1] == text[i + 1 - run:i + 1] and j + 1 >= run}
                assert a.last_words[state] == ends


def test_base_places_equal_a_plain_search():
    rng = random.Random(3)
    pool = ["under", "the", "mit", "license", "apache", "version", "2", "0", "cc", "by", "nc", "é", "of", "this", "MIT", "License"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) + rng.choice([" ", "-", ", ", "\n", "_", "\x00"]) for _ in range(rng.randint(0, 40)))
        n, places, _, score = scanned(text)
        assert n == len(words(text)) and sorted(places) == base(text)
        assert 0 <= score <= 1


def test_changed_notices_are_covered():
    _, places, spans, score = scanned("x This program is free software: you may redistribute it and modify it under the terms of the GNU General "
                                      "Public License as published by the Free Software Foundation, either version 3 of that License y")
    assert not places and "gpl-3" in {s[2] for s in spans} and 0.75 <= score < 1
    _, _, spans, score = scanned("Redistribution and use in source and binary forms with or without any modification are permitted")
    assert {s[2] for s in spans} <= {"bsd"} and 0 < score < 1
    assert scanned("the terms of the work are of the use of this and any of the public")[2] == []
    text = "word " * 50 + license.TEMPLATES[10][0] + " word" * 50
    _, _, spans, score = scanned(text)
    assert (50, 50 + len(words(license.TEMPLATES[10][0])), "mpl-2", 1.0) in spans and score == 1
    twice = license.TEMPLATES[10][0] + " word" * 50 + " " + license.TEMPLATES[10][0]
    assert [s[2] for s in scanned(twice)[2]].count("mpl-2") == 2


def test_query_on_all_documents(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = license.op5_license_scan(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({f[2] for f in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        if "GNU General Public License, version 3" in texts[r.doc_id]:
            assert "gpl-3" in r.labels.split(",")


def test_nulls_long_texts_repeats_and_empty_tables(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, "under the MIT license", "s"), (3, "cc-by-nc " * 20_000, "s"), (4, "a" * 300_000, "s"), (4, "a" * 300_000, "s")]
    got = {(r.doc_id, r.n_words): r for r in license.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[(1, 0)].score == 0 and got[(2, 0)].spans == []
    assert got[(None, 4)].score == 1
    assert sum(s.base for s in got[(3, 60_000)].spans) == 20_000
    assert license.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_templates_of_the_users_own(spark):
    clause = " ".join(f"clause{i % 17} of the house licence part{i}" for i in range(60))
    given = [(clause, "house-1"), ("", "none"), ("--", "none")]
    missing = " ".join(w for i, w in enumerate(clause.upper().split()) if i % 23)
    rows = [(1, "x y " + clause + " z", "s"), (2, missing, "s"), (3, "released under the MIT license", "s"), (4, license.TEMPLATES[10][0], "s")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in license.scan(docs, templates=given).collect()}
    assert [(s.first, s.end, s.label, s.share) for s in got[1].spans] == [(2, 2 + len(words(clause)), "house-1", 1.0)]
    assert {s.label for s in got[2].spans} == {"house-1"} and 0.75 <= got[2].score < 1
    assert [(s.label, s.base) for s in got[3].spans] == [("mit", True)] and got[4].spans == []
    assert "mpl-2" in {s.label for r in license.scan(docs).collect() if r.doc_id == 4 for s in r.spans}
