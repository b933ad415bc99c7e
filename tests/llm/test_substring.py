import random
import re

from pyspark.sql import functions as F, types as T

from tillroll.llm import substring

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()),
                     T.StructField("twin", T.StringType())])


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuéß") for _ in range(rng.randint(2, 9))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "t") for i, t in rows], DOCS)


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(1)
    shared = [prose(rng, 60) for _ in range(30)]
    rows = []
    for i, p in enumerate(shared):
        rows.append((3 * i, prose(rng, 200) + " " + p + " " + prose(rng, 40)))
        rows.append((3 * i + 1, prose(rng, rng.randint(0, 9)) + "\n" + p + "\n" + prose(rng, 100)))
        rows.append((3 * i + 2, prose(rng, 150)))  # clean
    texts = dict(rows)
    found = substring.passages(table(spark, rows)).collect()
    assert {r.doc_id for r in found} == {3 * i + 1 for i in range(30)}
    for r in found:
        assert r.first_id == r.doc_id - 1
        span = texts[r.doc_id][r.start:r.end]
        assert span in texts[r.first_id] and len(span.split()) >= substring.LEAST_WORDS


def test_each_span_is_a_repeat_of_an_earlier_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = substring.op2_substring_dedup(spark, small).collect()
    assert found
    for r in found:
        span = re.sub(r"\s+", " ", texts[r.doc_id][r.start:r.end])
        assert r.n_words == len(re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", texts[r.doc_id][:r.end])) - len(
            re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", texts[r.doc_id][:r.start]))
        assert len(span) > 40


def test_remove_leaves_the_first_occurrence(spark):
    rng = random.Random(2)
    p, tail = prose(rng, 80), prose(rng, 30)
    rows = [(5, "Alpha " + p), (6, p + " " + tail), (7, p), (None, p), (8, None), (9, ""), (9, "")]
    got = substring.remove(table(spark, rows)).collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "text", "start", "twin"]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[None] == [p]  # a null id comes first
    assert by[9] == ["", ""] and by[8] == [None]
    assert len(by[7][0]) < 60 and by[6][0].endswith(tail) and len(by[6][0]) < len(tail) + 60 and len(by[5][0]) < 60


def test_repeated_rows_long_texts_and_empty_tables(spark):
    rng = random.Random(3)
    p = prose(rng, 100)
    assert substring.passages(table(spark, [(1, p), (1, p)])).count() == 0
    twice = substring.passages(table(spark, [(1, p + "\n" + prose(rng, 20) + "\n" + p)])).collect()
    assert len(twice) == 1 and twice[0].start > len(p) and twice[0].first_id == 1
    assert substring.passages(table(spark, [])).count() == 0
    assert substring.remove(table(spark, [])).count() == 0
    long = prose(rng, 60_000)
    found = substring.passages(table(spark, [(1, long), (2, "x" + long)])).collect()
    assert [r.doc_id for r in found] == [2] and found[0].n_words > 59_900
    assert substring.passages(table(spark, [(1, "a" * 50_000), (2, "b" * 50_000)])).count() == 0
    many = table(spark, [(i, p) for i in range(300)])
    assert substring.passages(many).agg(F.count("*"), F.max("first_id")).first() == (299, 0)


def naive(rows, least):
    """Places of texts inside runs of ``least`` words that an earlier text (or an earlier place) has, as sets of word numbers."""
    known, found = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        hit = set()
        for k in range(len(w) - least + 1):
            key = tuple(w[k:k + least])
            if key in known:
                hit.update(range(k, k + least))
            known.add(key)
        found[i] = hit
    return found


def test_short_repeats_are_found_and_extended_to_their_ends(spark):
    rng = random.Random(4)
    rows, planted = [], {}
    for n in (25, 28, 32, 40, 51):
        for _ in range(60):
            p = " ".join("".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))
            a, b = prose(rng, rng.randint(30, 60)), prose(rng, rng.randint(0, 40))
            rows.append((len(rows), a + " " + p + "\n" + prose(rng, 30)))
            planted[len(rows)] = (len(b) + 1, len(b) + 1 + len(p), n)
            rows.append((len(rows), b + " " + p + " " + prose(rng, rng.randint(0, 30))))
    by = {}
    for r in substring.passages(table(spark, rows)).collect():
        by.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words))
    assert set(by) <= set(planted)
    expected = naive(rows, 25)
    assert {i for i, hit in expected.items() if hit} == set(planted)
    exact = [by.get(i) == [p] for i, p in planted.items()]
    assert sum(i in by for i in planted) >= 0.99 * len(planted) and sum(exact) >= 0.99 * len(planted)
    left = {r.doc_id: r.text for r in substring.remove(table(spark, rows)).collect()}
    texts = dict(rows)
    for i, (start, end, n) in planted.items():
        if by.get(i) == [(start, end, n)]:
            assert left[i] == texts[i][:start] + texts[i][end:]


def test_no_text_is_lost_where_passages_meet_or_repeat_themselves(spark):
    rng = random.Random(6)
    unit = prose(rng, 9)
    rows = [(1, " ".join([unit] * 30)), (2, "x " + " ".join([unit] * 7)), (3, prose(rng, 40))]
    a, b = prose(rng, 26), prose(rng, 27)
    rows += [(4, a + " q"), (5, "r " + b), (6, a + " " + b), (7, a + " z " + b + " " + a)]
    left = {r.doc_id: r.text for r in substring.remove(table(spark, rows)).collect()}
    assert unit in left[1] and a in left[4] and b in left[5] and left[3] == rows[2][1]
    assert left[6].strip() == "" and left[7].split() == ["z"]
    for r in substring.passages(table(spark, rows)).collect():
        assert r.n_words == len(dict(rows)[r.doc_id][:r.end].split()) - len(dict(rows)[r.doc_id][:r.start].split())


def test_chunks_are_shuffled_once(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 30)) for i in range(20)]
    plan = substring.repeats(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
