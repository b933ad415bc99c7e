import hashlib
import random

import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from tillroll.llm import bpe, gear

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                     T.StructField("bpe_text", T.StringType())])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def samples():
    rng = random.Random(5)
    letters = "abcdeé ßÅǺ가ﬁ'stлд中文字123!#<|>\n\t\r\x0b\x0c  \u0085\x1c\x00 İΣς"
    made = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 400, 3000]))) for _ in range(150)]
    shared = "The same passage stands in many documents, and it's not moved far. " * 9
    made += [shared, "x" + shared, shared + shared, "don't we'll I'VE <|endoftext|> a<|startoftext|>b " * 5]
    made += ["", " ", "\n\n", None, "a" * 9000, "0123456789" * 3000, "é" * 5000, "Yes, NO! it's. I'LL, A.B., x:y; ok?! 's. don't! é, 9. H\u0331 T\u0308, İ I\u0307. K\u0338 <|ENDOFTEXT|>. <|endoftext|>, E\u0301!", "Yes, NO! It'S. A.B., ok?! É, 9. İ. ǰJ,", "no spaces" + "ab12" * 4000 + " end", "́ ́x"]
    return made


def test_equals_the_library_on_whole_texts(spark, library):
    texts = samples()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r.token_ids for r in bpe.encode(docs, ids="token_ids", carry=["doc_id"]).collect()}
    for i, text in enumerate(texts):
        assert got[i] == library.encode(text or "", add_special_tokens=False).ids, repr(text)[:80]


def test_small_chunks_and_forgetful_dictionaries(monkeypatch, library):
    import numpy as np

    texts = [t or "" for t in samples()]
    monkeypatch.setattr(bpe, "BITS", 3)
    monkeypatch.setattr(bpe, "LONGEST", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 10)
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 10)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    for at in range(0, len(texts), 20):
        part = texts[at:at + 20]
        for text, ids in zip(part, encoder.encode([np.frombuffer(t.encode(), np.uint8) for t in part])):
            assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_and_digests(spark, library):
    texts = samples()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    encoded = bpe.encode(docs.drop("ids"), carry=["doc_id"])
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    digests = {r.doc_id: r for r in bpe.digests(encoded).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        whole = library.decode(ids, skip_special_tokens=False)
        assert decoded[i] == whole
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_query_on_all_documents(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = bpe.op3_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], DOCS)
    found = bpe.encode(docs, ids="tokens")
    assert found.columns == ["doc_id", "ids", "bpe_text", "tokens"] and found.count() == 0
    assert bpe.digests(found.withColumn("tokens", F.lit(None).cast("array<int>")), ids="tokens").count() == 0


def test_cuts_follow_the_content():
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    for cut in (lambda x: gear.peaks(x, 16, 20, 4096), lambda x: gear.masked(x, 16, 6, 4096)):
        plain, moved = set(cut(data).tolist()), set((cut(np.concatenate([data[:1000], data[:7], data[1000:]])) - 7).tolist())
        assert plain - moved <= {x for x in plain if x < 1100}
        assert max(plain) == 5000
    assert np.diff(gear.peaks(np.full(10_000, 97, np.uint8), 16, 20, 4096)).max() == 4096
    slow = [sum(int(gear.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % 2**32 for i in range(300)]
    assert gear.rolling(data[:300], 16).tolist() == slow
