import hashlib
import random

import pytest
from pyspark.sql import types as T

from tillroll.llm import chat

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("place", T.StringType()), T.StructField("loss", T.StringType())])


def sample():
    rng = random.Random(3)
    pieces = ["<turn>", "</turn>", "\\", "\n", "### Assistant:", "é", "日本", "😀", "user", "<", "\\n", "\\<turn>", " ", "x" * 50, "</turn>\n<turn>assistant\n"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))])
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a\nb<\\", "", None]), text))
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "id"), (5, None, "user", "no turn"), (6, 1, "assistant", "tie"), (6, 1, "assistant", "tie"),
             (70, 0, "assistant", "y<\\" * 300_000)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda v: v[0])
        out[c] = [(r, x) for _, r, x in turns]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "l") for r in rows], TURNS)


def test_blocks_read_back_exactly(spark):
    rows = sample()
    blocks = {}
    for b in sorted(chat.format_chat(frame(spark, rows).repartition(5)).collect(), key=lambda b: b.place):
        turns, loss = blocks.setdefault(b.conv_id, ([], []))
        parsed = chat.parse(b.text)
        assert len(parsed) == b.n_turns
        turns += parsed
        loss += [chat.unescape(b.text[s.start:s.end]) for s in b.loss]
    want = plain(rows)
    assert set(blocks) == set(want)
    for c, turns in want.items():
        assert sorted(blocks[c][0]) == sorted(turns)
        assert sorted(blocks[c][1]) == sorted(x for r, x in turns if r == "assistant")
        if c not in (6,):
            assert [x for _, x in blocks[c][0]] == [x for _, x in turns]


def test_digests(spark):
    rows = [r for r in sample() if r[0] != 6]
    want = plain(rows)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(frame(spark, rows))).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_a_conversation_longer_than_a_batch_and_empty_tables(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t} " + "z" * 400) for t in range(30_000)]
    turns = plain(rows)[1]
    got = chat.read_back(chat.format_chat(frame(spark, rows).repartition(6))).collect()
    assert len(got) == 1 and got[0].n_turns == 30_000
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    assert chat.format_chat(frame(spark, [])).count() == 0
    assert chat.read_back(chat.format_chat(frame(spark, []))).count() == 0


def test_ids_may_be_strings(spark):
    rows = [r for r in sample() if r[0] != 6]
    turns = frame(spark, rows)
    want = {None if r.conv_id is None else str(r.conv_id): r[1:] for r in chat.read_back(chat.format_chat(turns)).collect()}
    named = turns.withColumn("conv_id", turns["conv_id"].cast("string"))
    assert {r.conv_id: r[1:] for r in chat.read_back(chat.format_chat(named)).collect()} == want


def test_escapes():
    for text in ("", "\\", "<", "\\<", "<turn>", "</turn>", "\\n", "\n", "a\\\\<b"):
        assert chat.unescape(text.replace("\\", "\\\\").replace("<", "\\<")) == text
    with pytest.raises(ValueError):
        chat.parse("<turn>user\nno end")
