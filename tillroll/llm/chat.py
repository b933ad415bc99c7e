r"""Conversations as training text by columnar byte assembly.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length is spread over
tasks in order. A task takes the turns of an Arrow batch at once: numpy computes the length of every
segment (opening mark, role, line end, text, closing mark), cumulative offsets and the place of each byte,
and scatters headers and contents into one buffer, which becomes the Arrow column as it is.

A turn reads ``<turn>role\ntext</turn>\n``. A backslash goes before each ``\`` and ``<`` of roles and texts,
and a role's line ends are written ``\n``; so no text can hold a mark, and ``unescape`` gives it back exactly.
The loss mask covers the texts of the assistant.

Defined cases: null texts and roles are empty; rows are ordered by turn (null first), then role and text;
repeated rows are turns of their own; rows without a conversation id form one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.common import column, map_arrow, utf8

OPEN, LINE, CLOSE = b"<turn>", b"\n", b"</turn>\n"
BACK, LESS, END = 92, 60, 10
LEARNT = "assistant"
#: Bytes of turns that are assembled at a time.
BLOCK = 4 << 20
BLOCKS = "conv_id {kind}, place long, n_turns long, text string, loss array<struct<start:long,end:long>>"


def _escaped(body: np.ndarray, ends: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each byte goes when a backslash goes before each that needs one, and the new ends."""
    marked = (body == BACK) | (body == LESS)
    if lines:
        marked |= body == END
    more = np.concatenate(([0], np.cumsum(marked)))
    return np.arange(len(body)) + more[1:], ends + more[ends]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of turns, where each ends, and where its text begins and ends."""
    segments = []
    for values, lines in ((roles, True), (texts, False)):
        body, ends = utf8(values)
        to, new = _escaped(body, ends, lines)
        segments.append((body, ends, to, new, lines))
    (_, _, _, role_ends, _), (_, _, _, text_ends, _) = segments
    role_size, text_size = np.diff(role_ends), np.diff(text_ends)
    size = role_size + text_size + len(OPEN) + len(LINE) + len(CLOSE)
    stops = np.concatenate(([0], np.cumsum(size)))
    starts = stops[:-1]
    role_at = starts + len(OPEN)
    text_at = role_at + role_size + len(LINE)
    out = np.empty(int(stops[-1]), np.uint8)
    for mark, at in ((OPEN, starts), (LINE, role_at + role_size), (CLOSE, text_at + text_size)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for (body, ends, to, new, lines), at in zip(segments, (role_at, text_at)):
        place = to + np.repeat(at - new[:-1], np.diff(ends))
        special = (body == BACK) | (body == LESS)
        if lines:
            special |= body == END
        out[place[special] - 1] = BACK
        out[place] = np.where(body == END, ord("n"), body) if lines else body
    return out, stops, text_at, text_at + text_size


def _blocks(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = np.diff(utf8(batch.column("text"))[1])
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                ids = part.column("conv_id")
                out, stops, first, last = assemble(part.column("role"), part.column("text"))
                filled = [x.as_py() for x in ids]
                heads = [0] + [i for i in range(1, len(filled)) if filled[i] != filled[i - 1]]
                tails = [*heads[1:], len(filled)]
                # characters before each byte, to give the mask in code points
                points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
                learnt = np.array([x.as_py() == LEARNT for x in part.column("role")])
                loss = [[{"start": int(points[first[i]] - points[stops[h]]), "end": int(points[last[i]] - points[stops[h]])}
                         for i in range(h, t) if learnt[i]] for h, t in zip(heads, tails)]
                offsets = np.array([stops[h] for h in heads] + [stops[-1]], np.int32)
                texts = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(heads)), pa.array(place + np.arange(len(heads))), pa.array([t - h for h, t in zip(heads, tails)]),
                     texts, pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["conv_id", "place", "n_turns", "text", "loss"])
                place += len(heads)

    return run


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Blocks of formatted turns: conv_id, place, n_turns, text, loss (spans in code points of the block).

    A conversation is its blocks in the order of ``place``; short ones are a single block, mostly.
    """
    rows = turns.select(column(turns, conv).alias("conv_id"), column(turns, turn).alias("turn"),
                        F.coalesce(column(turns, role), F.lit("")).alias("role"),
                        F.coalesce(column(turns, text), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    kind = rows.schema["conv_id"].dataType
    return map_arrow(dealt.select("conv_id", "role", "text"), _blocks(kind), BLOCKS.format(kind=kind.simpleString()))


_UNIT = re.compile(r"<turn>((?:[^\\<\n]|\\.)*)\n((?:[^\\<]|\\.)*+)</turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def unescape(text: str, role: bool = False) -> str:
    if "\\" not in text:
        return text
    return _BACK.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def parse(block: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a block."""
    found, at = [], 0
    for m in _UNIT.finditer(block):
        if m.start() != at:
            break
        found.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    if at != len(block):
        raise ValueError(f"not a turn at {at}: {block[at:at + 40]!r}")
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One conversation after the other; of each only running digests are held."""
    none = object()
    now, n, chars, loss, turns, masked = none, 0, 0, 0, None, None
    held: list[tuple] = []

    def handed():
        columns = list(zip(*held))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("loss").to_pylist()):
            if now is none or conv != now:
                if now is not none:
                    held.append((now, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                now, n, chars, loss, turns, masked = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in spans:
                under = unescape(text[span["start"]:span["end"]])
                loss += len(under)
                masked.update(under.encode())
            chars += len(text)
        if len(held) >= 10_000:
            yield handed()
            held = []
    if now is not none:
        held.append((now, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
    if held:
        yield handed()


def read_back(blocks: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted blocks alone; ids may be of any type that sorts.

    A digest of turns in order passes through one task per conversation, block after block.
    """
    types = dict(blocks.dtypes)
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return map_arrow(dealt.select("conv_id", "text", "loss"), _digests,
                     f"conv_id {types['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return read_back(format_chat(turns.unionByName(probe)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length(role) + length(text) + length('<turn>') + 1 + length('</turn>') + 1
            + length(regexp_replace(text, '[^\\<]', '', 'g')) + length(regexp_replace(role, '[^\\<\n]', '', 'g')) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
