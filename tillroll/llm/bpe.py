"""BPE encoding with reuse of content-defined chunks, and decoding.

Texts are cut where a gear rolling hash says so; the same passage is cut into the same chunks wherever it
stands. Each distinct chunk that a task meets is encoded once, whatever the number of texts that share it, and so is each
distinct word of such chunks. The tokens of a chunk count from its first to its last white space only. What stands between the last white
space of one chunk and the first of the next is joined and encoded again; if there is none in a chunk, the join widens over it. So the
ends of every piece encoded are white space or an end of the text, where this kind of tokenizer never joins symbols, and the tokens
agree exactly with those of the whole text (tests compare them).

The dictionary lives in the task: it needs no shuffle of texts, and its size bounds memory, not results. For tokenizers whose
pre-tokenizer drops white space, such as ``word_bpe_49k.json``.

Defined cases: null counts as empty and gives no tokens; empty tables give no rows; repeated rows are
encoded like any other; other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.common import column, fresh, map_arrow, utf8
from tillroll.llm.gear import masked

WINDOW, BITS, LONGEST = 16, 7, 4096
#: Entries that a worker's dictionaries hold before longer words and all chunks are let go.
MOST_CHUNKS, MOST_WORDS = 100_000, 800_000
#: Words so short stay in a full dictionary, for they return most often.
SHORT = 8
#: Longer words are encoded each time.
WORD_BYTES = 64
#: Bytes of texts encoded at a time.
BLOCK = 4 << 20


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _last_letter(word: bytes) -> int:
    """Where stops and commas after a last ASCII letter begin, else 0: there the pre-tokenizer always splits."""
    bare = word.rstrip(b".,;:!?")
    return len(bare) if bare and len(bare) < len(word) and bare[-1:].isalpha() else 0


def _lowered(raw: bytes) -> bytes:
    """ASCII letters lower-cased, as the tokenizer would do, so that more words are shared.

    Not where that could make a difference: before combining marks, with which only some small letters compose,
    and where it could make a special token's string.
    """
    return raw if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.lower()


class Encoder:
    """Dictionaries of words and chunks of one worker."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        normalizer = json.loads(self.tokenizer.to_str()).get("normalizer") or {}
        lowers = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer]) if n)
        self.prepare = _lowered if lowers else bytes
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}

    def _learn(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """Tokens (int32 bytes) of words not met before; those too long to keep are returned."""
        long_ones: dict[bytes, bytes] = {}
        parted = {w: at for w in wanted if (at := _last_letter(w))}
        pieces = (wanted - parted.keys()).union(*[(w[:at], w[at:]) for w, at in parted.items()])
        new = [w for w in pieces if w not in self.words]
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            for word, one in zip(part, found):
                (self.words if len(word) <= WORD_BYTES else long_ones)[word] = array("i", one.ids).tobytes()
        for word, at in parted.items():
            both = [self.words[w] if w in self.words else long_ones[w] for w in (word[:at], word[at:])]
            (self.words if len(word) <= WORD_BYTES else long_ones)[word] = both[0] + both[1]
        return long_ones

    def encode(self, texts: list[np.ndarray]) -> list[bytes]:
        if len(self.words) > MOST_WORDS:
            self.words = {w: ids for w, ids in self.words.items() if len(w) <= SHORT}
            if len(self.words) > MOST_WORDS // 2:
                self.words = {}
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks = {}
        known, chunks = self.words, self.chunks
        plans: list[list] = []
        wanted: set[bytes] = set()
        made: dict[bytes, tuple] = {}
        for data in texts:
            raw, plan, carry, start = self.prepare(data.tobytes()), [], b"", 0
            for end in masked(np.frombuffer(raw, np.uint8), WINDOW, BITS, LONGEST).tolist():
                chunk = raw[start:end]
                start = end
                entry = chunks.get(chunk) or made.get(chunk)
                if entry is None:
                    inner = chunk.split()
                    # words cut by an end of the chunk belong to the join with its neighbour
                    head = inner.pop(0) if inner and not chunk[:1].isspace() else b""
                    spaced = len(head) < len(chunk)
                    tail = inner.pop() if spaced and inner and not chunk[-1:].isspace() else b""
                    entry = made[chunk] = (head, inner, tail, spaced)
                    wanted.update(w for w in inner if w not in known)
                if not entry[3]:
                    carry += chunk
                    continue
                if word := carry + entry[0]:
                    plan.append(word)
                    if word not in known:
                        wanted.add(word)
                plan.append((chunk,))
                carry = entry[2]
            if carry:
                plan.append(carry)
                if carry not in known:
                    wanted.add(carry)
            plans.append(plan)
        lengthy = self._learn(wanted)
        known = self.words
        for chunk, (head, inner, tail, spaced) in made.items():
            made[chunk] = (head, b"".join([known[w] if w in known else lengthy[w] for w in inner]), tail, spaced)
        found = []
        for plan in plans:
            parts = []
            for piece in plan:
                if type(piece) is tuple:
                    parts.append((made.get(piece[0]) or chunks[piece[0]])[1])
                else:
                    parts.append(known[piece] if piece in known else lengthy[piece])
            found.append(b"".join(parts))
        chunks.update(made)
        return found


_ENCODERS: dict[str, Encoder] = {}


def _encode(path: str, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            place = batch.schema.get_field_index(text)
            body, ends = utf8(batch.column(place))
            cut = np.flatnonzero(np.diff(ends[1:] // BLOCK)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)]):
                if a == b:
                    continue
                ids = encoder.encode([body[ends[i]:ends[i + 1]] for i in range(a, b)])
                values = b"".join(ids)
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(
                    pa.int32(), len(values) // 4, [None, pa.py_buffer(values)]))
                part = batch.slice(a, b - a)
                keep = [i for i in range(batch.num_columns) if i != place]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], lists],
                                                 [*[batch.schema.names[i] for i in keep], out])

    return run


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all but the text) and the token ids of each row's text."""
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    (body,) = fresh(docs, "bpe_text")
    narrow = docs.select(*[column(docs, c) for c in carry], F.coalesce(column(docs, text), F.lit("")).alias(body))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"`{ids}` array<int>"])
    return map_arrow(narrow, _encode(tokenizer or default_tokenizer(), body, ids), schema)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[str], list[str]]:
    tokenizer = _tokenizer(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return [tokenizer.id_to_token(i) for i in range(size)], [str(i) for i in range(size)]


def decode_ids(ids: list[int], path: str) -> str:
    """As the library's decode(ids, skip_special_tokens=False) for a tokenizer without decoder: tokens joined by one space."""
    return " ".join(map(_vocabulary(path)[0].__getitem__, ids))


def _decode(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, decimals = _vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            held, size, first = [], 0, 0
            for i in range(len(batch)):
                ids = values[ends[i]:ends[i + 1]].tolist()
                text = " ".join(map(tokens.__getitem__, ids))
                if digests:
                    held.append((len(ids), hashlib.sha256(" ".join(map(decimals.__getitem__, ids)).encode()).hexdigest(),
                                 hashlib.sha256(text.encode()).hexdigest()))
                else:
                    held.append((text,))
                    size += len(text)
                if size >= BLOCK or i == len(batch) - 1:
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["text"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), *map(pa.array, zip(*held))], ["id", *names])
                    held, size, first = [], 0, i + 1

    return run


def decode(encoded: DataFrame, identity: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Id and decoded text of each row."""
    narrow = encoded.select(column(encoded, identity).alias("id"), F.coalesce(column(encoded, ids), F.array().cast("array<int>")).alias("ids"))
    kind = narrow.schema["id"].dataType.simpleString()
    found = map_arrow(narrow, _decode(tokenizer or default_tokenizer(), False), f"id {kind}, text string")
    return found.withColumnRenamed("id", identity)


def digests(encoded: DataFrame, identity: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Id, number of tokens and digests of the ids and of the decoded text of each row."""
    narrow = encoded.select(column(encoded, identity).alias("id"), F.coalesce(column(encoded, ids), F.array().cast("array<int>")).alias("ids"))
    kind = narrow.schema["id"].dataType.simpleString()
    found = map_arrow(narrow, _decode(tokenizer or default_tokenizer(), True),
                              f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", identity)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode(docs, carry=["doc_id"]))
