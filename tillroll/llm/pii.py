"""Personal data by fixed patterns and a skip-chain conditional random field.

Four patterns give the base spans. Around them a conditional random field labels the tokens of a document that hold a digit or an at
sign (any other token has only one possible label, O). Its potentials are: features of a token and its neighbours; pairs of
labels of adjacent tokens; pairs of labels of distant tokens that are the same or have the same digits, each joined with its next occurrence.
Tokens in base spans have their label given. Loopy sum-product message passing, all documents of a batch at once and until no message
changes by more than ``TOLERANCE``, carries it to the repeated and neighbouring tokens however far; runs of tokens with a marginal of at least ``SURE`` for one label become further spans.

The field is trained on at most ``SAMPLE`` documents, those with the least hash of their id among the documents that hold a
digit or an at sign: base spans are the labels, and each is also shown in other writing (phone number without its plus sign,
address with "(at)"), which base patterns miss; ``_ordinary`` numbers are examples of O. Node weights are fitted by multinomial logistic
regression, pair potentials by smoothed counts of label pairs. Patterns, features and message passing go over all documents and whole texts.

Defined cases: null counts as empty, without spans; matches that fail their check (parts over 255, Luhn, digits) are dropped and not
retried; every scan is linear in the text; repeated rows are labelled alike; an empty table gives no rows; with no
labelled token in the sample no spans are added; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.common import column, map_arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
SAMPLE = 4_000
SURE = 0.9
TOLERANCE = 1e-7
#: Messages that still swing after so many sweeps change by ever smaller shares, so that they come to rest on any graph.
PATIENCE, SETTLING = 200, 0.9
#: Rounds of all messages at once, which most texts need only; then sweeps along those that still change.
AT_ONCE = 20
#: Characters of texts whose tokens are labelled together.
BLOCK = 4_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where digits begin: what follows them is the same from each of them.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs, so that long runs of letters cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# Tokens and their features

TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*|[^\x20\x09-\x0D]*[(\[][aA][tT][)\]][^\x20\x09-\x0D]*")
#: Only characters from here to the end of a text's run of non-space can belong to a candidate token.
MARK = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")
BEFORE = re.compile(r"[\x20\x09-\x0D]")
CUES = ("mail", "phone", "tel", "call", "fax", "card", "visa", "pay", "ip", "host", "server")
SHAPES = [re.compile(p) for p in (
    r"[0-9]+", r"\([0-9]{2,4}\)", r"[0-9]{3}-[0-9]{4}", r"\+[0-9]{1,3}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"[0-9]{13,19}",
    r"[0-9]{3}-[0-9]{3}-[0-9]{4}", r"[0-9]{4}(?:-[0-9]{4}){3}", r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", r"[0-9]+[.,][0-9]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"[A-Za-z0-9._%+-]+[(\[]at[)\]][A-Za-z0-9.-]+", r"[0-9a-f]{16,}", r"[0-9]{4}")]
N_SHAPES = len(SHAPES)
#: Own shapes, shapes before and after, cues before, length, digits, letters, checks.
N_FEATURES = 3 * N_SHAPES + len(CUES) + 8 + 8 + 6


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit, an at sign or a bracketed "at", in order; linear in the text."""
    found, at = [], 0
    while m := MARK.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        end = BEFORE.search(text, m.end())
        stop = end.start() if end else len(text)
        found.append((start, stop))
        at = stop
    return found


def _bare(token: str) -> str:
    return token.strip("\"'!?,;:#$%&*|<>").rstrip(".")


def _level(n: int) -> int:
    return min(7, int(np.log2(n + 1)))


def features(text: str, spans: list[tuple[int, int]]) -> tuple[list[list[int]], list[str]]:
    """Indices of the features that hold for each candidate, and its bare form."""
    bare = [_bare(text[a:b]) for a, b in spans]
    shapes = [[k for k, s in enumerate(SHAPES) if s.fullmatch(x)] for x in bare]
    out = []
    for i, ((a, b), x) in enumerate(zip(spans, bare)):
        own = list(shapes[i])
        if i and not text[spans[i - 1][1]:a].strip() and a - spans[i - 1][1] <= 3:
            own += [N_SHAPES + k for k in shapes[i - 1]]
        if i + 1 < len(spans) and not text[b:spans[i + 1][0]].strip() and spans[i + 1][0] - b <= 3:
            own += [2 * N_SHAPES + k for k in shapes[i + 1]]
        at = 3 * N_SHAPES
        context = text[max(0, a - 24):a].lower()
        own += [at + k for k, cue in enumerate(CUES) if cue in context]
        at += len(CUES)
        digits = _digits(x)
        own.append(at + _level(len(x)))
        own.append(at + 8 + (0 if any(c.isalpha() for c in x) else _level(len(digits))))  # in words, how many digits says little
        at += 16
        own += [at + k for k, holds in enumerate((
            any(c.isalpha() for c in x), "@" in x, 13 <= len(digits) <= 19 and luhn(digits), x.count(".") == 3 and all(
                p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in x.split(".")), "." in x[1:-1], True)) if holds]
        out.append(own)
    return out, bare


def _labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """Label of each candidate: that of the base span that covers part of it, else O."""
    marked, found, at = sorted((a, b, k) for k, a, b in base), [], 0
    for a, b in spans:
        while at < len(marked) and marked[at][1] <= a:
            at += 1
        found.append(marked[at][2] + 1 if at < len(marked) and marked[at][0] < b else 0)
    return found


def _edges(text: str, spans: list[tuple[int, int]], bare: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Adjacent candidates, and each candidate with the next that is the same or has the same digits."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 3 and not text[spans[i][1]:spans[i + 1][0]].strip()]
    skip, last, near = [], {}, set(chain)
    for i, x in enumerate(bare):
        digits = _digits(x)
        for key in {x.lower(), digits if len(digits) >= 6 else ""}:
            if len(key) < 4:
                continue
            if key in last and (last[key], i) not in near:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


class Field:
    """Weights: node (features x labels), chain and skip (labels x labels), as logarithms."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip


def fit(samples: list[tuple[list[int], int]], chain: np.ndarray, skip: np.ndarray, steps: int = 1_000, rate: float = 1.0, decay: float = 1e-4) -> Field:
    """Multinomial logistic regression of the nodes, log ratios of label pairs to independence for the edges."""
    k = len(LABELS)
    node = np.zeros((N_FEATURES, k))
    if samples:
        x = np.zeros((len(samples), N_FEATURES), np.float32)
        for i, (own, _) in enumerate(samples):
            x[i, own] = 1
        y = np.eye(k)[[label for _, label in samples]]
        weight = 1 / np.sqrt(np.maximum(y.sum(0), 1))[y.argmax(1)]
        weight /= weight.sum()
        momentum = np.zeros_like(node)
        for _ in range(steps):
            score = x @ node
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            gradient = x.T @ ((y - p) * weight[:, None]) - decay * node
            momentum = 0.9 * momentum + gradient
            node += rate * momentum

    def potential(counts: np.ndarray) -> np.ndarray:
        counts = counts + counts.T
        own = counts.sum(1) + 1
        own = own / own.sum()
        joint = counts + 20 * np.outer(own, own)  # as if twenty pairs of independent labels had been seen too
        return np.clip(np.log(joint / joint.sum() / np.outer(own, own)), -3, 3)

    return Field(node, potential(chain), potential(skip))


def _sweep(edges: np.ndarray, n: int) -> list[np.ndarray]:
    """Both directions of the edges (numbers below and from ``len(edges)`` on) in groups, in the order of one sweep: messages to later
    nodes from the first level on, then those back from the last. A node's level is the longest path to it from earlier nodes."""
    level = [0] * n
    for b, a in sorted(zip(edges.max(1).tolist(), edges.min(1).tolist())):
        level[b] = max(level[b], level[a] + 1)
    of = np.array(level)[np.concatenate([edges[:, 0], edges[:, 1]])]
    ahead = np.concatenate([edges[:, 0] < edges[:, 1], edges[:, 0] > edges[:, 1]])
    turn = np.where(ahead, of, 2 * n - of)
    order = np.argsort(turn, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(turn[order])) + 1)


def marginals(node: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product: node (n x k) and edge potentials (e x k x k) as logarithms; beliefs of all nodes.

    After some rounds of all messages at once, sweeps forwards and backwards carry a message along a whole chain; they go on, only
    where inputs have changed, until no message changes (or for ``rounds``).
    """
    n, k = node.shape
    if len(edges):
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), k))
        total = node.copy()
        changed, computed = np.ones(n, np.int64), np.zeros(len(source), np.int64)  # when
        groups, clock, sweeps, moving = [np.arange(len(source))], 1, 0, True
        while moving and (rounds is None or sweeps < rounds):
            if sweeps == AT_ONCE:
                groups = _sweep(edges, n)
            moving, pace = False, SETTLING ** max(sweeps - PATIENCE, 0)
            for group in groups:
                active = group[changed[source[group]] > computed[group]]
                if not len(active):
                    continue
                out = total[source[active]] - messages[back[active]]
                wide = out[:, :, None] + table[active]
                top = wide.max(1, keepdims=True)
                new = np.log(np.exp(wide - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                step = pace * (new - messages[active])
                computed[active] = clock
                moved = np.abs(step).max(1) > TOLERANCE
                if moved.any():
                    active, step, moving = active[moved], step[moved], True
                    if pace < 1:
                        computed[active] = 0
                    messages[active] += step
                    np.add.at(total, target[active], step)
                    clock += 1
                    changed[target[active]] = clock
            sweeps += 1
        node = node.copy()
        np.add.at(node, target, messages)
    belief = np.exp(node - node.max(1, keepdims=True)) if n else node
    return belief / belief.sum(1, keepdims=True) if n else belief


GIVEN = 20.0


def label_batch(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base and further spans of each text."""
    docs, rows, given, edges, kinds = [], [], [], [], []
    for text in texts:
        base = base_spans(text)
        spans = candidates(text)
        own, bare = features(text, spans)
        first = len(rows)
        chain, skip = _edges(text, spans, bare)
        rows += own
        given += _labels(spans, base)
        edges += [(first + a, first + b) for a, b in chain + skip]
        kinds += [0] * len(chain) + [1] * len(skip)
        docs.append((text, base, spans, first))
    node = np.zeros((len(rows), len(LABELS)))
    if rows:
        lengths = np.array([len(r) for r in rows])
        flat = field.node[np.concatenate([np.array(r) for r in rows])]
        node = np.add.reduceat(flat, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
        marked = np.array(given)
        where = np.flatnonzero(marked)
        node[where] -= GIVEN
        node[where, marked[where]] += 2 * GIVEN
    tables = np.stack([field.chain, field.skip])
    belief = marginals(node, np.array(edges, np.int64).reshape(-1, 2), tables[np.array(kinds, np.int64)])
    found = []
    for text, base, spans, first in docs:
        extra: list[tuple[int, int, int]] = []
        before = -2
        for i, (a, b) in enumerate(spans):
            p = belief[first + i]
            label = int(p.argmax())
            if label and p[label] >= SURE and not given[first + i]:
                token = text[a:b]
                a, b = a + len(token) - len(token.lstrip("\"'!?,;:#$%&*|<>")), b - len(token) + len(token.rstrip("\"'!?,;:#$%&*|<>."))
                if extra and before == i - 1 and extra[-1][0] == label - 1 and a - extra[-1][2] <= 3:
                    extra[-1] = (label - 1, extra[-1][1], b)
                else:
                    extra.append((label - 1, a, b))
                before = i
        found.append((base, extra))
    return found


def _variants(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Windows of text with a base span in other writing: text, kind, start, end."""
    for kind, a, b in base:
        said = text[a:b]
        if kind == 3 and " " in said:
            said = said.partition(" ")[2]
        elif kind == 0:
            said = said.replace("@", "(at)")
        else:
            continue
        left = text[max(0, a - 80):a]
        yield left + said + text[b:b + 80], kind, len(left), len(left) + len(said)


def _ordinary(n: int = 400) -> Iterator[str]:
    """Texts with numbers that are nobody's: dates, times, versions, amounts, years, quantities."""
    rng = random.Random(17)
    r = rng.randint
    for _ in range(n):
        yield rng.choice((
            f"in {r(1800, 2100)} of", f"at {r(0, 23)}:{r(10, 59)} on", f"on {r(1900, 2100)}-{r(10, 12)}-{r(10, 28)} the",
            f"{r(1, 12)}/{r(1, 28)}/{r(1990, 2030)}", f"version {r(0, 20)}.{r(0, 30)}.{r(0, 9)} of", f"v{r(0, 9)}.{r(0, 9)}", f"some {r(0, 99)}.{r(0, 99)} of",
            f"{r(1, 999)},{r(100, 999)} of", f"the {r(0, 9999)} and", f"{r(1, 9)}th", f"{r(0, 100)}%", f"no. {r(1, 99999)}",
            f"pages {r(1, 99)}-{r(100, 300)}", f"part{r(1, 9)} b{r(1, 99)}", f"{r(256, 999)}.{r(0, 999)}.{r(0, 999)}.{r(0, 999)}",
            f"{r(10**12, 10**19 - 1)}0 items", f"${r(1, 999)}.{r(10, 99)}", f"{r(1, 12)} {r(1, 31)} {r(1, 99)}", f"({r(1, 9)}) see"))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the candidates of sampled texts, and counts of label pairs (features -1 and -2)."""
    for batch in batches:
        own, labels = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            shown = [(text, base)] + [(t, [(k, a, b)]) for t, k, a, b in _variants(text, base)]
            for said, spans_of in shown:
                spans = candidates(said)
                rows, bare = features(said, spans)
                marks = _labels(spans, spans_of)
                if said is not text:  # of a window, only the span in other writing counts
                    keep = [i for i, m in enumerate(marks) if m]
                    rows, marks_kept = [rows[i] for i in keep], [marks[i] for i in keep]
                    own += rows
                    labels += marks_kept
                else:
                    own += rows
                    labels += marks
                for code, pairs in zip((-1, -2), _edges(said, spans, bare)):
                    own += [[code, marks[a], marks[b]] for a, b in pairs if said is text or (marks[a] and marks[b])]
                    labels += [0 for a, b in pairs if said is text or (marks[a] and marks[b])]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(labels, pa.int32())], ["own", "label"])


def train(docs: DataFrame, identity: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """The field fitted on at most ``sample`` documents; equal examples are counted, not sent one by one."""
    rows = docs.select(F.xxhash64(column(docs, identity)).alias("h"), column(docs, text).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return fit([], np.zeros((5, 5)), np.zeros((5, 5)))
    ordinary = [(text, candidates(text)) for text in _ordinary()]
    # one more bound, for ids that are null or repeated and so share a hash
    chosen = rows.where(F.col("h") <= last).select("text").limit(2 * sample)
    counted = map_arrow(chosen, _examples, "own array<int>, label int").groupBy("own", "label").count()
    samples = [(own, label) for text, spans in ordinary for own, label in zip(features(text, spans)[0], _labels(spans, base_spans(text)))]
    tables = (np.zeros((5, 5)), np.zeros((5, 5)))
    for r in counted.orderBy("label", "own").toLocalIterator():
        if r.own[0] < 0:
            tables[-r.own[0] - 1][r.own[1], r.own[2]] += r["count"]
        else:
            samples += [(list(r.own), r.label)] * min(r["count"], 50)
    return fit(samples, *tables)


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts, size, first = [], 0, 0
            column_ = batch.column("text")
            for i in range(len(batch)):
                texts.append(column_[i].as_py())
                size += len(texts[-1])
                if size >= BLOCK or i == len(batch) - 1:
                    spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": of_base} for of_base, group in ((True, base), (False, extra))
                              for k, a, b in group] for base, extra in label_batch(texts, field)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, i + 1 - first), pa.array(spans, kind)], ["id", "spans"])
                    texts, size, first = [], 0, i + 1

    return run


def find(docs: DataFrame, identity: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Id and spans (kind, start, end, base) of each row; start and end in code points, end exclusive."""
    field = train(docs, identity, text) if field is None else field
    rows = docs.select(column(docs, identity).alias("id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = map_arrow(rows, _find(field), f"id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")
    return found.withColumnRenamed("id", identity)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(place, s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
