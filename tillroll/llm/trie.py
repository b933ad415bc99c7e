"""Prefix trie of conversations by hashes of blocks of turns.

A turn is the digest of its role and text. The first d turns of a conversation are known by two sums modulo primes, digest times a power
for each place, so that the sums of pieces add up and a conversation of any length is spread over tasks.

1. Conversations are cut into blocks of ``BLOCK`` turns, each with the sums before and after it. Conversations are grouped by (before, after),
   which is by successive block digests: a block shared by many conversations is one row from here on, counted where it is read.
2. Where all that goes on from a place goes through the same block, its inner turns are nodes as they are. Only where sibling blocks
   diverge are they cut into turns, and nodes found by the sums after each turn: over distinct blocks, not over conversations.
3. Sums over subtrees need no walk. The smallest member of a node owns it, and each conversation owns an end of its path; so the texts below a node
   are what its members own, and a second grouping of the blocks adds up lengths, owned lengths and owned leaves of the members.
4. Ids of the conversations that end at a node are written in order as pieces of text, then digested one after the other. A digest in order
   has to pass through one task per node, with 64 KB of it at a time.

Defined cases: null roles and texts are empty; turns are ordered by turn (null first), then digest; repeated rows are turns of their own;
rows without a conversation id form one conversation, larger than all others and not named in the digests; texts of any length are one digest;
an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.common import column, few, map_arrow, stage
from tillroll.llm.merkle import CRC32
from tillroll.llm.ranks import numbered

#: Turns of a block.
BLOCK = 4
#: Blocks whose sums one task adds up in a row; longer conversations are carried on.
STRETCH = 1 << 12
#: Moduli and bases of the sums.
PRIMES = (2**61 - 1, 2**61 - 31)
BASES = (0x1D8AF066F5C2A9B1, 0x0F3C5E17A9B84D63)
#: Characters of ids that are digested at a time.
PIECE = 1 << 16

KEY = ["depth", "a", "b"]


def turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, digest, chars (code points of the text)."""
    said, by = (F.coalesce(column(table, c).cast("string"), F.lit("")) for c in (text, role))
    return table.select(column(table, conv).alias("conv_id"), column(table, turn).alias("turn"),
                        F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256).alias("digest"),
                        F.char_length(said).cast("long").alias("chars"))


def placed(said: DataFrame, most: int = 1 << 13) -> tuple[DataFrame, DataFrame]:
    """Turns with part, run and at, and the runs of their conversations."""
    return numbered(said, "conv_id", ["turn", "digest"], "trie", most)


def as_they_are(table: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns, place, digest, chars) and (conv_id, n_turns) of the conversations themselves."""
    spans = runs.select("part", "run", "start", F.col("size").alias("n_turns"))
    rows = table.join(few(spans), ["part", "run"]).select("conv_id", "n_turns", (F.col("start") + F.col("at")).alias("place"), "digest", "chars")
    return rows, runs.where(F.col("start") == 0).select("conv_id", F.col("size").alias("n_turns"))


def spliced(table: DataFrame, runs: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns (at most ``most``) are replaced by as many of the conversation ``base``; as :func:`as_they_are`.

    A base that does not exist gives no turns. A conversation's data go to its runs, so a long one is not joined by its id.
    """
    convs = runs.where(F.col("start") == 0).select("conv_id", "size")
    wanted = convs.withColumns({"base": base, "head": F.coalesce(head, F.lit(0)).cast("long")})
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    given = F.least("head", F.coalesce("base_size", F.lit(0)))
    wanted = stage(wanted.join(sizes, "base", "left").withColumn("given", given).withColumn(
        "n_turns", F.col("given") + F.greatest(F.col("size") - F.col("head"), F.lit(0))), "trie-spliced")
    # a conversation's runs after its first one are few
    of_runs = stage(runs.drop("size").join(wanted.select(F.col("conv_id").alias("named"), "head", "given", "n_turns"),
                                           F.col("conv_id").eqNullSafe(F.col("named"))).drop("conv_id", "named"), "trie-runs")
    at = F.col("start") + F.col("at")
    kept = table.join(few(of_runs), ["part", "run"]).withColumn("place", at)
    own = kept.where(F.col("place") >= F.col("head")).select("conv_id", "n_turns", (F.col("place") - F.col("head") + F.col("given")).alias("place"), "digest", "chars")
    bases = wanted.select("base").where(F.col("base").isNotNull()).distinct()
    firsts = (kept.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "digest", "chars").join(bases, "base", "left_semi"))
    lent = firsts.join(wanted.select("conv_id", "base", "given", "n_turns").where(F.col("given") > 0), "base").where(F.col("place") < F.col("given"))
    return own.unionByName(lent.select("conv_id", "n_turns", "place", "digest", "chars")), wanted.select("conv_id", "n_turns")


def _blocks(block: int, kind: pa.DataType):
    names = ["conv_id", "n_turns", "stretch", "depth", "a", "b", "c", "after_a", "after_b", "chars"]
    kinds = [kind, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (p, q), (x, y) = PRIMES, BASES
        key, out, now, a, b, c = None, [], None, 0, 0, 0

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            fields = ("conv_id", "n_turns", "stretch", "place", "digest", "chars")
            for conv, n, stretch, place, value, chars in zip(*(batch.column(f).to_pylist() for f in fields)):
                if key != (conv, stretch):
                    if now:
                        out.append(tuple(now))
                    key, now, a, b, c = (conv, stretch), None, 0, 0, 0
                if now is None or place % block == 0:
                    if now:
                        out.append(tuple(now))
                    now = [conv, n, stretch, place, a, b, c, [], [], []]
                a = (a + int(value[:32], 16) * pow(x, place, p)) % p
                b = (b + int(value[32:], 16) * pow(y, place, q)) % q
                c += chars
                now[7].append(a)
                now[8].append(b)
                now[9].append(chars)
            if len(out) >= 5_000:
                yield handed()
                out = []
        if now:
            out.append(tuple(now))
        if out:
            yield handed()

    return run


def blocks(rows: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Blocks of turns: conv_id, n_turns, depth (turns before), a, b, c (sums and characters before), after_a, after_b and chars of each turn."""
    dealt = rows.withColumn("stretch", F.expr(f"place div {block * stretch}")).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in ("n_turns", "stretch", "depth", "a", "b", "c")),
                           *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("after_a", "after_b", "chars"))])
    found = stage(map_arrow(dealt.select("conv_id", "n_turns", "stretch", "place", "digest", "chars"), _blocks(block, to_arrow_type(kind)), schema), "trie-blocks")
    if found.where(F.col("stretch") > 0).isEmpty():
        return found.drop("stretch")
    # what stands before each later stretch; sums of longs below 2**61 are kept as decimals
    last = F.max(F.struct("depth", F.element_at("after_a", -1).alias("a"), F.element_at("after_b", -1).alias("b"),
                          (F.col("c") + F.aggregate("chars", F.lit(0).cast("long"), lambda s, v: s + v)).alias("c")))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = found.where(F.col("stretch") > 0).select("conv_id").distinct()
    whole = found.alias("f").join(long_ones.alias("l"), F.col("f.conv_id").eqNullSafe(F.col("l.conv_id")), "left_semi")
    stops = whole.groupBy("conv_id", "stretch").agg(last.alias("last"))
    total = {n: F.sum(F.col(f"last.{n}").cast("decimal(38,0)")).over(before) for n in ("a", "b", "c")}
    carry = stops.select(F.col("conv_id").alias("named"), F.col("stretch").alias("later"), (total["a"] % PRIMES[0]).cast("long").alias("more_a"),
                        (total["b"] % PRIMES[1]).cast("long").alias("more_b"), total["c"].cast("long").alias("more_c")).where(F.col("later") > 0)
    carry = stage(carry, "trie-carry")
    joined = found.join(few(carry), F.col("conv_id").eqNullSafe(F.col("named")) & (F.col("stretch") == F.col("later")), "left")
    more = {n: F.coalesce(f"more_{n}", F.lit(0)) for n in ("a", "b", "c")}
    (p, q), (x, y) = PRIMES, (more["a"], more["b"])
    moved = {"a": (F.col("a") + x) % p, "b": (F.col("b") + y) % q, "c": F.col("c") + more["c"],
             "after_a": F.transform("after_a", lambda v: (v + x) % p), "after_b": F.transform("after_b", lambda v: (v + y) % q)}
    return stage(joined.withColumns(moved).drop("stretch", "named", "later", "more_a", "more_b", "more_c"), "trie-carried")


def _nodes(of: DataFrame, least: Column, sums: list[str]) -> DataFrame:
    """Nodes below the root, from blocks with the columns ``sums`` of their conversation: depth, a, b, those of the parent (up_a, up_b), before (characters
    above the last text), chars (of the last text), n, ends, least and the sums."""
    size = F.size("after_a")
    marked = of.withColumns({"size": size, "last_a": F.element_at("after_a", -1), "last_b": F.element_at("after_b", -1),
                             "ending": (F.col("depth") + size == F.col("n_turns")).cast("long"), "own": least})
    same = ["after_a", "after_b", "chars", "c"]
    distinct = stage(marked.groupBy(*KEY, "size", "last_a", "last_b").agg(
        *[F.first(c).alias(c) for c in same], F.count(F.lit(1)).alias("n"), F.sum("ending").alias("ends"), F.min("own").alias("least"),
        *[F.sum(c).alias(c) for c in sums]), "trie-distinct")
    ways = distinct.groupBy(*KEY).agg(F.count(F.lit(1)).alias("ways"))
    known = distinct.join(ways, KEY)
    upper = lambda now, before, i: F.when(i == 0, F.col(before)).otherwise(F.element_at(now, F.greatest(i, F.lit(1))))
    i = F.col("i")
    cut = known.select("*", F.posexplode("chars").alias("i", "said")).select(
        "ways", (F.col("depth") + i + 1).alias("depth"), F.element_at("after_a", i + 1).alias("a"), F.element_at("after_b", i + 1).alias("b"),
        upper("after_a", "a", i).alias("up_a"), upper("after_b", "b", i).alias("up_b"),
        (F.col("c") + F.aggregate(F.slice("chars", F.lit(1), i), F.lit(0).cast("long"), lambda s, v: s + v)).alias("before"),
        F.col("said").alias("chars"), "n", F.when(i + 1 == F.col("size"), F.col("ends")).otherwise(F.lit(0)).alias("ends"), "least", *sums)
    alone = cut.where(F.col("ways") == 1).drop("ways")
    refined = cut.where(F.col("ways") > 1).groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in ("up_a", "up_b", "before", "chars")], F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in sums])
    return alone.unionByName(refined)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the conversations that end at a node, in order, as pieces of text."""
    part, place, key, held, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []

    def closed():
        nonlocal held, size, place
        out.append((*key, part, place, ",".join(held)))
        held, size, place = [], 0, place + 1

    def handed():
        kinds = [*[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], [*KEY, "part", "place", "ids"])

    for batch in batches:
        for depth, a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
            if held and (key != (depth, a, b) or size >= PIECE):
                closed()
            key = (depth, a, b)
            held.append(str(conv))
            size += len(held[-1]) + 1
        if sum(len(o[-1]) for o in out) >= 16 * PIECE or len(out) >= 5_000:
            yield handed()
            out = []
    if held:
        closed()
    if out:
        yield handed()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, running, out = None, None, []

    def handed():
        kinds = [*[pa.int64()] * 3, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], [*KEY, "ends_sha256"])

    for batch in batches:
        for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if key != (depth, a, b):
                if key:
                    out.append((*key, running.hexdigest()))
                key, running = (depth, a, b), hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if len(out) >= 5_000:
            yield handed()
            out = []
    if key:
        out.append((*key, running.hexdigest()))
    if out:
        yield handed()


def ends(last: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node: depth, a, b, ends_sha256; ``last`` has these and conv_id."""
    order = [*KEY, "conv_id"]
    dealt = last.where(F.col("conv_id").isNotNull()).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stage(map_arrow(dealt, _pieces, "depth long, a long, b long, part long, place long, ids string"), "trie-ends")
    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part", "place").select(*KEY, "ids")
    return map_arrow(dealt, _digested, "depth long, a long, b long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has conv_id, n_turns, place, digest, chars; ``convs`` every conversation, with or without turns.
    """
    cut = blocks(rows, block, stretch)
    zero = F.lit(0).cast("long")
    order = [F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")]
    # first grouping: who owns which part of the paths
    first = stage(_nodes(cut, F.struct(*order), []).select(F.col("least.id").alias("owner"), "chars", (F.col("ends") == F.col("n")).cast("long").alias("leaf")), "trie-owned")
    owned = first.groupBy("owner").agg(F.sum("chars").alias("fresh"), F.sum("leaf").alias("leaves"))
    last = cut.where(F.col("depth") + F.size("after_a") == F.col("n_turns")).select(
        "conv_id", F.col("n_turns").alias("depth"), F.element_at("after_a", -1).alias("a"), F.element_at("after_b", -1).alias("b"),
        (F.col("c") + F.aggregate("chars", F.lit(0).cast("long"), lambda s, v: s + v)).alias("total"))
    silent = convs.where(F.col("n_turns") == 0).select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("total"))
    last = last.unionByName(silent)
    each = stage(last.join(owned, F.col("conv_id").eqNullSafe(F.col("owner")), "left").drop("owner").na.fill(0, ["fresh", "leaves"]), "trie-conversations")
    # second grouping: what the members have and own
    sums = ["total", "fresh", "leaves"]
    least = F.struct(*order, "total", "fresh")
    members = cut.join(each.select(F.col("conv_id").alias("named"), *sums), F.col("conv_id").eqNullSafe(F.col("named"))).drop("named")
    below = _nodes(members, least, sums)
    root = each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("depth") == 0).cast("long")), zero).alias("ends"), F.min(least).alias("least"),
                    *[F.sum(c).alias(c) for c in sums]).where(F.col("n") > 0)
    root = root.select(*[zero.alias(c) for c in KEY], *[F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")], zero.alias("before"), zero.alias("chars"),
                       "n", "ends", "least", *sums)
    nodes = stage(below.unionByName(root), "trie-nodes")
    children = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("least.id").alias("parent_conv_id"))
    # texts below a node: of its owner from here on, and what the other members own
    distinct = F.col("fresh") - F.col("least.fresh") + F.col("least.total") - F.col("before")
    saved = F.col("total") - F.col("n") * F.col("before") - distinct
    alone = (F.col("n") == F.col("ends")) & (F.col("depth") == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(children, KEY, "left").join(ends(each), KEY, "left").join(parents, ["depth", "up_a", "up_b"], "left").select(
        F.col("least.id").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return trie(*spliced(*placed(said), F.col("conv_id") - F.col("conv_id") % 100, head, 5))


SQL = f"""
WITH said AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars, turn
  FROM conversations),
t AS (SELECT c, digest, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM said),
convs AS (SELECT c, count(*) AS n, coalesce({CRC32.format("c")} % 6, 0) AS head, c - c % 100 AS base FROM t GROUP BY c),
w AS (SELECT a.c, a.n, a.head, a.base, least(a.head, coalesce(b.n, 0)) AS given FROM convs a LEFT JOIN convs b ON b.c = a.base),
rebuilt AS (
  SELECT w.c, t.place - w.head + w.given AS place, digest, chars FROM w JOIN t ON t.c IS NOT DISTINCT FROM w.c WHERE t.place >= w.head
  UNION ALL SELECT w.c, t.place, digest, chars FROM w JOIN t ON t.c = w.base WHERE t.place < w.given),
paths AS (
  SELECT c, 0 AS depth, '' AS node, 0 AS chars FROM w
  UNION ALL SELECT c, place + 1, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY place)), chars FROM rebuilt),
tops AS (SELECT c, max(depth) AS depth FROM paths GROUP BY c),
nodes AS (SELECT depth, node, min(c) AS least, count(*) AS n, max(chars) AS chars FROM paths GROUP BY depth, node),
up AS (
  SELECT x.depth, x.node, y.node AS above, y.least AS parent FROM nodes x JOIN paths q ON q.c IS NOT DISTINCT FROM x.least AND q.depth = x.depth - 1
  JOIN nodes y ON y.depth = q.depth AND y.node = q.node),
kids AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM up GROUP BY 1, 2),
known AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM nodes x LEFT JOIN kids k ON k.depth = x.depth AND k.node = x.node),
below AS (
  SELECT q.depth, q.node, sum((x.n - 1) * x.chars) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
  FROM known x JOIN paths q ON q.c IS NOT DISTINCT FROM x.least AND q.depth <= x.depth GROUP BY q.depth, q.node),
stops AS (
  SELECT p.depth, p.node, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM paths p JOIN tops e ON e.c IS NOT DISTINCT FROM p.c AND e.depth = p.depth
  GROUP BY p.depth, p.node)
SELECT x.least AS conv_id, CAST(x.depth AS BIGINT) AS depth, u.parent AS parent_conv_id, x.n AS n_convs, x.n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(s.ids, '')) AS ends_sha256
FROM known x JOIN below b ON b.depth = x.depth AND b.node = x.node LEFT JOIN up u ON u.depth = x.depth AND u.node = x.node
LEFT JOIN stops s ON s.depth = x.depth AND s.node = x.node
"""
