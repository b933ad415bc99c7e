"""Merkle manifest of a dataset, with a proof for every row.

A leaf is the SHA-256 digest of a row's columns, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value. The leaves
of a group (here: a language) ascend by id; while several nodes remain, every ``WIDTH`` consecutive ones become the digest of
their hex digests in a row. What remains is the group's subroot; the subroots, ordered by group, give the root in the same way.

1. Rows become digests where they are read; only digests are moved. They are numbered in ranges (:mod:`tillroll.llm.ranks`).
2. Interior nodes: each task takes aligned blocks of leaves and computes ``LIFT`` levels of them; the block roots go round again.
3. Proofs by multiproof: a leaf partition (a run of leaves) computes the least set of node coordinates that it lacks to reach the root, level
   by level: the siblings of known nodes that are not known themselves. These are fetched once, in one join for all partitions. The
   partition then derives the interiors its leaves share, and expands the proof of each leaf from them.

Defined cases: a null id comes first; rows equal in id are ordered by their digest, and repeated rows are leaves of their own; null is a group,
the first; a group of one leaf has that leaf as its subroot; an empty table has no rows and no root; texts of any length are one value;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.common import column, few, map_arrow, stage
from tillroll.llm.ranks import numbered

WIDTH = 8
#: Levels that a task computes at a time, from blocks of WIDTH ** LIFT nodes.
LIFT = 3
#: The tree over the subroots, beside the groups' trees 0, 1, 2 ...
UPPER = -1
#: Proofs handed over at a time.
HANDOVER = 1_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Iterable[Column]) -> Column:
    """Digest of the values of a row."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def missing(places: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Least set of (level, index) that is needed beside the leaves at ``places`` to reach the root of a tree of ``size`` leaves."""
    found, level, known = [], 0, np.unique(places)
    while size > 1:
        parents = np.unique(known // WIDTH)
        children = (parents[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        lacking = np.setdiff1d(children[children < size], known, assume_unique=True)
        found += [(level, int(i)) for i in lacking]
        known, size, level = parents, -(-size // WIDTH), level + 1
    return found


def _levels(now: dict[int, str], size: int, fetched: dict) -> Iterator[tuple[dict[int, list[str]], dict[int, str]]]:
    """From the known nodes of a level to the root: children of each parent, and the parents."""
    level = 0
    while size > 1:
        children = {}
        for parent in {i // WIDTH for i in now}:
            first = parent * WIDTH
            children[parent] = [now[i] if i in now else fetched[level, i] for i in range(first, min(first + WIDTH, size))]
        now = {parent: digest("".join(kids)) for parent, kids in children.items()}
        yield children, now
        size, level = -(-size // WIDTH), level + 1


def fold(claimed: str, path: list[int], siblings: str) -> str:
    """The root that follows from a leaf and its proof; ``path`` has WIDTH * (nodes of the run) + place in it, level by level."""
    at = 0
    for step in path:
        count, place = divmod(step, WIDTH)
        count = count - 1
        here = siblings[at:at + 64 * count]
        claimed, at = digest(here[:64 * place] + claimed + here[64 * place:]), at + 64 * count
    return claimed


def _interiors(level: int):
    """Nodes of the next ``LIFT`` levels from whole blocks (tree, size, index, hash), in order."""
    width = WIDTH ** LIFT

    def nodes(tree: int, size: int, block: int, hashes: list[str]):
        first, at = block * width, level
        while size > 1 and at < level + LIFT:
            hashes = [digest("".join(hashes[i:i + WIDTH])) for i in range(0, len(hashes), WIDTH)]
            first, size, at = first // WIDTH, -(-size // WIDTH), at + 1
            yield from ((tree, size, at, first + i, h) for i, h in enumerate(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def handed():
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["tree", "size", "level", "index", "hash"])

        for batch in batches:
            for tree, size, index, value in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "index", "hash"))):
                if key != (tree, size, index // width):
                    if held:
                        out += nodes(*key, held)
                    key, held = (tree, size, index // width), []
                held.append(value)
            if len(out) >= HANDOVER:
                yield handed()
                out = []
        if held:
            out += nodes(*key, held)
        if out:
            yield handed()

    return run


def interiors(leaves: DataFrame, largest: int) -> DataFrame:
    """All nodes of the trees over the leaves (tree, size, index, hash), as (tree, level, index, hash); ``size`` counts a tree's leaves."""
    found, level, now = [], 0, leaves
    while largest > 1:
        dealt = now.withColumn("block", F.expr(f"index div {WIDTH ** LIFT}")).repartition("tree", "block")
        dealt = dealt.sortWithinPartitions("tree", "index").select("tree", "size", "index", "hash")
        made = stage(map_arrow(dealt, _interiors(level), "tree long, size long, level long, index long, hash string"), "merkle-nodes")
        found.append(made.select("tree", "level", "index", "hash"))
        level += LIFT
        now = made.where((F.col("level") == level) & (F.col("size") > 1))
        largest = -(-largest // WIDTH ** LIFT)
    bottom = leaves.select("tree", F.lit(0).cast("long").alias("level"), "index", "hash")
    return reduce(DataFrame.unionByName, found, bottom)


@dataclass(frozen=True)
class Manifest:
    """Leaves with their places, the runs they are dealt in, and the nodes of all trees."""

    leaves: DataFrame  #: id, leaf, other columns given, part, run, tree, size, index
    nodes: DataFrame  #: tree, level, index, hash; level 0 too; UPPER is the tree of the subroots
    trees: DataFrame  #: group, tree, size
    n_trees: int

    def subroots(self) -> DataFrame:
        """group, size, subroot."""
        tops = self.nodes.where((F.col("tree") == UPPER) & (F.col("level") == 0)).select(F.col("index").alias("tree"), F.col("hash").alias("subroot"))
        return self.trees.join(tops, "tree").select("group", "size", "subroot")

    def root(self) -> str | None:
        upper = self.nodes.where(F.col("tree") == UPPER)
        top = upper.orderBy(F.desc("level"), "index").select("hash").first()
        return top.hash if top else None


def manifest(leaves: DataFrame) -> Manifest:
    """The trees over ``leaves``: group, id, leaf, and columns to carry along."""
    table, runs = numbered(leaves, "group", ["id", "leaf"], "merkle")
    groups = runs.groupBy("group").agg(F.sum("n").alias("size")).withColumn("all", F.lit(0))
    listed, spans = numbered(groups, "all", ["group"], "merkle-groups")
    trees = stage(listed.join(few(spans.select("part", "run", "start")), ["part", "run"])
                  .select("group", (F.col("start") + F.col("at")).alias("tree"), "size"), "merkle-trees")
    count, largest = trees.agg(F.count(F.lit(1)), F.max("size")).first()
    runs = stage(runs.join(few(trees.select(F.col("group").alias("named"), "tree")), F.col("group").eqNullSafe(F.col("named")))
                 .select("part", "run", "start", "size", "tree"), "merkle-runs")
    placed = (table.join(few(runs), ["part", "run"]).withColumn("index", F.col("start") + F.col("at")).drop("start", "at"))
    bottom = placed.select("tree", "size", "index", F.col("leaf").alias("hash"))
    lower = interiors(bottom, largest or 0)
    # the subroot stands at the level where one node is left
    height = F.lit(0)
    for level in range(1, 22):
        height = height + (F.col("size") > F.lit(WIDTH ** (level - 1))).cast("int")
    tops = trees.withColumn("level", height.cast("long")).join(lower, ["tree", "level"])
    upper = stage(tops.select(F.lit(UPPER).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("index"), "hash"), "merkle-tops")
    return Manifest(placed, lower.unionByName(interiors(upper, count)), trees, count)


def _coordinates(n_trees: int):
    """What each leaf partition lacks: (part, run, tree, level, index)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, number, tree, size, places in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "tree", "size", "places"))):
                rows += [(part, number, tree, level, i) for level, i in missing(np.array(places, np.int64), size)]
                rows += [(part, number, UPPER, level, i) for level, i in missing(np.array([tree], np.int64), n_trees)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "run", "tree", "level", "index"])

    return run


def _proofs(n_trees: int, kind: pa.DataType):
    names = ["id", "leaf", "subroot", "root", "path", "siblings", "folded_root"]
    kinds = [kind, pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string()]

    def expanded(tree: int, size: int, leaves: list, lower: dict, upper: dict) -> Iterator[tuple]:
        levels = list(_levels({i: h for i, _, h, _ in leaves}, size, lower))
        subroot = levels[-1][1][0] if levels else leaves[0][2]
        above = list(_levels({tree: subroot}, n_trees, upper))
        root = above[-1][1][0] if above else subroot
        # proofs from each node upwards, the highest first; nodes below share what stands above them
        steps, text, at = (), "", tree
        for children, _ in above:
            kids, place = children[at // WIDTH], at % WIDTH
            steps, text, at = (*steps, WIDTH * len(kids) + place), text + "".join(kids[:place] + kids[place + 1:]), at // WIDTH
        rest = {0: (steps, text)}
        for children, _ in reversed(levels[1:]):
            rest = {parent * WIDTH + place: ((WIDTH * len(kids) + place, *rest[parent][0]), "".join(kids[:place] + kids[place + 1:]) + rest[parent][1])
                    for parent, kids in children.items() for place in range(len(kids))}
        for index, identity, value, claimed in leaves:
            if levels:
                kids, place = levels[0][0][index // WIDTH], index % WIDTH
                steps, text = rest[index // WIDTH]
                path, siblings = [WIDTH * len(kids) + place, *steps], "".join(kids[:place] + kids[place + 1:]) + text
            else:
                path, siblings = list(rest[0][0]), rest[0][1]
            yield identity, value, subroot, root, path, siblings, fold(value if claimed is None else claimed, path, siblings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lower, upper, leaves, out = None, {}, {}, [], []

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def closed():
            nonlocal out
            for row in expanded(key[2], key[3], leaves, lower, upper) if leaves else ():
                out.append(row)
                if len(out) >= HANDOVER:
                    yield handed()
                    out = []

        for batch in batches:
            fields = ("part", "run", "own", "of", "size", "tree", "level", "index", "hash", "id", "claimed")
            for part, number, own, of, size, tree, level, index, value, identity, claimed in zip(*(batch.column(c).to_pylist() for c in fields)):
                if key is None or key[:2] != (part, number):
                    yield from closed()
                    key, lower, upper, leaves = (part, number, of, size), {}, {}, []
                if own:
                    key = (part, number, of, size)
                    leaves.append((index, identity, value, claimed))
                else:
                    (upper if tree == UPPER else lower)[level, index] = value
        yield from closed()
        if out:
            yield handed()

    return run


def proofs(made: Manifest, wanted: DataFrame | None = None, claimed: str | None = None) -> DataFrame:
    """id, leaf, subroot, root, path, siblings, folded_root of the leaves ``wanted`` (rows of ``made.leaves``), or of all.

    ``siblings`` has the hex digests of the proof in a row; ``folded_root`` is what follows from the column ``claimed`` where it is not null,
    else from the leaf, by :func:`fold`. A proof holds if that is the root.
    """
    rows = made.leaves if wanted is None else wanted
    places = rows.groupBy("part", "run").agg(F.first("tree").alias("tree"), F.first("size").alias("size"), F.collect_list("index").alias("places"))
    lacking = stage(map_arrow(places, _coordinates(made.n_trees), "part long, run long, tree long, level long, index long"), "merkle-lacking")
    fetched = made.nodes.join(few(lacking), ["tree", "level", "index"])
    identity = rows.schema["id"].dataType
    none = F.lit(None)
    own = rows.select("part", "run", F.lit(True).alias("own"), F.col("tree").alias("of"), "size", "tree", F.lit(0).cast("long").alias("level"), "index",
                      F.col("leaf").alias("hash"), "id", (F.col(claimed) if claimed else none.cast("string")).alias("claimed"))
    other = fetched.select("part", "run", F.lit(False).alias("own"), none.cast("long").alias("of"), none.cast("long").alias("size"), "tree", "level", "index",
                           "hash", none.cast(identity).alias("id"), none.cast("string").alias("claimed"))
    dealt = other.unionByName(own).repartition("part", "run").sortWithinPartitions("part", "run", "own", "index")
    schema = T.StructType([T.StructField("id", identity), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")),
                           T.StructField("path", T.ArrayType(T.LongType())), *(T.StructField(c, T.StringType()) for c in ("siblings", "folded_root"))])
    return map_arrow(dealt, _proofs(made.n_trees, to_arrow_type(identity)), schema)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    values = [column(docs, c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(values).alias("leaf"),
                                 F.when(tampered, leaf([*values[:-1], lowered(values[-1])])).alias("tampered")))
    return proofs(found, claimed="tampered").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels of the statement: 8 ** 7 documents of a language, 8 ** 4 languages.
LOWER_LEVELS, UPPER_LEVELS = 7, 4
#: The unsigned CRC-32 of the decimal digits of a number, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(({0}::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _statement() -> str:
    def value(name: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"

    def row(text: str) -> str:
        return "sha256(" + " || ".join([value(c) for c in FIELDS[:-1]] + [f"CASE WHEN text IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"]) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"d AS (SELECT doc_id, lang, {row('text')} AS leaf, CASE WHEN {CRC32.format('doc_id')} % 3 = 0 THEN {row(low)} END AS tampered FROM documents)",
             "p0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
             "u0 AS (SELECT lang AS g, i, leaf AS h FROM p0)"]

    # a level stays as it is once one node remains
    def climb(prefix: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"{prefix}{k}c AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {prefix}{k})")
            steps.append(f"{prefix}{k + 1} AS (SELECT g, CASE WHEN c > 1 THEN i // {WIDTH} ELSE i END AS i, CASE WHEN min(c) > 1 THEN sha256(string_agg(h, '' ORDER BY {prefix}{k}c.i)) "
                         f"ELSE min(h) END AS h FROM {prefix}{k}c GROUP BY g, CASE WHEN c > 1 THEN i // {WIDTH} ELSE i END)")

    climb("u", LOWER_LEVELS)
    steps.append(f"t AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j FROM u{LOWER_LEVELS})")
    steps.append("s0 AS (SELECT 0 AS g, j AS i, subroot AS h FROM t)")
    climb("s", UPPER_LEVELS)
    # siblings before and after a node, and the node that a claimed leaf leads to, level by level
    steps.append("f0 AS (SELECT p0.doc_id, p0.lang, p0.leaf, t.subroot, t.j, p0.i, coalesce(p0.tampered, p0.leaf) AS now, '' AS proof "
                 "FROM p0 JOIN t ON p0.lang IS NOT DISTINCT FROM t.lang)")
    step = 0
    for prefix, levels, group in (("u", LOWER_LEVELS, "f.lang"), ("s", UPPER_LEVELS, "0")):
        if prefix == "s":
            steps.append(f"f{step}j AS (SELECT doc_id, lang, leaf, subroot, j, j AS i, now, proof FROM f{step})")
        for k in range(levels):
            source = f"f{step}j" if prefix == "s" and k == 0 else f"f{step}"
            steps.append(f"{prefix}{k}r AS (SELECT g, i // {WIDTH} AS r, max(c) AS c, list(h ORDER BY i) AS hs FROM {prefix}{k}c GROUP BY g, i // {WIDTH})")
            before, after = f"list_aggregate(list_slice(hs, 1, f.i % {WIDTH}), 'string_agg', '')", f"list_aggregate(list_slice(hs, f.i % {WIDTH} + 2, {WIDTH}), 'string_agg', '')"
            steps.append(
                f"f{step + 1} AS (SELECT f.doc_id, f.lang, f.leaf, f.subroot, f.j, CASE WHEN c > 1 THEN f.i // {WIDTH} ELSE f.i END AS i, "
                f"CASE WHEN c > 1 THEN sha256(coalesce({before}, '') || now || coalesce({after}, '')) ELSE now END AS now, "
                f"proof || CASE WHEN c > 1 THEN coalesce({before}, '') || coalesce({after}, '') ELSE '' END AS proof "
                f"FROM {source} f JOIN {prefix}{k}r x ON x.g IS NOT DISTINCT FROM {group} AND x.r = f.i // {WIDTH})")
            step += 1
    return ("WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, (SELECT min(h) FROM s{UPPER_LEVELS}) AS root, sha256(proof) AS proof_sha256, "
            f"now AS folded_root, now = (SELECT min(h) FROM s{UPPER_LEVELS}) AS verified FROM f{step}")


SQL = _statement()
