"""Secrets: candidates by pattern, then a random forest that removes false positives.

Candidates are runs of at least twelve letters, digits and ``+/_-`` that hold both a letter and a digit. A random forest judges
each by its length, character classes and their changes, the likelihood of its character transitions, its
coverage by dictionary words, the path of its document and the words around it.

The forest is trained on labelled findings: rows (candidate, before, after, path, label). ``labelled`` makes them from at most ``SAMPLE`` documents
(those with the least hash of their id): keys as several services write them, in assignments, are secrets; identifiers, paths,
dates, versions, checksums and placeholders made of the documents' own words are not. Dictionary and transitions are part of the trained model:
all words of letters, counted over all documents and whole texts. Candidates are taken from these too.

Only built-in functions and pyspark.ml are used. Words and distinct candidates, counted within each task before, are shuffled; texts are not.

Defined cases: null text has no candidates; a candidate of any length is judged whole; each occurrence is a finding of its own, also in
repeated rows; null path counts as empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.llm.common import column, few, stage, words

SAMPLE = 1_500
TREES, DEPTH, SEED = 40, 8, 29
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SIDE = len(ALPHABET) + 1
#: Equals signs after a run are its padding only if no further run begins there: that of NAME=value belongs to neither.
RUN = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{12,}+(?:={1,2}+(?![A-Za-z0-9+/_-]))?)"
CUES = ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential", "api")
OTHER_CUES = ("commit", "sha", "hash", "checksum", "md5", "version", "uuid", "digest", "example", "file", "path", "revision")
PATH_CUES = ("test", "example", "doc", "fixture", "vendor", "lock")


def candidates(docs: DataFrame, identity: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Rows (id, word, candidate, before, after, path), one per occurrence; word counts from 0.

    Before the first run of a word stand two words and the beginning of its own, after the last the next two words. Between runs of one
    word, before is the run before with what follows it, after is what stands up to the next; so all rows together stay as long as the text.
    """
    where = column(docs, path).cast("string") if path else F.lit("")
    table = docs.select(column(docs, identity).alias("id"), F.coalesce(where, F.lit("")).alias("path"), words(column(docs, text)).alias("w"))
    w = F.col("w")
    long_ones = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.length(F.get(w, i)) >= 12)
                         & F.get(w, i).rlike("[0-9]") & F.get(w, i).rlike("[A-Za-z]"))
    places = table.where(F.size(w) > 0).withColumn("word", F.explode(long_ones))
    near = lambda *steps: F.concat_ws(" ", *[F.get(w, F.col("word") + s) for s in steps])
    own = F.get(w, F.col("word"))
    rows = places.select("id", "path", "word", near(1, 2).alias("next"), F.regexp_extract_all(own, F.lit(RUN), F.lit(1)).alias("runs"),
                         F.split(own, RUN, -1).alias("between"),
                         F.when(F.col("word") > 0, F.concat_ws(" ", F.slice(w, F.greatest(F.col("word") - 2, F.lit(1)), F.least(F.col("word"), F.lit(3))))).otherwise("").alias("left"))
    run, gap = (lambda k: F.get("runs", k)), (lambda k: F.get("between", k))
    front = F.ltrim(F.concat_ws(" ", "left", gap(F.lit(0))))
    mixed = F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda k: run(k).rlike("[0-9]") & run(k).rlike("[A-Za-z]"))
    found = F.transform(mixed, lambda k: F.struct(
        run(k).alias("candidate"),
        F.when(k == 0, front).when(k == 1, F.concat(front, run(k - 1), gap(k))).otherwise(F.concat(run(k - 1), gap(k))).alias("before"),
        F.when(k == F.size("runs") - 1, F.col("next")).otherwise(gap(k + 1)).alias("after")))
    rows = rows.where(F.size("runs") > 0).select("id", F.col("word").cast("long").alias("word"), F.explode(found).alias("f"), "path")
    return rows.select("id", "word", "f.candidate", "f.before", "f.after", "path")


def _sampled(docs: DataFrame, identity: str, text: str, sample: int) -> DataFrame:
    """Rows (seed, w): words of the sampled documents."""
    rows = docs.select(F.xxhash64(column(docs, identity)).alias("h"), column(docs, text).alias("text"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("text").alias("text"))  # one row of equal ids
    plain = F.filter(words(F.lower("text")), lambda x: x.rlike("^[a-z]{2,12}$"))
    return stage(chosen.select(F.col("h").alias("seed"), plain.alias("w")).where(F.size("w") >= 8), "secret-sample")


def labelled(sampled: DataFrame) -> DataFrame:
    """Findings with labels, some sixteen for each sampled document."""
    s = F.col("seed").cast("string")
    pick = lambda k: F.element_at("w", F.pmod(F.xxhash64("seed", F.lit(k)), F.size("w")).cast("int") + 1)
    number = lambda k, top: F.pmod(F.xxhash64("seed", F.lit(100 + k)), F.lit(top)).cast("string")
    made = lambda k: F.sha2(F.concat(s, F.lit(f"/{k}")), 256)
    wide = lambda k: F.regexp_replace(F.base64(F.unhex(made(k))), "[+/=]", "x")
    cat = F.concat
    row = lambda label, candidate, before, after, path="": F.struct(
        candidate.alias("candidate"), before.alias("before"), after.alias("after"), F.lit(path).alias("path"), F.lit(float(label)).alias("label"))
    word = pick(1)
    secrets = [
        row(1, F.substring(made(1), 1, 40), cat(word, F.lit(" token = \"")), pick(2)),
        row(1, F.substring(made(2), 1, 32), cat(word, F.lit(" api_key: ")), pick(3)),
        row(1, wide(3), cat(word, F.lit(" secret = '")), pick(4)),
        row(1, cat(F.lit("AKIA"), F.upper(F.substring(made(4), 1, 16))), cat(word, F.lit(" aws key ")), pick(5)),
        row(1, cat(F.lit("ghp_"), F.substring(wide(5), 1, 36)), cat(word, F.lit(" auth ")), pick(6)),
        row(1, F.substring(wide(6), 1, 20), cat(word, F.lit(" password=")), pick(7)),
        row(1, cat(F.lit("sk_live_"), F.substring(wide(7), 1, 24)), cat(word, F.lit(" ")), pick(8)),
        row(1, F.substring(made(8), 1, 40), cat(F.lit("Authorization: Bearer "), word), pick(9)),
    ]
    others = [
        row(0, cat(pick(11), F.lit("_"), pick(12), F.lit("_"), pick(13), number(1, 99)), cat(word, F.lit(" ")), pick(2)),
        row(0, cat(pick(14), F.lit("-"), pick(15), F.lit("-2011-10-"), number(2, 31)), cat(word, F.lit(" file ")), pick(3)),
        row(0, cat(F.lit("src/"), pick(16), F.lit("/"), pick(17), number(3, 9), F.lit("/"), pick(18)), cat(F.lit("path "), word), pick(4)),
        row(0, F.substring(made(19), 1, 40), cat(word, F.lit(" commit ")), pick(5)),
        row(0, made(20), cat(word, F.lit(" sha256 checksum ")), pick(6), "package.lock"),
        row(0, cat(pick(21), pick(22), number(4, 999)), cat(word, F.lit(" ")), pick(7)),
        row(0, cat(F.lit("your_api_key_here"), number(5, 9)), cat(word, F.lit(" api_key = ")), pick(8), "docs/example"),
        row(0, cat(F.lit("xxxxxxxxxxxx"), number(6, 9999)), cat(word, F.lit(" token = ")), pick(9), "test/fixture"),
        row(0, cat(pick(23), F.lit("-"), pick(24), F.lit("-v"), number(7, 20)), cat(word, F.lit(" version ")), pick(10)),
        row(0, cat(F.initcap(pick(25)), F.initcap(pick(26)), F.initcap(pick(27)), number(8, 64)), cat(word, F.lit(" ")), pick(11)),
    ]
    return sampled.select("seed", F.explode(F.array(*secrets, *others)).alias("f")).select("seed", "f.*").where(F.length("candidate") >= 12)


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


class Model:
    """Forest, dictionary (a stored table of words and their counts) and log likelihoods of transitions."""

    def __init__(self, forest: RandomForestClassificationModel, dictionary: DataFrame, transitions: list[float]):
        self.forest, self.dictionary, self.transitions = forest, dictionary, transitions


NAMES = ["length", "digits", "upper", "lower", "special", "changes", "distinct", "hex", "likelihood", "least", "covered", "longest_word",
         *[f"cue_{c}" for c in CUES], *[f"other_{c}" for c in OTHER_CUES], *[f"path_{c}" for c in PATH_CUES], "assigned", "quoted", "prefix"]


def _covered(findings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (x_candidate, x_letters, x_longest): how many letters of each distinct candidate are in words of the dictionary, and its longest such word."""
    distinct = stage(findings.select(F.col("candidate").alias("x_candidate")).distinct(), "secret-distinct")
    parts = F.split(F.lower(F.regexp_replace("x_candidate", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    each = distinct.select("x_candidate", F.explode(parts).alias("word")).where(F.length("word") >= 2)
    known = stage(each.select("word").distinct().join(dictionary.select("word"), "word", "left_semi"), "secret-known")
    return few(stage(each.join(few(known), "word").groupBy("x_candidate").agg(
        F.sum(F.length("word")).alias("x_letters"), F.max(F.length("word")).alias("x_longest")), "secret-covered"))


def features(findings: DataFrame, dictionary: DataFrame, transitions: list[float]) -> DataFrame:
    """``findings`` with the column features."""
    c, n = F.col("candidate"), F.length("candidate")
    table = F.split(F.lit(" ".join(f"{t:.4f}" for t in transitions)), " ").cast("array<double>")
    small = F.lower(c)
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(
        table, (_code(F.substring(small, i, F.lit(1))) * SIDE + _code(F.substring(small, i + 1, F.lit(1))) + 1).cast("int")))
    count = lambda pattern: (F.size(F.split(c, pattern, -1)) - 1) / n
    before, place = F.lower(F.concat_ws(" ", "before", "after")), F.lower("path")
    flag = lambda condition: condition.cast("double")
    made = findings.join(_covered(findings, dictionary), c == F.col("x_candidate"), "left").withColumns({"x_steps": steps})
    columns = {
        "length": F.log(n.cast("double")), "digits": count("[0-9]"), "upper": count("[A-Z]"), "lower": count("[a-z]"), "special": count("[^A-Za-z0-9]"),
        "changes": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "hex": flag(c.rlike("^[0-9a-f]+$")),
        "likelihood": F.aggregate("x_steps", F.lit(0.0), lambda a, b: a + b) / n, "least": F.array_min("x_steps"),
        "covered": F.coalesce("x_letters", F.lit(0)) / n, "longest_word": F.coalesce("x_longest", F.lit(0)).cast("double"),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?\\s*$")), "quoted": flag(F.col("before").rlike("[\"']\\s*$")),
        "prefix": flag(c.rlike("^(AKIA|ghp_|gho_|sk_|pk_|xox|AIza|eyJ)")),
    }
    columns |= {f"cue_{w}": flag(before.contains(w)) for w in CUES} | {f"other_{w}": flag(before.contains(w)) for w in OTHER_CUES}
    columns |= {f"path_{w}": flag(place.contains(w)) for w in PATH_CUES}
    numbers = F.struct(*[columns[name].cast("double").alias(name) for name in NAMES])
    made = made.withColumn("x", numbers).select(*findings.columns, *[F.col(f"x.{name}").alias(f"x_{name}") for name in NAMES])
    return VectorAssembler(inputCols=[f"x_{name}" for name in NAMES], outputCol="features", handleInvalid="keep").transform(made).select(*findings.columns, "features")


def _counted(each: DataFrame) -> DataFrame:
    """Rows (word, count) of the words of letters in rows (word)."""
    return stage(each.where(F.col("word").rlike("^[a-z]{2,}$")).groupBy("word").count(), "secret-words")


def dictionary_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """All words of letters of all documents and how often they occur."""
    return _counted(docs.select(F.explode(words(F.lower(column(docs, text)))).alias("word")))


def _transitions(dictionary: DataFrame) -> list[float]:
    """Log likelihoods of character transitions in the counted words; of bounded size."""
    letters = dictionary.select("count", F.split("word", "").alias("c"))
    pairs = letters.select("count", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: _code(
        F.get("c", i)) * SIDE + _code(F.get("c", i + 1)))).alias("pair"))
    table = [[0.5] * SIDE for _ in range(SIDE)]
    for r in pairs.groupBy("pair").agg(F.sum("count").alias("n")).collect():
        table[r.pair // SIDE][r.pair % SIDE] += r.n
    return [math.log(v / sum(line)) for line in table for v in line]


def train(sampled: DataFrame, findings: DataFrame | None = None, dictionary: DataFrame | None = None) -> Model:
    """The forest fitted on ``findings`` (default: those of ``labelled``) with ``dictionary`` (default: the words of the sample);
    few rows, so one partition in a fixed order."""
    findings = labelled(sampled) if findings is None else findings
    dictionary = _counted(sampled.select(F.explode("w").alias("word"))) if dictionary is None else dictionary
    transitions = _transitions(dictionary)
    rows = features(findings, dictionary, transitions).select("features", "label", F.xxhash64("candidate", "before", "label").alias("o"))
    rows = stage(rows.orderBy("o").coalesce(1), "secret-training").drop("o")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", maxBins=64, cacheNodeIds=False)
    return Model(forest.fit(rows), dictionary, transitions)


def judge(findings: DataFrame, model: Model) -> DataFrame:
    """``findings`` with probability and secret."""
    scored = model.forest.transform(features(findings, model.dictionary, model.transitions))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(
        *findings.columns, "probability", (F.col("probability") >= 0.5).alias("secret"))


def find(docs: DataFrame, identity: str = "doc_id", text: str = "text", path: str | None = "source", sample: int = SAMPLE,
         model: Model | None = None) -> DataFrame:
    """All candidates: id, word, candidate, before, after, path, probability, secret."""
    found = candidates(docs, identity, text, path)
    if model is None:
        sampled = _sampled(docs, identity, text, sample)
        if sampled.isEmpty():  # no words to train on: nothing is taken for a false positive
            return found.withColumns({"probability": F.lit(1.0), "secret": F.lit(True)}).withColumnRenamed("id", identity)
        model = train(sampled, dictionary=dictionary_of(docs, text))
    found = stage(found, "secret-candidates")  # read twice below; the texts only once
    return judge(found, model).withColumnRenamed("id", identity)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "word", "candidate", "probability", "secret")
