"""Keywords of product descriptions and the products they occur in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.stem import stem
from tillroll.functions.text import tokens

# Words that carry no product information, limits for keywords.
COLOURS = ["pink", "blue", "tag", "green", "orange"]
LEAST_LENGTH = 3
LEAST_COUNT = 13
CLOUD_STOP = ["art", "set", "heart", "pink", "blue", "tag"]
CLOUD_SIZE = 150


def description_words(texts: DataFrame, column: str = "Description",
                      stop_words: DataFrame | None = None) -> DataFrame:
    """Words of the distinct texts, one row per occurrence.

    ``stop_words`` (one column ``word``) takes the place of a part-of-speech filter.
    """
    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    words = distinct.select("text", F.explode(tokens(F.col("text"))).alias("word"))
    return words if stop_words is None else words.join(stop_words.select("word"), "word", "left_anti")


def keyword_inventory(texts: DataFrame, column: str = "Description",
                      stop_words: DataFrame | None = None,
                      root: Callable[[Column], Column] = stem) -> DataFrame:
    """(root, words, keyword, n): words per root, their shortest one, occurrences.

    Occurrences are counted per word first; the words of a root are few, since the suffixes
    bound its spellings.
    """
    per_word = (description_words(texts, column, stop_words).groupBy("word")
                .agg(F.count("*").alias("n")).withColumn("root", root(F.col("word"))))
    return per_word.groupBy("root").agg(
        F.sort_array(F.collect_set("word")).alias("words"),
        F.min_by("word", F.struct(F.length("word"), F.col("word"))).alias("keyword"),
        F.sum("n").alias("n"))


def ranked_keywords(inventory: DataFrame) -> DataFrame:
    return inventory.select("keyword", "n").orderBy(F.desc("n"), "keyword")


def top_keywords(inventory: DataFrame, k: int = 125) -> DataFrame:
    return ranked_keywords(inventory).limit(k)


def useful_keywords(inventory: DataFrame, stop: list[str] = COLOURS, least_length: int = LEAST_LENGTH,
                    least_count: int = LEAST_COUNT) -> DataFrame:
    """Keywords that describe products: no colours, not short, not rare, no + or /."""
    return inventory.where(
        ~F.col("keyword").isin(stop) & (F.length("keyword") >= least_length)
        & (F.col("n") >= least_count) & ~F.col("keyword").rlike("[+/]")).select("keyword", "n")


def keyword_hits(texts: DataFrame, keywords: DataFrame, column: str = "Description") -> DataFrame:
    """(text, keyword) for every keyword that occurs, in upper case, inside a distinct text.

    Containment is an equi join: all substrings of a text that have the length of some
    keyword are joined with the keywords. Neither side is multiplied with the other, and
    Spark broadcasts the keywords only while they are small.
    """
    words = keywords.select("keyword").distinct()
    lengths = [r.n for r in words.select(F.length("keyword").alias("n")).distinct().collect()]
    distinct = texts.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    if not lengths:
        return distinct.select(column, F.lit("").alias("keyword")).limit(0)
    size = F.length(column)

    def pieces(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(n)))

    parts = F.array_distinct(F.concat(*[pieces(n) for n in lengths]))
    return (distinct.select(column, F.explode(parts).alias("part"))
            .join(words.withColumn("part", F.upper("keyword")), "part")
            .select(column, "keyword").distinct())


def cluster_keywords(hits: DataFrame, assigned: DataFrame, column: str = "Description",
                     stop: list[str] = CLOUD_STOP, top: int = CLOUD_SIZE) -> DataFrame:
    """Most frequent keywords of each product cluster."""
    counts = (hits.where(~F.col("keyword").isin(stop)).join(assigned.select(column, "cluster"), column)
              .groupBy("cluster", "keyword").agg(F.count("*").alias("n")))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "keyword")
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
