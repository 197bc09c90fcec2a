"""Sentences to training rows: n-gram candidates, word chunks, disjoint splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(words: Column, low: int, high: int) -> Column:
    """All sequences of ``low`` to ``high`` words, joined by spaces."""
    n = F.size(words)

    def of_length(k: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(n >= k, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_length(k) for k in range(low, high + 1)])


def count_ngrams(df: DataFrame, words: str, low: int, high: int, split: int = 16) -> DataFrame:
    """``ngram, n``: occurrences of every sequence of ``low`` to ``high`` words. What begins
    at one place are prefixes of the window of ``high`` words there, and all share its first
    ``low`` words. So only windows are shuffled, by those, and n-grams are formed and
    counted where they arrive, in ``split`` times the usual partitions: they take several
    times the memory of their windows."""
    n = F.size(words)
    starts = F.when(n >= low, F.sequence(F.lit(1), n - low + 1)).otherwise(F.array().cast("array<int>"))
    windows = df.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(high)), " "))).alias("window"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * split
    placed = windows.select("window", F.substring_index("window", " ", low).alias("head")).repartition(parts, "head")
    length = F.length("window") - F.length(F.replace("window", F.lit(" "))) + 1
    prefixes = F.slice(F.array(*[F.substring_index("window", " ", k) for k in range(low, high + 1)]), F.lit(1), length - low + 1)
    return placed.select("head", F.explode(prefixes).alias("ngram")).groupBy("head", "ngram").agg(F.count(F.lit(1)).alias("n")).select("ngram", "n")


def word_chunks(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that share ``overlap``; the last may be shorter; no words, no chunk."""
    n = F.size(words)
    step = size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step) - 1))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, (i * step + 1).cast("int"), F.lit(size)), " "))


def split(df: DataFrame, document: str, test: float = 0.1, dev: float = 0.1) -> DataFrame:
    """``document, n_rows, part``: whole documents in hash order fill test, then dev, then
    train, by rows. The running total is taken over per-document counts in 256 hash
    buckets: bucket totals first, then within buckets, so no task sorts all documents."""
    sizes = df.where(F.col(document).isNotNull()).groupBy(document).agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = sizes.withColumn("h", F.md5(F.col(document).cast("string"))).withColumn("bucket", F.substring("h", 1, 2))
    buckets = keyed.groupBy("bucket").agg(F.sum("n_rows").alias("b"))
    order = Window.orderBy("bucket")  # over at most 256 rows
    before = buckets.select("bucket", (F.sum("b").over(order) - F.col("b")).alias("offset"), F.sum("b").over(Window.partitionBy()).alias("total"))
    placed = keyed.join(F.broadcast(before), "bucket")
    until = F.sum("n_rows").over(Window.partitionBy("bucket").orderBy("h", document)) + F.col("offset")
    part = F.when(until <= F.col("total") * test, "test").when(until <= F.col("total") * (test + dev), "dev").otherwise("train")
    return placed.withColumn("part", part).select(document, "n_rows", "part")
