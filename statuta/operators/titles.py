"""Document titles found by a hint: a similarity join by rare words, not a cross join.

Words are content terms: folded, without stop words, numbers and single letters. The score
is .75 of the title's covered share plus .25 of the hint's; a title inside the hint (as
whole words) has 1, or .98 without content terms; a hint of three terms and more inside a
title of its kind of document .93; otherwise a hint covered by less than .75 has at most
.78. A pair that can reach the threshold shares one of the hint's rarest terms (as many as
a covered share of .75 may miss, and one), or the title's rarest; only such pairs are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as tx


# Folded words that say nothing about a title.
STOP = [
    "ban", "cac", "cho", "co", "cua", "duoc", "hanh", "hoac", "kem", "khong", "la", "mau", "mot", "nay", "ngay", "nam", "nhung", "phai", "phu", "quy", "so", "tai", "theo", "thang", "trong", "va", "ve", "voi", "doi", "dinh", "luc",
]
# Folded kinds of documents.
KINDS = ("bo luat", "luat", "nghi dinh", "thong tu", "quyet dinh", "nghi quyet")


def terms(col: Column) -> Column:
    return F.array_distinct(tx.content_terms(col, STOP))


def overlap(query: Column, candidate: Column) -> Column:
    """The score of a candidate text by the terms it shares with a query text; 1 if the
    query holds it whole, 0 where either has no terms."""
    q, c = terms(query), terms(candidate)
    both = F.size(F.array_intersect(q, c))
    inside = tx.boundary_contains(tx.match_key(query), tx.match_key(candidate))
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).when(inside, 1.0).otherwise(0.75 * both / F.size(c) + 0.25 * both / F.size(q))


def _kind(key: Column) -> Column:
    out = F.when(F.startswith(key, F.lit(KINDS[0])), KINDS[0])
    for kind in KINDS[1:]:
        out = out.when(F.startswith(key, F.lit(kind)), kind)
    return out


def resolve(hints: DataFrame, hint: str, titles: DataFrame, key: str, title: str, least: float = 0.82, gap: float = 0.08) -> DataFrame:
    """``hint, key, score``: the best title of each hint, ties by key; none where the second
    best document comes within ``gap``. Null and wordless hints and titles match nothing."""
    sides = lambda df, c, key, own: df.withColumn(key, tx.match_key(F.col(c))).where(F.col(key) != "").withColumn(own, terms(F.col(c)))
    h = sides(hints.select(F.col(hint).alias("hint")).where("hint is not null").distinct(), "hint", "hk", "ht")
    t = sides(titles.select(F.col(key).alias("key"), F.col(title).alias("title")).where("key is not null and title is not null").distinct(), "title", "tk", "tt")
    words = lambda key, own: F.when(F.size(own) > 0, F.col(own)).otherwise(F.array_distinct(F.split(key, " ")))
    tw = t.select("key", "title", "tk", "tt", F.explode(words("tk", "tt")).alias("word"))
    rarity = tw.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("key", "title").orderBy("n", "word")
    rarest = tw.join(rarity, "word").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "n")
    by_title = h.select("hint", "hk", "ht", F.explode(F.array_distinct(F.split("hk", " "))).alias("word")).join(rarest, "word")
    one = h.select("hint", "hk", "ht", F.explode("ht").alias("word")).join(rarity, "word", "left").withColumn("r", F.row_number().over(Window.partitionBy("hint").orderBy(F.coalesce("n", F.lit(0)), "word")))
    may_miss = F.size("ht") - F.ceil(F.size("ht") * 0.75) + 1
    by_hint = one.where(F.col("r") <= may_miss).select("hint", "hk", "ht", "word").join(tw, "word")
    columns = ["hint", "hk", "ht", "key", "title", "tk", "tt"]
    pairs = by_hint.select(*columns).unionByName(by_title.select(*columns)).dropDuplicates(["hint", "key", "title"])
    q, c, hk, tk = F.col("ht"), F.col("tt"), F.col("hk"), F.col("tk")
    both, inside = F.size(F.array_intersect(q, c)), tx.boundary_contains(hk, tk)
    covered = F.try_divide(both, F.size(q))
    base = F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).when(inside, 1.0).otherwise(0.75 * both / F.size(c) + 0.25 * covered)
    same = (F.size(q) >= 3) & tx.boundary_contains(tk, hk) & (_kind(hk) == _kind(tk))
    score = F.when(inside, F.greatest(base, F.lit(0.98))).when(F.coalesce(same, F.lit(False)), F.greatest(base, F.lit(0.93))).when(covered < 0.75, F.least(base, F.lit(0.78))).otherwise(base)
    per = pairs.withColumn("score", F.round(score, 4)).where(F.col("score") >= least).groupBy("hint", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("hint").orderBy(F.desc("score"), "key")
    ranked = per.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    return ranked.where((F.col("r") == 1) & (F.col("second").isNull() | (F.col("second") < F.round(F.col("score") - gap, 6)))).select("hint", "key", "score")
