"""Query-dependent reranking with guarded filters, and context blocks for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_filter(df: DataFrame, group: str, keep: Column) -> DataFrame:
    """Rows of a group that pass, or the whole group if none would. Whether any passes is
    aggregated on the map side and joined back."""
    marked = df.withColumn("_passes", F.coalesce(keep, F.lit(False)))
    some = marked.groupBy(group).agg(F.max("_passes").alias("_some"))
    return marked.join(some, group).where(F.col("_passes") | ~F.col("_some")).drop("_passes", "_some").select(*df.columns)


def rerank(df: DataFrame, group: str, item: str, score: str, in_force: Column, domain: Column, k: int, bonus: float = 2.5, malus: float = -8.0, top: int | None = None) -> DataFrame:
    """The score plus the domain adjustment, plus ``bonus`` for documents in force on the
    day asked about and ``malus`` for those that aren't (unknown: neither); documents not
    in force are left out unless that would leave nothing. The best ``k`` per group."""
    adjusted = F.col(score) + F.coalesce(domain, F.lit(0.0)) + F.when(in_force, bonus).when(~in_force, malus).otherwise(0.0)
    rows = df.withColumn("final_score", adjusted).withColumn("_ok", F.coalesce(in_force, F.lit(True)))
    kept = guarded_filter(rows, group, F.col("_ok")).drop("_ok")
    order = Window.partitionBy(group).orderBy(F.desc("final_score"), item)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context(df: DataFrame, group: str, rank: str, title: str, text: str, most: int, longest: int) -> DataFrame:
    """``group, context``: the first ``most`` texts in order as numbered blocks, each cut to
    ``longest`` characters with three dots; blank texts are skipped and don't count."""
    solid = df.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    first = solid.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(rank))).where(F.col("_n") <= most)
    cut = F.when(F.length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest)), F.lit("..."))).otherwise(F.col(text))
    block = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), cut)
    return first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))).alias("_b")).select(group, F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("context"))
