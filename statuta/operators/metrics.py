"""Retrieval and recognition metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def question_metrics(runs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per question hit, recall, reciprocal rank and nDCG at k over gold documents; each
    document counts once, at its best rank. ``precision`` is the share of the first k places
    whose passage is of a gold document (places left empty count too). Questions without
    gold or results score 0."""
    asked = gold.select("question_id", "benchmark_group", "is_multi_reference", F.array_distinct("gold_doc_numbers").alias("golds"))
    top = runs.where(F.col("result_rank") <= k).select("question_id", F.col("result_rank").alias("rank"), F.col("document_number").alias("doc"))
    hits = asked.join(top, "question_id").where(F.array_contains("golds", F.col("doc"))).groupBy("question_id", "doc").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("places"))
    sums = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_hit"), F.sum("places").alias("places"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    size = F.coalesce(F.size("golds"), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(size, F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = asked.join(sums, "question_id", "left")
    return out.select(
        "question_id", "benchmark_group", "is_multi_reference",
        F.when(F.col("n_hit") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(size > 0, F.coalesce("n_hit", F.lit(0)) / size).otherwise(0.0).alias("recall"),
        (F.coalesce("places", F.lit(0)) / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(size > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def grouped(per: DataFrame) -> DataFrame:
    """Means overall, by benchmark group and by single or multiple reference."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "precision", "mrr", "ndcg")]
    return per.groupingSets([[], [F.col("benchmark_group")], [F.col("is_multi_reference")]], "benchmark_group", "is_multi_reference").agg(F.count(F.lit(1)).alias("n_questions"), *means)


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def set_prf(predicted: DataFrame, gold: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``label, tp, fp, fn, precision, recall, f1`` of two sets of spans, per label."""
    p = predicted.select(*keys, label).distinct().withColumn("in_pred", F.lit(1))
    g = gold.select(*keys, label).distinct().withColumn("in_gold", F.lit(1))
    both = p.join(g, [*keys, label], "full")
    c = both.groupBy(label).agg(F.count_if(F.col("in_pred").isNotNull() & F.col("in_gold").isNotNull()).alias("tp"), F.count_if(F.col("in_gold").isNull()).alias("fp"), F.count_if(F.col("in_pred").isNull()).alias("fn"))
    precision, recall = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(label, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(safe_divide(2 * precision * recall, precision + recall), 6).alias("f1"))


def micro(counts: DataFrame) -> DataFrame:
    """One row: the totals of ``tp, fp, fn`` over all labels and their measures."""
    total = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    precision, recall = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(safe_divide(2 * precision * recall, precision + recall), 6).alias("f1"))
