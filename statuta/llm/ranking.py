"""One ranking from several differently scaled scores: leximin over percentiles.

Each component becomes the passage's percentile among the passages of its question;
each passage's own percentiles are sorted ascending and the vectors are compared
lexicographically, the larger first, so a strong score can't mask a weak one and no
scale can dominate. Null and NaN mean "not found there" and have percentile 0.
Equal vectors are ordered by passage id. A question with one passage gives it
percentile 0 throughout and rank 1. Copies of a row count once; if copies differ,
the larger value of each component holds. Rows without question or passage id are
left out; an empty table gives no rows; extra columns are not read.

A question may hold any share of all rows: the distinct values with their counts are
ranked on range partitions of (question, component, value), with the counts of the
partitions before added, so no task ever sees a whole hot question or a hot value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.session import cut

COMPONENTS = ("dense", "bm25", "graph", "reference")


def components(df: DataFrame, group: str, item: str, scores: str, names: tuple[str, ...]) -> DataFrame:
    """``q, item`` and one column per component; NaN becomes null, copies are merged."""
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    values = [F.col(f"{scores}.{n}").cast("double") for n in names]
    clean = [F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(values)]
    flat = rows.select(F.col(group).alias("q"), F.col(item).alias("item"), *clean)
    return flat.groupBy("q", "item").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(names))])


def percentiles(scored: DataFrame) -> DataFrame:
    """``q, item, own``: each item's percentiles, ascending. Values are counted on the map
    side first, so a value that a whole question shares is one row; the distinct values are
    ranked in range partitions and joined back to the items (AQE splits frequent ones)."""
    names = [c for c in scored.columns if c not in ("q", "item")]
    melted = scored.select("q", "item", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in names])).alias("s")).select("q", "item", "s.component", "s.value")
    counted = melted.groupBy("q", "component", "value").agg(F.count(F.lit(1)).alias("k"))
    # the partition numbers must not change between the branches that use them; nulls come first
    ranged = cut(counted.repartitionByRange("q", "component", F.col("value").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("part", "q", "component").orderBy(F.col("value").asc_nulls_first())
    inside = ranged.withColumn("below", F.sum("k").over(upto) - F.col("k"))
    sums = ranged.groupBy("q", "component", "part").agg(F.sum("k").alias("k"))
    group = Window.partitionBy("q", "component")
    before = sums.select("q", "component", "part", (F.sum("k").over(group.orderBy("part")) - F.col("k")).alias("offset"), F.sum("k").over(group).alias("n"))
    share = F.when(F.col("n") > 1, (F.col("below") + F.col("offset")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    ranks = inside.where("value is not null").join(before, ["q", "component", "part"]).select("q", "component", "value", share.alias("share"))
    placed = melted.join(ranks, ["q", "component", "value"], "left")
    return placed.groupBy("q", "item").agg(F.sort_array(F.collect_list(F.coalesce("share", F.lit(0.0)))).alias("own"))


def best(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items of each question. The limit is applied before the shuffle
    as well (window group limit), so a hot question sends ``k`` rows per task."""
    order = Window.partitionBy("q").orderBy(F.desc("own"), "item")
    first = ranked.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= k)
    return first.select(F.col("q").alias("question_id"), F.col("fused_rank").cast("bigint").alias("fused_rank"), F.col("item").alias("passage_id"))


def rank_all(ranked: DataFrame) -> DataFrame:
    """Every item's rank; ranks are again counted on range partitions."""
    keyed = ranked.withColumn("worse", F.transform("own", lambda p: -p))
    ranged = cut(keyed.repartitionByRange("q", "worse", "item").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part", "q").orderBy("worse", "item")))
    counts = ranged.groupBy("q", "part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.withColumn("offset", F.sum("k").over(Window.partitionBy("q").orderBy("part")) - F.col("k")).drop("k")
    return inside.join(before, ["q", "part"]).select(F.col("q").alias("question_id"), (F.col("at") + F.col("offset")).cast("bigint").alias("fused_rank"), F.col("item").alias("passage_id"))
