"""Min-max normalisation, weighted fusion and one-hop expansion of candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """``df`` with every value rescaled inside its group: the weakest becomes 0, the
    strongest 1, a constant group 1; null stays null. The bounds are aggregated on the map
    side and joined back, so a group that holds a third of all rows is never in one task."""
    bounds = df.groupBy(group).agg(*[f(c).alias(f"_{n}_{c}") for c in values for n, f in (("low", F.min), ("high", F.max))])
    both = df.join(bounds, group)

    def scaled(c: str) -> Column:
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        return F.when(F.col(c).isNull(), None).when(high <= low, 1.0).otherwise((F.col(c) - low) / (high - low))

    return both.select(*[scaled(c).alias(c) if c in values else F.col(c) for c in df.columns])


def fuse(candidates: DataFrame, group: str, item: str, weights: dict[str, float], graph_only_penalty: float = 0.65) -> DataFrame:
    """``group, item, score, rank``: weighted sum of min-max scores. The graph score of a
    candidate whose normalised dense and lexical scores are both 0 is multiplied by the
    penalty; scores of 0 and less are dropped; ties are ordered by item. Components of
    weight 0 are never read."""
    used = {c: w for c, w in weights.items() if w}
    columns = list(dict.fromkeys([*used, "dense", "bm25"]))
    norm = minmax(candidates.select(group, item, *columns), group, columns)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    only_graph = (zero("dense") == 0) & (zero("bm25") == 0)
    part = lambda c: F.when(only_graph, zero(c) * graph_only_penalty).otherwise(zero(c)) if c == "graph" else zero(c)
    total = sum((part(c) * w for c, w in used.items()), F.lit(0.0))
    scored = norm.select(group, item, total.alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), item)))


def expand(seeds: DataFrame, edges: DataFrame, group: str, item: str, n_seeds: int = 100, decay: float = 1.0) -> DataFrame:
    """``group, item, reference``: scores of the best ``n_seeds`` items of a group handed
    over one reference edge (source, target, weight); several edges add up."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), item)
    best = seeds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_seeds)
    hop = best.join(edges.select(F.col("source").alias(item), F.col("target"), F.col("weight")), item)
    return hop.groupBy(group, F.col("target").alias(item)).agg(F.sum(F.col("score") * decay * F.col("weight")).alias("reference"))
