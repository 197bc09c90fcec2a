"""Entity-passage graph: degrees, co-occurrence, reference edges, missing endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base weights of reference kinds, and of kinds that aren't named.
REFERENCE_WEIGHTS = {"point": 1.0, "clause": 0.9, "article": 0.8, "form": 0.75, "appendix": 0.7, "legal_document": 0.5, "document": 0.5, "unknown": 0.5}
OTHER = 0.60


def entity_degree(links: DataFrame) -> DataFrame:
    """``entity, degree, weight``: distinct passages and ln(1 + summed weight) of an entity."""
    return links.groupBy("entity").agg(F.countDistinct("passage").alias("degree"), F.log1p(F.sum("weight")).alias("weight"))


def entity_links(links: DataFrame) -> DataFrame:
    """``passage, entity, weight, sources``: one edge per passage and entity, ln(1 + summed
    weight), with the sorted sources; sums of 0 and less have none."""
    source = F.col("source") if "source" in links.columns else F.lit(None).cast("string")
    merged = links.groupBy("passage", "entity").agg(F.sum("weight").alias("w"), F.array_sort(F.collect_set(source)).alias("sources"))
    return merged.where("w > 0").select("passage", "entity", F.log1p("w").alias("weight"), "sources")


def entity_nodes(links: DataFrame) -> DataFrame:
    """``entity, degree, min_graph_weight, is_hub``: distinct passages, weightless links
    included, and the weight that keeps hubs down."""
    degree = links.groupBy("entity").agg(F.countDistinct("passage").alias("degree"))
    d = F.col("degree")
    weight = F.when(d > 5000, 0.10).when(d > 2000, 0.20).when(d > 800, 0.35).otherwise(1.0)
    return degree.select("entity", "degree", weight.alias("min_graph_weight"), (d > 800).alias("is_hub"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, type, n``: nodes and edges by type."""
    counted = lambda df, part: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "type", "n")
    return counted(nodes, "node").unionByName(counted(edges, "edge"))


def top_degrees(edges: DataFrame, end: str, k: int) -> DataFrame:
    """``id, degree`` of the ``k`` ends with most edges, ties by id."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def cooccurrence(links: DataFrame, most_entities: int | None = None, most_degree: int | None = None, least: float = 0.05) -> DataFrame:
    """``source, target, weight``: pairs of entities of a passage, with ln(1 + sum of the
    smaller weights); weights of 0 and less are left out. All entities and all pairs count
    unless a cap is asked for: ``most_degree`` leaves out entities in more passages before
    pairing, of a passage with more than ``most_entities`` only the heaviest stay. Pairs
    are summed on the map side, so a frequent one is a row per task in the shuffle."""
    merged = links.groupBy("passage", "entity").agg(F.sum("weight").alias("weight"))
    kept = merged.where("weight > 0")
    if most_degree is not None:
        usual = merged.groupBy("entity").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") <= most_degree)
        kept = kept.join(usual.select("entity"), "entity", "left_semi")
    if most_entities is not None:
        order = Window.partitionBy("passage").orderBy(F.desc("weight"), "entity")
        kept = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most_entities)
    gathered = kept.groupBy("passage").agg(F.sort_array(F.collect_list(F.struct("entity", "weight"))).alias("es"))
    # pairs inside the passage's array, without a self-join; one entity's partners at a time
    first = gathered.select("es", F.posexplode("es").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    summed = pairs.groupBy(F.col("a.entity").alias("source"), F.col("b.entity").alias("target")).agg(F.sum(F.least("a.weight", "b.weight")).alias("w"))
    return summed.where(F.col("w") >= least).select("source", "target", F.log1p("w").alias("weight"))


def reference_weight(kind: Column, confidence: Column) -> Column:
    """Base weight of the kind times the confidence clamped to [0, 1]; a null or zero
    confidence counts as 1."""
    base = F.when(F.lit(False), F.lit(0.0))
    for name, weight in REFERENCE_WEIGHTS.items():
        base = base.when(kind == name, weight)
    sure = F.when(confidence.isNull() | (confidence == 0), 1.0).otherwise(confidence)
    return base.otherwise(OTHER) * F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0))


def reference_edges(mentions: DataFrame) -> DataFrame:
    """``source, target, mention_type, raw, weight``: one edge per distinct key, the heaviest."""
    rows = mentions.where("resolution.target_id <> '' and source_unit_id <> ''")
    weight = reference_weight(F.coalesce("mention_type", F.lit("unknown")), F.col("resolution.confidence"))
    return rows.select(F.col("source_unit_id").alias("source"), F.col("resolution.target_id").alias("target"), "mention_type", "raw", weight.alias("weight")).groupBy("source", "target", "mention_type", "raw").agg(F.max("weight").alias("weight"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``id, as_source, as_target``: endpoints that are no node, with how often they occur."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    counted = ends.groupBy("id").agg(F.sum("s").alias("as_source"), F.sum("t").alias("as_target"))
    return counted.join(nodes.select(F.col(node).alias("id")), "id", "left_anti")


def children(units: DataFrame) -> DataFrame:
    """``unit_id, n_children`` of units that are a parent."""
    return units.where("parent_id <> ''").groupBy(F.col("parent_id").alias("unit_id")).agg(F.countDistinct("unit_id").alias("n_children"))
