"""From question to ranked passages in one plan: lexical, dense and graph scores, one hop
over references, weighted fusion.

All questions are answered together, those of the same words once. Passages without text
are neither seeds, targets nor results; ties are ordered by passage id. Branches whose
weight is 0 are never planned; those read twice are written in between, as the plan of all
in one outgrows the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import bm25, dense, dictionary, fusion
from statuta.session import cut

#: Seed weights of the reference branch.
SEEDS = {"bm25": 0.7, "graph": 0.3}


def index_passages(passages: DataFrame) -> DataFrame:
    """Passages with text and ``index_text``, what is searched: number (or id), title, path
    and text on four labelled lines."""
    line = lambda name, value: F.concat(F.lit(name), F.coalesce(value, F.lit("")))
    number = F.coalesce(F.nullif(F.col("document_number"), F.lit("")), F.col("document_id"))
    text = F.concat_ws("\n", line("Van ban: ", number), line("Ten van ban: ", F.col("document_title")), line("Duong dan: ", F.col("path_text")), line("Noi dung: ", F.col("passage_text")))
    return passages.where(F.length(tx.strip(F.coalesce("passage_text", F.lit("")))) > 0).withColumn("index_text", text)


def index_entities(entities: DataFrame) -> DataFrame:
    """Entities with ``index_text``: canonical form, label and aliases."""
    return entities.withColumn("index_text", F.concat_ws(" ; ", F.coalesce("canonical", F.lit("")), F.coalesce("label", F.lit("")), "aliases"))


def exact_entities(queries: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """``q, entity, activation``: entities whose aliases (surface, entity, graph_weight) occur in
    the question, longest first and without overlap, at the weight of the alias. Accents and
    case don't matter."""
    folded = aliases.where("coalesce(match_mode, 'keep') <> 'reject'") if "match_mode" in aliases.columns else aliases
    folded = folded.select(tx.match_key(F.col("surface")).alias("surface"), "entity", F.coalesce("graph_weight", F.lit(1.0)).alias("w")).where("surface <> ''")
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), tx.match_key(F.col(text)).alias("t"))
    hits = dictionary.match(asked, "q", "t", folded, "surface").select("q", "surface").distinct()
    return hits.join(folded, "surface").groupBy("q", "entity").agg(F.max("w").alias("activation"))


def _stacked(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all parts, placed by ``key`` and question. Spark 4.1 takes a union of parts
    that lie by question as lying so itself and groups it without a shuffle; if an exchange
    below is then reused, the union runs as one of unplaced parts, and a question is grouped
    and ranked once per task. No step before places rows by these columns in this order, so
    this shuffle is never left out as a repeated one."""
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).repartition(key, "q")


def activate(exact: DataFrame, near: DataFrame | None = None, hubs: DataFrame | None = None, most: int = 20, least: float = 0.45) -> DataFrame:
    """``q, entity, activation``: exact matches and, of the ``most`` nearest entities of a
    question, those of at least ``least``, weighed down by the weight of hubs; each entity
    at its best, the best ``most`` per question. ``near``: q, entity, similarity; ``hubs``:
    entity, min_graph_weight."""
    rows = exact
    if near is not None:
        close = Window.partitionBy("q").orderBy(F.desc("similarity"), "entity")
        best = near.withColumn("_r", F.row_number().over(close)).where((F.col("_r") <= most) & (F.col("similarity") >= least))
        if hubs is not None:
            best = best.join(hubs.select("entity", "min_graph_weight"), "entity", "left")
        down = F.coalesce(F.nullif(F.col("min_graph_weight"), F.lit(0.0)), F.lit(1.0)) if hubs is not None else F.lit(1.0)
        rows = _stacked([rows, best.select("q", "entity", (F.col("similarity") * down).alias("activation"))], "entity")
    merged = rows.groupBy("q", "entity").agg(F.max("activation").alias("activation"))
    order = Window.partitionBy("q").orderBy(F.desc("activation"), "entity")
    return merged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def graph_scores(activated: DataFrame, links: DataFrame, per_entity: int = 200) -> DataFrame:
    """``q, passage, score``: activation times edge weight, summed over a question's entities;
    of each entity only the ``per_entity`` heaviest links. Several mentions lift a link by a
    tenth each, at most by half. ``links``: entity, passage, weight and mention_count if known."""
    n = F.coalesce("mention_count", F.lit(1)) if "mention_count" in links.columns else F.lit(1)
    used = links.join(activated.select("entity").distinct(), "entity", "left_semi").withColumn("_n", n)
    order = Window.partitionBy("entity").orderBy(F.desc("weight"), F.desc("_n"), "passage")
    heavy = used.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_entity)
    boost = F.least(F.lit(1.5), 1.0 + 0.1 * F.greatest(F.col("_n") - 1, F.lit(0)))
    hit = activated.join(heavy, "entity")
    return hit.groupBy("q", "passage").agg(F.sum(F.col("activation") * F.coalesce("weight", F.lit(1.0)) * boost).alias("score"))


def id_aliases(passages: DataFrame) -> DataFrame:
    """``alias, passage``: every id a passage may be called by: its own, with and without the
    prefix of nodes and the suffix of passages, and that of its unit. Passages with text take
    an alias before placeholders; of several the last by id, of placeholders the first."""
    solid = F.length(tx.strip(F.coalesce("passage_text", F.lit("")))) > 0
    bare = F.regexp_replace(F.regexp_replace("passage_id", r"^passage::?", ""), r"\.passage$", "")
    forms = F.array(F.col("passage_id"), bare, F.concat(bare, F.lit(".passage")), F.concat(F.lit("passage:"), F.col("passage_id")), F.concat(F.lit("passage::"), F.col("passage_id")), F.col("source_unit_id"))
    rows = passages.select("passage_id", solid.alias("_s"), F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))).alias("alias"))
    own = rows.groupBy("alias").agg(F.max(F.when(F.col("_s"), F.col("passage_id"))).alias("a"), F.min(F.when(~F.col("_s"), F.col("passage_id"))).alias("b"))
    return own.select("alias", F.coalesce("a", "b").alias("passage"))


def rewrite_edges(edges: DataFrame, aliases: DataFrame, valid: DataFrame, *ends: str) -> DataFrame:
    """Edges with the named ends rewritten to passage ids; those that lead to no passage with
    text (``valid``: passage) are left out. Repeated edges stay."""
    out = edges
    for end in ends:
        out = out.join(aliases.select(F.col("alias").alias(end), F.col("passage").alias("_p")), end).drop(end).withColumnRenamed("_p", end)
        out = out.join(valid.select(F.col("passage").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def _seed(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    rows = [parts[name].select("q", "passage", (F.col("score") * weight).alias("score")) for name, weight in weights.items() if weight and name in parts]
    return _stacked(rows, "passage").groupBy("q", "passage").agg(F.sum("score").alias("score"))


def retrieve(
    queries: DataFrame, passages: DataFrame, links: DataFrame, references: DataFrame, aliases: DataFrame, weights: dict[str, float], key: str = "question_id", text: str = "question",
    k: int = 10, candidates: int = 300, query_vectors: DataFrame | None = None, passage_vectors: DataFrame | None = None, near: DataFrame | None = None, hubs: DataFrame | None = None, seed_weights: dict[str, float] = SEEDS,
) -> DataFrame:
    """``q, passage, score, dense, bm25, graph, reference, rank``: the best ``k`` passages of
    every question. ``passages``: passage_id, index_text; ``links``: entity, passage, weight;
    ``references``: source, target, weight; ``aliases``: surface, entity, graph_weight. A dense
    weight needs vectors of questions and passages (id, vector)."""
    expands = weights.get("reference", 0) > 0
    needs = lambda c: weights.get(c, 0) > 0 or (expands and seed_weights.get(c, 0) > 0)
    if needs("dense") and (query_vectors is None or passage_vectors is None):
        raise ValueError("a dense weight needs vectors of questions and passages")
    words = F.array_join(F.array_sort(tx.tokens(F.col("index_text"))), " ") if needs("bm25") else F.lit("")
    # numbers in the order of the ids stand for passages until the end
    texted = cut(passages.where("passage_id is not null").select("passage_id", "index_text").sort("passage_id").select(F.col("passage_id").alias("id"), words.alias("bag"), F.monotonically_increasing_id().alias("passage")))
    numbered = lambda df, *ends: reduce(lambda d, end: d.join(texted.select(F.col("id").alias(end), F.col("passage").alias("_p")), end).drop(end).withColumnRenamed("_p", end), ends, df)
    alike = None
    if query_vectors is None and near is None:  # questions of the same words are answered once
        said = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), tx.match_key(F.col(text)).alias("_t")).where("_t <> ''")
        alike = cut(said.groupBy("_t").agg(F.collect_list("_id").alias("_ids")).withColumn("_q", F.monotonically_increasing_id()))
        queries, key, text = alike.select("_q", "_t"), "_q", "_t"
    parts: dict[str, DataFrame] = {}
    if needs("dense"):
        found = dense.cosine_topk(query_vectors, passage_vectors, "id", "vector", candidates)
        parts["dense"] = numbered(found.select(F.col("query_id").alias("q"), F.col("item").alias("passage"), F.col("similarity").alias("score")), "passage")
    if needs("bm25"):
        found = bm25.search_bags(queries, texted.select(F.col("passage").alias("doc"), "bag"), key, text, candidates)
        parts["bm25"] = found.select("q", F.col("doc").alias("passage"), "score")
    if needs("graph"):
        active = activate(exact_entities(queries, key, text, aliases), near, hubs)
        parts["graph"] = graph_scores(active, numbered(links, "passage"), candidates)
    if expands:
        parts = {name: cut(rows) for name, rows in parts.items()}  # read as seeds and as candidates
        edges = numbered(references.select("source", "target", "weight"), "source", "target")
        parts["reference"] = fusion.expand(_seed(parts, seed_weights), edges, "q", "passage", 100).withColumnRenamed("reference", "score")
    names = ("dense", "bm25", "graph", "reference")
    wide = [rows.select("q", "passage", *[(F.col("score") if c == name else F.lit(None).cast("double")).alias(c) for c in names]) for name, rows in parts.items()]
    merged = _stacked(wide, "passage").groupBy("q", "passage").agg(*[F.max(c).alias(c) for c in names])
    norm = fusion.minmax(merged.select("q", "passage", *names), "q", list(names))
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in names}
    lone: Column = (zero["dense"] == 0) & (zero["bm25"] == 0)
    zero["graph"] = F.when(lone, zero["graph"] * 0.65).otherwise(zero["graph"])
    total = sum((zero[c] * weights.get(c, 0.0) for c in names), F.lit(0.0))
    scored = norm.select("q", "passage", total.alias("score"), *[zero[c].alias(c) for c in names]).where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "passage")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if alike is not None:
        ranked = ranked.join(alike.select(F.col("_q").alias("q"), "_ids"), "q").withColumn("q", F.explode("_ids")).drop("_ids")
    return ranked.join(texted.select("passage", "id"), "passage").select("q", F.col("id").alias("passage"), "score", *names, "rank")
