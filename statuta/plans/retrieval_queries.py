"""Queries of ranked retrieval: BM25, dense, fusion, reference expansion, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import bm25 as bm
from statuta.operators import dense as dn
from statuta.operators import fusion as fu
from statuta.operators import metrics as me
from statuta.operators.corpus import latest, present
from statuta.plans.text_queries import KEY_SQL
from statuta.session import table

# Weights of the hybrid configurations with and without embeddings.
LEXICAL = {"dense": 0.0, "bm25": 0.25, "graph": 0.15, "reference": 0.60}
WEIGHTS = {"dense": 0.25, "bm25": 0.25, "graph": 0.20, "reference": 0.30}
PARTS = list(WEIGHTS)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(latest(table(spark, sf_dir, "units"), "unit_id", keep=["deleted_at", "content"])).where(F.length(F.trim("content")) > 0)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_results").where(F.col("question_id").isNotNull() & F.col("passage_id").isNotNull())
    clean = lambda c: F.when(~F.isnan(f"score_components.{c}"), F.col(f"score_components.{c}"))
    return rows.groupBy("question_id", "passage_id").agg(F.max("document_id").alias("document_id"), *[F.max(clean(c)).alias(c) for c in PARTS])


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _passages(spark, sf_dir)
    out = bm.idf(bm.postings(docs, "unit_id", "content"), bm.corpus_stats(docs, "unit_id", "content"))
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _passages(spark, sf_dir)
    asked = table(spark, sf_dir, "gold_questions").dropDuplicates(["question_id"])
    found = bm.search(asked, docs, "question_id", "question", "unit_id", "content", 10)
    return found.select(F.col("q").alias("question_id"), F.col("doc").alias("unit_id"), F.round("score", 6).alias("score"), "rank")


def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fu.minmax(_candidates(spark, sf_dir), "question_id", PARTS)
    return rows.select("question_id", "passage_id", *[F.round(c, 6).alias(c) for c in PARTS])


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.fuse(_candidates(spark, sf_dir), "question_id", "passage_id", WEIGHTS).where("rank <= 5")
    return out.select("question_id", "passage_id", F.round("score", 6).alias("score"), "rank")


def lexical_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration without embeddings: the dense branch has weight 0."""
    out = fu.fuse(_candidates(spark, sf_dir), "question_id", "passage_id", LEXICAL).where("rank <= 5")
    return out.select("question_id", "passage_id", F.round("score", 6).alias("score"), "rank")


def reference_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _candidates(spark, sf_dir).select("question_id", "passage_id", (F.coalesce("bm25", F.lit(0.0)) * 0.7 + F.coalesce("graph", F.lit(0.0)) * 0.3).alias("score")).where("score > 0")
    mentions = latest(table(spark, sf_dir, "ref_mentions"), "mention_id", keep=["source_unit_id", "resolution"])
    passage = lambda c: F.concat(F.col(c), F.lit(".passage"))
    edges = mentions.where("resolution.status = 'resolved' and coalesce(resolution.target_type, 'unit') = 'unit' and source_unit_id <> ''").select(
        passage("source_unit_id").alias("source"), passage("resolution.target_id").alias("target"), F.coalesce("resolution.confidence", F.lit(1.0)).alias("weight")
    )
    out = fu.expand(seeds, edges, "question_id", "passage_id", 100)
    return out.select("question_id", "passage_id", F.round("reference", 4).alias("reference"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return dn.cosine_topk(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 5).select("query_id", "item", "rank", F.round("similarity", 4).alias("similarity"))


def dense_label_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and label the best similarity of at least .1, labels ranked."""
    vectors = table(spark, sf_dir, "embeddings")
    return dn.activation(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", "label", 0.1).select("query_id", "label", F.round("activation", 4).alias("activation"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall, reciprocal rank and nDCG at 5 of the stored runs, overall, by
    benchmark group and by kind of question."""
    runs = latest(table(spark, sf_dir, "retrieval_results").withColumn("run_key", F.concat_ws("|", "question_id", "passage_id")), "run_key", "retrieved_at", ["question_id", "passage_id", "result_rank", "package_id", "document_id"])
    numbers = latest(table(spark, sf_dir, "units").where(F.col("document_number").isNotNull()), "document_id", keep=["document_number"]).select("document_id", "document_number")
    gold = table(spark, sf_dir, "gold_questions").dropDuplicates(["question_id"])
    per = me.question_metrics(runs.join(numbers, "document_id", "left"), gold, 5)
    return me.grouped(per)


QUERIES = {f.__name__: f for f in (bm25_idf, bm25_topk, minmax_scores, weighted_fusion, lexical_fusion, reference_expand, dense_topk, dense_label_activation, retrieval_metrics)}

_PASSAGES = """u AS (
  SELECT unit_id, content FROM (SELECT unit_id, deleted_at, content, row_number() OVER (PARTITION BY unit_id ORDER BY ingested_at DESC, deleted_at DESC NULLS LAST, content DESC NULLS LAST) AS r FROM units)
  WHERE r = 1 AND deleted_at IS NULL AND length(trim(content)) > 0)"""
_BM25 = f"""WITH {_PASSAGES},
w AS (SELECT unit_id AS doc, list_filter(string_split({KEY_SQL('content')}, ' '), lambda x: x <> '') AS words FROM u),
s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
p AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY ALL),
i AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s)
"""
_CANDIDATES = """c AS (
  SELECT question_id, passage_id, max(document_id) AS document_id, {0}
  FROM retrieval_results WHERE question_id IS NOT NULL AND passage_id IS NOT NULL GROUP BY question_id, passage_id)""".format(
    ", ".join(f"max(CASE WHEN isnan(score_components.{p}) THEN NULL ELSE score_components.{p} END) AS {p}" for p in PARTS)
)
_NORM = "n AS (SELECT question_id, passage_id, " + ", ".join(
    f"CASE WHEN {p} IS NULL THEN NULL WHEN max({p}) OVER w <= min({p}) OVER w THEN 1.0 ELSE ({p} - min({p}) OVER w) / (max({p}) OVER w - min({p}) OVER w) END AS {p}" for p in PARTS
) + " FROM c WINDOW w AS (PARTITION BY question_id))"


def _fusion(weights: dict[str, float]) -> str:
    alone = "CASE WHEN coalesce(dense, 0) = 0 AND coalesce(bm25, 0) = 0 THEN 0.65 ELSE 1.0 END"
    total = " + ".join(f"coalesce({p}, 0) * {w}" + (f" * {alone}" if p == "graph" else "") for p, w in weights.items() if w)
    return f"""WITH {_CANDIDATES}, {_NORM},
f AS (SELECT question_id, passage_id, {total} AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM f WHERE score > 0)
SELECT question_id, passage_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


_VECTORS = """WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS item, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"""

SQL = {
    "bm25_idf": _BM25 + "SELECT term, df, round(idf, 6) AS idf FROM i",
    "bm25_topk": _BM25
    + f""", q AS (SELECT DISTINCT question_id, unnest(string_split({KEY_SQL('question')}, ' ')) AS term FROM gold_questions),
x AS (SELECT question_id, doc, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc) AS rank FROM x)
SELECT question_id, doc AS unit_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "minmax_scores": f"WITH {_CANDIDATES}, {_NORM} SELECT question_id, passage_id, {', '.join(f'round({p}, 6) AS {p}' for p in PARTS)} FROM n",
    "weighted_fusion": _fusion(WEIGHTS),
    "lexical_fusion": _fusion({"dense": 0.0, "bm25": 0.25, "graph": 0.15, "reference": 0.60}),
    "reference_expand": f"""WITH {_CANDIDATES},
s AS (SELECT question_id, passage_id, coalesce(bm25, 0) * 0.7 + coalesce(graph, 0) * 0.3 AS score FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS r FROM s WHERE score > 0),
m AS (SELECT mention_id, max_by({{'s': source_unit_id, 'r': resolution}}, ingested_at) AS x FROM ref_mentions WHERE mention_id IS NOT NULL GROUP BY mention_id),
e AS (SELECT x.s || '.passage' AS source, x.r.target_id || '.passage' AS target, coalesce(x.r.confidence, 1.0) AS weight FROM m WHERE x.r.status = 'resolved' AND coalesce(x.r.target_type, 'unit') = 'unit' AND x.s <> '')
SELECT question_id, target AS passage_id, round(sum(score * weight), 4) AS reference FROM t JOIN e ON e.source = t.passage_id WHERE r <= 100 GROUP BY ALL""",
    "dense_topk": _VECTORS + " SELECT query_id, item, rank, round(similarity, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item) AS rank FROM s) WHERE rank <= 5",
    "dense_label_activation": _VECTORS + " SELECT query_id, label, round(max(similarity), 4) AS activation FROM s WHERE similarity >= 0.1 GROUP BY ALL",
    "retrieval_metrics": """WITH runs AS (
  SELECT question_id, passage_id, result_rank, document_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, passage_id ORDER BY retrieved_at DESC, result_rank DESC) AS r FROM retrieval_results WHERE question_id IS NOT NULL AND passage_id IS NOT NULL) WHERE r = 1),
numbers AS (SELECT document_id, max_by(document_number, ingested_at) AS document_number FROM units WHERE document_number IS NOT NULL AND document_id IS NOT NULL GROUP BY 1),
gold AS (SELECT DISTINCT question_id, benchmark_group, is_multi_reference, gold_doc_numbers FROM gold_questions),
top AS (SELECT r.question_id, r.result_rank AS rank, n.document_number AS doc FROM runs r LEFT JOIN numbers n USING (document_id) WHERE r.result_rank <= 5),
hits AS (SELECT g.question_id, t.doc, min(t.rank) AS rank, count(*) AS places FROM gold g JOIN top t USING (question_id) WHERE list_contains(g.gold_doc_numbers, t.doc) GROUP BY ALL),
per AS (
  SELECT g.question_id, g.benchmark_group, g.is_multi_reference, len(list_distinct(g.gold_doc_numbers)) AS n_gold,
         count(h.doc) AS n_hit, coalesce(sum(h.places), 0) AS places, coalesce(1.0 / min(h.rank), 0) AS rr, coalesce(sum(1.0 / log2(h.rank + 1)), 0) AS dcg
  FROM gold g LEFT JOIN hits h USING (question_id) GROUP BY ALL),
scored AS (
  SELECT *, CASE WHEN n_hit > 0 THEN 1.0 ELSE 0 END AS hit, CASE WHEN n_gold > 0 THEN n_hit * 1.0 / n_gold ELSE 0 END AS recall,
         CASE WHEN n_gold > 0 THEN dcg / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0 END AS ndcg FROM per)
SELECT benchmark_group, is_multi_reference, count(*) AS n_questions, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(places / 5.0::DOUBLE), 6) AS precision, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
FROM scored GROUP BY GROUPING SETS ((), (benchmark_group), (is_multi_reference))""",
}
