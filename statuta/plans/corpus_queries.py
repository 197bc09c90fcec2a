"""Queries of outlines, legal sentences, events, titles and merged spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import dense as dn
from statuta.operators import events as ev
from statuta.operators import mentions as mn
from statuta.operators import outline as ol
from statuta.operators import splitter as sp
from statuta.operators import rerank as rr
from statuta.operators import titles as ti
from statuta.operators import validity as va
from statuta.operators.corpus import latest
from statuta.plans.text_queries import KEY_SQL
from statuta.session import table


def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as a tree: per line its kind, label, parent line and path."""
    out = ol.outline(ol.lines(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "ord", "unit_type", "label", "parent_ord", "path_text")


def legal_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = latest(table(spark, sf_dir, "units"), "unit_id", keep=["content", "unit_type"]).withColumn("passage_id", F.concat("unit_id", F.lit(".passage")))
    return sp.passages_to_sentences(units, "passage_id", "content", "unit_type")


def validity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts and repeals named in units, repeals dated by their document."""
    units = latest(table(spark, sf_dir, "units"), "unit_id", keep=["content", "document_id"])
    found = ev.extract(units, "unit_id", "content").join(units.select("unit_id", "document_id"), "unit_id")
    return ev.date_repeals(found, "document_id")


def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment titles as hints against the titles of documents."""
    hints = table(spark, sf_dir, "sentences").select("document_title").unionByName(table(spark, sf_dir, "attachments").select(F.col("title").alias("document_title")))
    return ti.resolve(hints, "document_title", table(spark, sf_dir, "documents"), "document_number", "title")


def annex_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for attachments' units of several lines, with the levels of annexes."""
    units = latest(table(spark, sf_dir, "units"), "unit_id", keep=["content", "source_type"]).where("source_type = 'attachment'")
    out = ol.outline(ol.lines(units, "unit_id", "content"), ol.ANNEX_LEVELS, ol.ANNEX_NAMES)
    return out.select(F.col("doc").alias("unit_id"), "ord", "unit_type", "label", "parent_ord", "path_text")


def amendment_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = latest(table(spark, sf_dir, "sentences"), "sentence_id", keep=["context_text", "text"])
    found = mn.amendments(texts.withColumn("whole", F.concat_ws(" ", "context_text", "text")), "sentence_id", "whole")
    return found.groupBy("action", "target").agg(F.countDistinct("sentence_id").alias("n_sentences"))


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = latest(table(spark, sf_dir, "units"), "unit_id", keep=["content", "source_type"]).where("source_type = 'attachment'")
    return mn.form_fields(units, "unit_id", "content").groupBy("label", "filled").agg(F.countDistinct("unit_id").alias("n_units"))


def mined_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a candidate, scored by the others of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    return dn.mine(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", "label", least=-1.0).select("candidate", F.round("score", 4).alias("score"))


def reranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs reranked by whether their document is in force on 2026-01-01: five a question."""
    runs = table(spark, sf_dir, "retrieval_results").where("question_id is not null and passage_id is not null")
    once = runs.groupBy("question_id", "passage_id").agg(F.max("document_id").alias("document_id"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    known = va.register(table(spark, sf_dir, "effectivity_index")).select("document_id", va.active(F.col("valid_from"), F.col("valid_to"), F.lit("2026-01-01").cast("date")).alias("in_force"))
    out = rr.rerank(once.join(known, "document_id", "left"), "question_id", "passage_id", "score", F.col("in_force"), F.lit(0.0), 5)
    return out.select("question_id", "passage_id", F.round("final_score", 4).alias("final_score"), "rank")


QUERIES = {f.__name__: f for f in (document_outline, annex_outline, legal_sentences, validity_events, amendment_mentions, form_fields, title_resolution, mined_candidates, reranked_results)}

def _outline_sql(source: str, key: str, text: str, levels: dict[str, str], names: dict[str, str]) -> str:
    order = list(levels)
    opened = {k: f"({k} IS NOT NULL" + "".join(f" AND ({h} IS NULL OR {h} < {k})" for h in order[:i]) + ")" for i, k in enumerate(order)}
    breaks = r"'\r\n|\r|\n'"
    return f"""WITH l AS (SELECT {key}, ord, line FROM (SELECT {key}, ord, regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS line FROM (SELECT {key}, unnest(string_split_regex({text}, {breaks})) AS line, generate_subscripts(string_split_regex({text}, {breaks}), 1) - 1 AS ord FROM {source} WHERE {text} IS NOT NULL)) WHERE line <> ''),
t AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in levels.items())} END AS kind,
  coalesce({", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in levels.values())}) AS label FROM l),
o AS (SELECT *, {", ".join(f"max(CASE WHEN kind = '{k}' THEN ord END) OVER w AS {k}" for k in order)} FROM t WINDOW w AS (PARTITION BY {key} ORDER BY ord ROWS UNBOUNDED PRECEDING)),
n AS (SELECT {key}, ord, concat_ws(' ', nullif(CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END, ''), label) AS name FROM t WHERE kind IS NOT NULL)
SELECT o.{key}, o.ord::INTEGER AS ord, coalesce(kind, 'text') AS unit_type, o.label, coalesce({", ".join(f"CASE WHEN {opened[k]} AND coalesce(kind, '') <> '{k}' THEN {k} END" for k in reversed(order))})::INTEGER AS parent_ord,
  concat_ws(' > ', {", ".join(f"CASE WHEN {opened[k]} THEN n_{k}.name END" for k in order)}) AS path_text
FROM o {" ".join(f"LEFT JOIN n n_{k} ON n_{k}.{key} = o.{key} AND n_{k}.ord = o.{k}" for k in order)}"""


_ATTACHED = "(SELECT unit_id, content FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ingested_at DESC, content DESC NULLS LAST, source_type DESC NULLS LAST) AS _r FROM units WHERE unit_id IS NOT NULL) WHERE _r = 1 AND source_type = 'attachment')"
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"

_BODY = {
    "phan": r"(?i)^Phần\s+(thứ\s+\p{L}+|[IVXLCDM\d]+)", "chuong": r"(?i)^Chương\s+([IVXLCDM\d]+)", "muc": r"(?i)^Mục\s+(\d+|[IVXLCDM]+)", "tieu_muc": r"(?i)^Tiểu\s*mục\s+(\d+|[IVXLCDM]+)",
    "dieu": r"(?i)^Điều\s+(\d+[a-zA-Z]*)", "khoan": r"^(\d+)\.", "diem": r"(?i)^([a-zđ])\)",
}
_BODY_NAMES = {"phan": "Phần", "chuong": "Chương", "muc": "Mục", "tieu_muc": "Tiểu mục", "dieu": "Điều", "khoan": "Khoản", "diem": "Điểm"}
_ANNEX = {"roman": r"^([IVXLCDM]+)\.\s", "alpha": r"^([A-ZĐ])\.\s", "decimal_1": r"^(\d+)\.\s", "decimal_2": r"^(\d+\.\d+)\.?\s", "decimal_3": r"^(\d+(?:\.\d+){2,})\.?\s", "point": r"^([a-zđ])\)\s*", "bullet": r"^([-–•])\s"}
_ANNEX_NAMES = {"roman": "Mục", "alpha": "Phần", "decimal_1": "", "decimal_2": "", "decimal_3": "", "point": "Điểm", "bullet": ""}
_ACTS = "(sửa đổi|bổ sung|thay thế|bãi bỏ|hủy bỏ|đính chính)[^.;]{0,100}?(điều|khoản|điểm|phụ lục|mẫu số|cụm từ|thông tư|nghị định|quyết định)"
_LINE = r"^([^:\n]{2,80}):\s*(.*)$"
_CONTENT = "list_distinct(list_filter(string_split({0}, ' '), lambda w: len(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('ban','cac','cho','co','cua','duoc','hanh','hoac','kem','khong','la','mau','mot','nay','ngay','nam','nhung','phai','phu','quy','so','tai','theo','thang','trong','va','ve','voi','doi','dinh','luc')))"
_KIND = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{k}') THEN '{k}'" for k in ("bo luat", "luat", "nghi dinh", "thong tu", "quyet dinh", "nghi quyet")) + " END"

SQL = {
    "document_outline": _outline_sql("documents", "doc_id", "text", _BODY, _BODY_NAMES),
    "annex_outline": _outline_sql(_ATTACHED, "unit_id", "content", _ANNEX, _ANNEX_NAMES),
    "amendment_mentions": f"""WITH s AS (SELECT sentence_id, lower(concat_ws(' ', context_text, text)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY ingested_at DESC, context_text DESC NULLS LAST, text DESC NULLS LAST) AS _r FROM sentences WHERE sentence_id IS NOT NULL) WHERE _r = 1),
x AS (SELECT sentence_id, unnest(regexp_extract_all(t, '{_ACTS}', 1)) AS action, unnest(regexp_extract_all(t, '{_ACTS}', 2)) AS target FROM s)
SELECT action, target, count(DISTINCT sentence_id) AS n_sentences FROM x GROUP BY ALL""",
    "form_fields": f"""WITH l AS (SELECT unit_id, regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS line FROM (SELECT unit_id, unnest(string_split_regex(content, '\\r\\n|\\r|\\n')) AS line FROM {_ATTACHED} WHERE content IS NOT NULL)),
f AS (SELECT unit_id, regexp_replace(regexp_extract(line, '{_LINE}', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS label, regexp_replace(regexp_extract(line, '{_LINE}', 2), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS value FROM l WHERE regexp_matches(line, '{_LINE}'))
SELECT label, nullif(regexp_replace(value, '^[.…_\\s-]+$', ''), '') IS NOT NULL AS filled, count(DISTINCT unit_id) AS n_units FROM f GROUP BY ALL""",
    "mined_candidates": """WITH s AS (SELECT q.vec_id AS candidate, v.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY similarity DESC, item) AS r FROM s)
SELECT candidate, round(0.75 * max(similarity) + 0.25 * avg(similarity), 4) AS score FROM r WHERE r <= 10 GROUP BY 1""",
    "reranked_results": """WITH g AS (SELECT document_id,
  min(try_strptime(CASE WHEN lower(trim(effective_from)) IN ('null','none','nan','nat','') THEN NULL ELSE trim(effective_from) END, '%Y-%m-%d')::DATE) AS a,
  min(try_strptime(CASE WHEN lower(trim(effective_to)) IN ('null','none','nan','nat','') THEN NULL ELSE trim(effective_to) END, '%Y-%m-%d')::DATE) AS b FROM effectivity_index WHERE document_id IS NOT NULL GROUP BY 1),
k AS (SELECT document_id, CASE WHEN a IS NULL THEN NULL ELSE a <= DATE '2026-01-01' AND (b IS NULL OR DATE '2026-01-01' < b) END AS ok FROM g),
c AS (SELECT question_id, passage_id, max(document_id) AS document_id, coalesce(max(score), 0.0) AS score FROM retrieval_results WHERE question_id IS NOT NULL AND passage_id IS NOT NULL GROUP BY ALL),
f AS (SELECT question_id, passage_id, score + CASE WHEN ok THEN 2.5 WHEN NOT ok THEN -8 ELSE 0 END AS final_score, coalesce(ok, true) AS keep FROM c LEFT JOIN k USING (document_id)),
e AS (SELECT *, bool_or(keep) OVER (PARTITION BY question_id) AS any_kept FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, passage_id) AS rank FROM e WHERE keep OR NOT any_kept)
SELECT question_id, passage_id, round(final_score, 4) AS final_score, rank FROM r WHERE rank <= 5""",
    "title_resolution": f"""WITH h AS (SELECT hint, hk, {_CONTENT.format('hk')} AS hw FROM (SELECT DISTINCT document_title AS hint, {KEY_SQL('document_title')} AS hk FROM (SELECT document_title FROM sentences UNION ALL SELECT title FROM attachments) WHERE document_title IS NOT NULL) WHERE hk <> ''),
t AS (SELECT key, tk, {_CONTENT.format('tk')} AS tw FROM (SELECT DISTINCT document_number AS key, title, {KEY_SQL('title')} AS tk FROM documents WHERE document_number IS NOT NULL AND title IS NOT NULL) WHERE tk <> ''),
p AS (SELECT hint, key, hk, tk, len(hw) AS nh, CASE WHEN len(tw) > 0 AND len(hw) > 0 THEN len(list_intersect(hw, tw)) * 1.0::DOUBLE / len(tw) ELSE 0 END AS ct, CASE WHEN len(hw) > 0 THEN len(list_intersect(hw, tw)) * 1.0::DOUBLE / len(hw) ELSE 0 END AS ch, len(hw) > 0 AND len(tw) > 0 AS worded FROM h, t),
b AS (SELECT *, CASE WHEN NOT worded THEN 0 WHEN contains(' ' || hk || ' ', ' ' || tk || ' ') THEN 1.0::DOUBLE ELSE 0.75 * ct + 0.25 * ch END AS base FROM p),
s AS (SELECT hint, key, max(round(CASE WHEN contains(' ' || hk || ' ', ' ' || tk || ' ') THEN greatest(base, 0.98) WHEN nh >= 3 AND contains(' ' || tk || ' ', ' ' || hk || ' ') AND {_KIND.format('hk')} = {_KIND.format('tk')} THEN greatest(base, 0.93) WHEN nh > 0 AND ch < 0.75 THEN least(base, 0.78) ELSE base END, 4)) AS score FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM s WHERE score >= 0.82 WINDOW w AS (PARTITION BY hint ORDER BY score DESC, key))
SELECT hint, key, score FROM r WHERE r = 1 AND (second IS NULL OR second < round(score - 0.08, 6))""",
}
