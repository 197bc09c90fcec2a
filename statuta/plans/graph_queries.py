"""Queries of citations, vocabulary, graph, validity and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import datasets as ds
from statuta.operators import dictionary as dic
from statuta.operators import graph as gr
from statuta.operators import mentions as mn
from statuta.operators import metrics as me
from statuta.operators import validity as va
from statuta.operators.corpus import latest
from statuta.plans.text_queries import KEY_SQL
from statuta.session import table


def _units(spark, sf_dir, *keep):
    return latest(table(spark, sf_dir, "units"), "unit_id", keep=list(keep))


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "ref_mentions").where(F.col("mention_id").isNotNull()).dropDuplicates(["mention_id"])


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mn.extract(_units(spark, sf_dir, "content"), "unit_id", "content")
    return found.groupBy("unit_id", "mention_type", "label").agg(F.count(F.lit(1)).alias("n"))


def citation_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted citations against the stored mentions, per kind."""
    found = mn.extract(_units(spark, sf_dir, "content"), "unit_id", "content")
    stored = _mentions(spark, sf_dir).where("source_unit_id <> ''").select(F.col("source_unit_id").alias("unit_id"), "label", "mention_type")
    return me.set_prf(found, stored, ["unit_id", "label"], "mention_type")


def mention_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.dedupe(_mentions(spark, sf_dir), "document_id")


def article_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir, "document_id", "path_text", "unit_type")
    return mn.resolve_articles(_mentions(spark, sf_dir), units)


def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of every type against documents, attachments and units."""
    units = _units(spark, sf_dir, "document_id", "path_text", "unit_type")
    attachments = latest(table(spark, sf_dir, "attachments"), "attachment_id", keep=["package_id", "attachment_kind", "label", "title", "source_file"])
    return mn.resolve(_mentions(spark, sf_dir), units, attachments, table(spark, sf_dir, "effectivity_index"))


def resolver_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mentions(spark, sf_dir).select("package_id", F.coalesce("resolution.status", F.lit("UNKNOWN")).alias("status"), "mention_type")
    return rows.groupingSets([[], [F.col("status")], [F.col("mention_type")], [F.col("package_id"), F.col("status")]], "package_id", "status", "mention_type").agg(F.count(F.lit(1)).alias("n"))


def surface_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.vocabulary(_mentions(spark, sf_dir))


def canonical_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entities: aliases of one label and compact key, summed."""
    rows = mn.vocabulary(_mentions(spark, sf_dir)).select("entity_label", F.replace("surface_key", F.lit(" ")).alias("canonical"), "surface", "n", "status")
    return rows.groupBy("entity_label", "canonical").agg(F.array_join(F.sort_array(F.collect_set("surface")), "|").alias("aliases"), F.sum("n").alias("n"), F.bool_or(F.col("status") == "accept").alias("accepted"))


def _links(spark, sf_dir, units=None):
    found = mn.extract(_units(spark, sf_dir, "content") if units is None else units, "unit_id", "content").where("label <> 'này'")
    return found.select(F.col("unit_id").alias("passage"), F.concat_ws(":", "mention_type", "label").alias("entity"), F.lit(1.0).alias("weight"))


def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.entity_degree(_links(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.cooccurrence(_links(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.reference_edges(_mentions(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def missing_endpoint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.missing_endpoints(gr.reference_edges(_mentions(spark, sf_dir)), table(spark, sf_dir, "units"), "unit_id")


def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.children(_units(spark, sf_dir, "parent_id"))


def document_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.register(table(spark, sf_dir, "effectivity_index"))


def units_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the units that are there, and whether it is in force on 2026-01-01."""
    units = _units(spark, sf_dir, "document_id", "deleted_at").where("deleted_at is null and document_id is not null")
    counted = units.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_units"))
    known = va.register(table(spark, sf_dir, "effectivity_index"))
    in_force = va.active(F.col("valid_from"), F.col("valid_to"), F.lit("2026-01-01").cast("date"))
    return counted.join(known, "document_id", "left").select("document_id", "n_units", in_force.alias("in_force"))


def best_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the start that most of its sentences carry, ties: the earliest."""
    rows = latest(table(spark, sf_dir, "sentences"), "sentence_id", keep=["document_id", "effective_from"])
    votes = rows.where("document_id is not null").groupBy("document_id", F.to_date(tx.none_if_null(F.col("effective_from"))).alias("starts")).agg(F.count(F.lit(1)).alias("votes"))
    return va.best_dates(votes, "document_id", "votes", "starts")


def passage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage rows: unit, attachment and outgoing references joined, per passage."""
    units = _units(spark, sf_dir, "package_id", "attachment_id", "content", "unit_type").where("length(trim(content)) > 0")
    kinds = latest(table(spark, sf_dir, "attachments"), "attachment_id", keep=["attachment_kind"]).select("attachment_id", "attachment_kind")
    out = gr.reference_edges(_mentions(spark, sf_dir)).groupBy(F.col("source").alias("unit_id")).agg(F.count(F.lit(1)).alias("outgoing"))
    return units.join(kinds, "attachment_id", "left").join(out, "unit_id", "left").select(F.concat("unit_id", F.lit(".passage")).alias("passage_id"), "package_id", "unit_type", "attachment_kind", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.md5("content").alias("content_hash"))


def sentence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sentences").dropDuplicates(["sentence_id"])
    return rows.rollup("package_id", "unit_type").agg(F.count(F.lit(1)).alias("n_sentences"), F.countDistinct("passage_id").alias("n_passages"))


def unit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir, "package_id", "unit_type", "source_type")
    return rows.groupingSets([[], [F.col("unit_type")], [F.col("source_type"), F.col("unit_type")], [F.col("package_id")]], "package_id", "source_type", "unit_type").agg(F.count(F.lit(1)).alias("n_units"))


def document_number_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy dictionary matches, in units, of the document numbers that mentions name."""
    units = _units(spark, sf_dir, "content")
    found = dic.match(units, "unit_id", "content", table(spark, sf_dir, "ref_mentions").where("mention_type = 'document'"), "label")
    return found.groupBy("surface").agg(F.countDistinct("unit_id").alias("n_units"), F.count(F.lit(1)).alias("n"))


def unsplit_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with text that have no stored sentence (the work list of a resumed run)."""
    units = _units(spark, sf_dir, "content").where("length(trim(content)) > 0").select("unit_id")
    return units.join(table(spark, sf_dir, "sentences").select(F.col("source_unit_id").alias("unit_id")), "unit_id", "left_anti")


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers of the register and of the corpus side by side."""
    a = table(spark, sf_dir, "effectivity_index").where("document_number is not null").select("document_number").distinct().withColumn("registered", F.lit(True))
    b = table(spark, sf_dir, "documents").where("document_number is not null").groupBy("document_number").agg(F.count(F.lit(1)).alias("n_documents"))
    return a.join(b, "document_number", "full").select("document_number", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gold_questions").dropDuplicates(["question_id"])
    grams = rows.select("question_id", F.explode(F.array_distinct(ds.ngrams(tx.tokens(F.col("question")), 2, 4))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n_questions")).where("n_questions > 1")


def sentence_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate mining over the corpus: all sequences of 2 to 14 words of all sentences."""
    rows = latest(table(spark, sf_dir, "sentences"), "sentence_id", keep=["text"])
    return ds.count_ngrams(rows.select(tx.tokens(F.col("text")).alias("words")), "words", 2, 14)


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ds.word_chunks(tx.tokens(F.col("text")), 220, 40)).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_hash"))


def disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.split(table(spark, sf_dir, "sentences"), "document_id")


def hybrid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and extracted citations merged: where they agree and where only one has it."""
    stored = _mentions(spark, sf_dir).where("source_unit_id <> ''").select(F.col("source_unit_id").alias("unit_id"), "mention_type", "label").distinct().withColumn("s", F.lit(1))
    found = mn.extract(_units(spark, sf_dir, "content"), "unit_id", "content").distinct().withColumn("f", F.lit(1))
    both = stored.join(found, ["unit_id", "mention_type", "label"], "full")
    source = F.when(F.col("s").isNull(), "extracted").when(F.col("f").isNull(), "stored").otherwise("both")
    return both.groupBy("mention_type", source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        citation_extract, citation_prf, mention_dedup, article_resolution, reference_resolution, resolver_summary, surface_vocabulary, canonical_rollup, entity_degree, cooccurrence_edges, reference_edges, missing_endpoint_nodes, child_counts,
        document_register, units_in_force, best_start, passage_sources, sentence_rollup, unit_summary, document_number_matches, unsplit_units, merged_sources, ngram_candidates, sentence_ngrams, chunked_documents, disjoint_split, hybrid_spans,
    )
}


def _latest(name: str, key: str, *keep: str) -> str:
    order = "ingested_at DESC" + "".join(f", {c} DESC NULLS LAST" for c in keep)
    return f"(SELECT {key}, {', '.join(keep)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _r FROM {name} WHERE {key} IS NOT NULL) WHERE _r = 1)"


_M = "m AS (SELECT DISTINCT ON (mention_id) * FROM ref_mentions WHERE mention_id IS NOT NULL)"
# every character between words is doubled, so that each side of it can be matched once
_WORDY = r"[^\p{L}\p{N}_]"


def _cited() -> str:
    first, last = rf"(^|{_WORDY})", rf"(?:$|{_WORDY})"
    both = r"(?:\s*,,\s*|\s+(?:và|hoặc)\s+)"
    lists = {"article": (r"[ĐđD]iều", r"\d+[a-zA-Z]?"), "clause": (r"[Kk]hoản", r"\d+"), "point": (r"[ĐđD]iểm", r"[a-zđ]\d*")}
    numeral = "[IVXLCDM]+"
    single = {
        "article": r"[ĐđD]iều\s+(\d+[a-zA-Z]?|này)", "clause": r"[Kk]hoản\s+(\d+|này)", "point": r"[ĐđD]iểm\s+([a-zđ]\d*|này)", "chapter": rf"[Cc]hương\s+({numeral}|\d+|này)", "section": rf"[Mm]ục\s+({numeral}|\d+|này)",
        "appendix": rf"[Pp]hụ\s+[Ll]ục\s+({numeral}[A-Z]?|\d+[A-Z]?|[A-Z]+)", "form": r"[Mm]ẫu\s+(?:số\s+)?(\d{1,3}[A-Za-zĐđ]?(?:[._/-]{2}\d+)*)",
    }
    parts = [rf"u AS {_latest('units', 'unit_id', 'content')}", rf"d AS (SELECT unit_id, regexp_replace(content, '({_WORDY})', '\1\1', 'g') AS t FROM u)"]
    rows = []
    for kind, pattern in single.items():
        text = "t"
        if kind in lists:
            word, label = lists[kind]
            many = rf"(?i){first}({word}\s+{label}(?:{both}(?:{word}\s+)?{label})+)"
            parts.append(rf"l_{kind} AS (SELECT unit_id, unnest(list_distinct(regexp_extract_all(replace(lower(m), 'điểm', '##'), '(?i)(?:^|{_WORDY}|#)({label})(?:$|{_WORDY})', 1))) AS label FROM (SELECT unit_id, regexp_replace(unnest(regexp_extract_all(t, '{many}', 2)), '({_WORDY})', '\1\1', 'g') AS m FROM d))")
            rows.append(f"SELECT unit_id, '{kind}' AS mention_type, label FROM l_{kind}")
            text = rf"regexp_replace(t, '{many}', '\1 ', 'g')"
        rows.append(rf"SELECT unit_id, '{kind}', replace(replace(unnest(regexp_extract_all({text}, '(?:^|{_WORDY}){pattern}{last}', 1)), '--', '-'), '..', '.') FROM d")
    rows.append(rf"SELECT unit_id, 'document', replace(replace(unnest(regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}/])(\d+//\d{{4}}//[A-ZĐ]+\d*(?:--[A-ZĐ0-9]+)*)(?:$|[^\p{{L}}\p{{N}}])', 1)), '//', '/'), '--', '-') FROM d")
    whole = ",\n".join(parts) + ",\nx AS (" + "\nUNION ALL ".join(rows) + ")"
    return whole.replace("\\s", "[\\s\\p{Z}]").replace("\\d", "\\p{Nd}")  # as other scripts' digits and spaces count


_EXTRACT = _cited()
_SURFACE = r"""trim(regexp_replace(lower(trim(regexp_replace(surface, '[\s\p{Z}]+', ' ', 'g'))), '^["''“”‘’(\[{]+|["''“”‘’)\]};:,.]+$', '', 'g'))"""
_VOCAB = f"""r AS (SELECT * FROM (SELECT {KEY_SQL('raw')} AS surface_key, mention_type AS entity_label, raw, document_id, coalesce(occurrence_count, 1) AS k FROM m) WHERE surface_key <> ''),
s AS (SELECT surface_key, entity_label, raw, sum(k) AS k FROM r GROUP BY ALL),
t AS (SELECT surface_key, entity_label, sum(k) AS n, arg_min(raw, {{'o': -k, 'raw': raw}}) AS surface FROM s GROUP BY ALL),
d AS (SELECT surface_key, entity_label, count(DISTINCT document_id) AS n_documents FROM r GROUP BY ALL),
l AS (SELECT surface_key, count(DISTINCT entity_label) AS n_labels FROM r GROUP BY ALL),
v AS (SELECT surface_key, entity_label, n::BIGINT AS n, n_documents, surface, n_labels,
  CASE WHEN regexp_matches({_SURFACE}, '(?i)^(điều\\s+\\d+[a-z]?|khoản\\s+\\d+|điểm\\s+[a-zđ]|phụ\\s+lục\\s+([ivxlcdm]+|\\d+|[a-z])|mẫu\\s+(số\\s+)?[0-9a-z_./-]+|chương\\s+([ivxlcdm]+|\\d+)|mục\\s+([ivxlcdm]+|\\d+)|qcvn\\s+.+|\\d+/\\d{{4}}/[a-zđ]+.*|(thông tư|nghị định|luật|quyết định|nghị quyết)\\s+(này|số\\s+.+))$') OR length({_SURFACE}) <= 2 OR regexp_matches({_SURFACE}, '^[0-9]+$') THEN 'reject' WHEN n_labels > 1 THEN 'conflict' WHEN n >= 3 THEN 'accept' ELSE 'review' END AS status
  FROM t JOIN d USING (surface_key, entity_label) JOIN l USING (surface_key))"""
_LINKS = _EXTRACT + ",\nk AS (SELECT unit_id AS passage, mention_type || ':' || label AS entity, 1.0 AS weight FROM x WHERE label <> 'này')"
_WEIGHT = "CASE coalesce(mention_type, 'unknown') WHEN 'point' THEN 1.0 WHEN 'clause' THEN 0.9 WHEN 'article' THEN 0.8 WHEN 'form' THEN 0.75 WHEN 'appendix' THEN 0.7 WHEN 'legal_document' THEN 0.5 WHEN 'document' THEN 0.5 WHEN 'unknown' THEN 0.5 ELSE 0.6 END * least(greatest(CASE WHEN resolution.confidence IS NULL OR resolution.confidence = 0 THEN 1.0 ELSE resolution.confidence END, 0.0), 1.0)"
_EDGES = f"e AS (SELECT source_unit_id AS source, resolution.target_id AS target, mention_type, raw, max({_WEIGHT}) AS weight FROM m WHERE resolution.target_id <> '' AND source_unit_id <> '' GROUP BY ALL)"
_REGISTER = """g AS (SELECT document_id, max(document_number) AS document_number,
  min(try_strptime(CASE WHEN lower(trim(effective_from)) IN ('null','none','nan','nat','') THEN NULL ELSE trim(effective_from) END, '%Y-%m-%d')::DATE) AS valid_from,
  min(try_strptime(CASE WHEN lower(trim(effective_to)) IN ('null','none','nan','nat','') THEN NULL ELSE trim(effective_to) END, '%Y-%m-%d')::DATE) AS valid_to,
  max(CASE WHEN lower(trim(in_corpus)) IN ('true','t','yes','y','1') THEN true WHEN lower(trim(in_corpus)) IN ('false','f','no','n','0') THEN false END) AS in_corpus
  FROM effectivity_index WHERE document_id IS NOT NULL GROUP BY 1)"""
_WORDS = f"SELECT question_id, list_filter(string_split({KEY_SQL('question')}, ' '), lambda w: w <> '') AS w FROM (SELECT DISTINCT question_id, question FROM gold_questions)"

SQL = {
    "citation_extract": f"WITH {_EXTRACT} SELECT unit_id, mention_type, label, count(*) AS n FROM x GROUP BY ALL",
    "citation_prf": f"""WITH {_EXTRACT}, {_M},
p AS (SELECT DISTINCT unit_id, label, mention_type, 1 AS a FROM x), g AS (SELECT DISTINCT source_unit_id AS unit_id, label, mention_type, 1 AS b FROM m WHERE source_unit_id <> ''),
c AS (SELECT coalesce(p.mention_type, g.mention_type) AS mention_type, count_if(a = 1 AND b = 1) AS tp, count_if(b IS NULL) AS fp, count_if(a IS NULL) AS fn FROM p FULL JOIN g ON p.unit_id = g.unit_id AND p.label = g.label AND p.mention_type = g.mention_type GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) ELSE 0 END AS r FROM c)
SELECT mention_type, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""",
    "mention_dedup": f"""WITH {_M} SELECT document_id, mention_type, lower(coalesce(nullif(trim(label), ''), raw, '')) AS label_key, sum(coalesce(occurrence_count, 1))::BIGINT AS occurrences,
        count(DISTINCT source_unit_id) AS n_units, count(DISTINCT raw) AS n_raws, min(raw) AS first_raw FROM m GROUP BY ALL""",
    "article_resolution": f"""WITH {_M}, a AS (SELECT document_id, nullif(regexp_extract(path_text, '(?:^|> )Điều ([^ >]+)', 1), '') AS label, count(DISTINCT unit_id) AS n FROM {_latest('units', 'unit_id', 'document_id', 'path_text', 'unit_type')} WHERE unit_type = 'dieu' GROUP BY ALL)
        SELECT mention_id, coalesce(n, 0) AS n_targets, CASE WHEN coalesce(n, 0) = 1 THEN 'resolved' WHEN coalesce(n, 0) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
        FROM m LEFT JOIN a ON a.document_id = m.document_id AND a.label = m.label WHERE mention_type = 'article'""",
    "resolver_summary": f"WITH {_M}, r AS (SELECT package_id, coalesce(resolution.status, 'UNKNOWN') AS status, mention_type FROM m) SELECT package_id, status, mention_type, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (status), (mention_type), (package_id, status))",
    "surface_vocabulary": f"WITH {_M}, {_VOCAB} SELECT * FROM v",
    "canonical_rollup": f"WITH {_M}, {_VOCAB} SELECT entity_label, replace(surface_key, ' ', '') AS canonical, string_agg(DISTINCT surface, '|' ORDER BY surface) AS aliases, sum(n)::BIGINT AS n, bool_or(status = 'accept') AS accepted FROM v GROUP BY ALL",
    "entity_degree": f"WITH {_LINKS} SELECT entity, count(DISTINCT passage) AS degree, round(ln(1 + sum(weight)::DOUBLE), 6) AS weight FROM k GROUP BY 1",
    "cooccurrence_edges": f"""WITH {_LINKS}, g AS (SELECT passage, entity, sum(weight)::DOUBLE AS weight FROM k GROUP BY ALL),
h AS (SELECT entity FROM g GROUP BY 1 HAVING count(*) <= 2500),
t AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY weight DESC, entity) AS r FROM g WHERE weight > 0 AND entity IN (SELECT entity FROM h)),
p AS (SELECT a.entity AS source, b.entity AS target, sum(least(a.weight, b.weight)) AS w FROM t a JOIN t b ON a.passage = b.passage AND a.entity < b.entity WHERE a.r <= 40 AND b.r <= 40 GROUP BY ALL)
SELECT source, target, round(ln(1 + w), 6) AS weight FROM p WHERE w >= 0.05""",
    "reference_edges": f"WITH {_M}, {_EDGES} SELECT source, target, mention_type, raw, round(weight::DOUBLE, 6) AS weight FROM e",
    "missing_endpoint_nodes": f"""WITH {_M}, {_EDGES}, n AS (SELECT source AS id, 1 AS s, 0 AS t FROM e UNION ALL SELECT target, 0, 1 FROM e)
        SELECT id, sum(s)::BIGINT AS as_source, sum(t)::BIGINT AS as_target FROM n WHERE id NOT IN (SELECT unit_id FROM units WHERE unit_id IS NOT NULL) GROUP BY 1""",
    "child_counts": f"SELECT parent_id AS unit_id, count(DISTINCT unit_id) AS n_children FROM {_latest('units', 'unit_id', 'parent_id')} WHERE parent_id <> '' GROUP BY 1",
    "document_register": f"WITH {_REGISTER} SELECT * FROM g",
    "units_in_force": f"""WITH {_REGISTER}, c AS (SELECT document_id, count(*) AS n_units FROM {_latest('units', 'unit_id', 'document_id', 'deleted_at')} WHERE deleted_at IS NULL AND document_id IS NOT NULL GROUP BY 1)
        SELECT c.document_id, n_units, CASE WHEN valid_from IS NULL THEN NULL ELSE valid_from <= DATE '2026-01-01' AND (valid_to IS NULL OR DATE '2026-01-01' < valid_to) END AS in_force FROM c LEFT JOIN g USING (document_id)""",
    "best_start": f"""WITH v AS (SELECT document_id, CASE WHEN lower(trim(effective_from)) IN ('null','none','nan','nat','') THEN NULL ELSE trim(effective_from) END::DATE AS starts, count(*) AS votes FROM {_latest('sentences', 'sentence_id', 'document_id', 'effective_from')} WHERE document_id IS NOT NULL GROUP BY ALL)
        SELECT document_id, starts, votes FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY votes DESC, starts) AS r FROM v WHERE starts IS NOT NULL) WHERE r = 1""",
    "passage_sources": f"""WITH {_M}, {_EDGES}, o AS (SELECT source AS unit_id, count(*) AS outgoing FROM e GROUP BY 1), u AS {_latest('units', 'unit_id', 'package_id', 'attachment_id', 'content', 'unit_type')}, a AS {_latest('attachments', 'attachment_id', 'attachment_kind')}
        SELECT u.unit_id || '.passage' AS passage_id, package_id, unit_type, attachment_kind, coalesce(outgoing, 0) AS outgoing, md5(content) AS content_hash FROM u LEFT JOIN a USING (attachment_id) LEFT JOIN o USING (unit_id) WHERE length(trim(content)) > 0""",
    "sentence_rollup": "SELECT package_id, unit_type, count(*) AS n_sentences, count(DISTINCT passage_id) AS n_passages FROM (SELECT DISTINCT ON (sentence_id) * FROM sentences) GROUP BY ROLLUP (package_id, unit_type)",
    "unit_summary": f"SELECT package_id, source_type, unit_type, count(*) AS n_units FROM {_latest('units', 'unit_id', 'package_id', 'unit_type', 'source_type')} GROUP BY GROUPING SETS ((), (unit_type), (source_type, unit_type), (package_id))",
    "unsplit_units": f"SELECT unit_id FROM {_latest('units', 'unit_id', 'content')} WHERE length(trim(content)) > 0 AND unit_id NOT IN (SELECT source_unit_id FROM sentences WHERE source_unit_id IS NOT NULL)",
    "merged_sources": """WITH a AS (SELECT DISTINCT document_number FROM effectivity_index WHERE document_number IS NOT NULL), b AS (SELECT document_number, count(*) AS n FROM documents WHERE document_number IS NOT NULL GROUP BY 1)
        SELECT coalesce(a.document_number, b.document_number) AS document_number, a.document_number IS NOT NULL AS registered, coalesce(n, 0) AS n_documents FROM a FULL JOIN b ON a.document_number = b.document_number""",
    "ngram_candidates": f"""WITH q AS ({_WORDS}), g AS (SELECT DISTINCT question_id, array_to_string(w[i:i + k - 1], ' ') AS ngram FROM (SELECT question_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q, (VALUES (2), (3), (4)) t(k)))
        SELECT ngram, count(*) AS n_questions FROM g GROUP BY 1 HAVING count(*) > 1""",
    "sentence_ngrams": f"""WITH q AS (SELECT list_filter(string_split({KEY_SQL('text')}, ' '), lambda w: w <> '') AS w FROM {_latest('sentences', 'sentence_id', 'text')}), g AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS ngram FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q, (SELECT unnest(range(2, 15)) AS k)))
        SELECT ngram, count(*) AS n FROM g GROUP BY 1""",
    "chunked_documents": f"""WITH d AS (SELECT doc_id, list_filter(string_split({KEY_SQL('text')}, ' '), lambda w: w <> '') AS w FROM documents)
        SELECT doc_id, i::INTEGER AS chunk_no, md5(array_to_string(w[i * 180 + 1:i * 180 + 220], ' ')) AS chunk_hash
        FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 40) / 180.0)::BIGINT))) AS i FROM d WHERE len(w) > 0)""",
    "disjoint_split": """WITH s AS (SELECT document_id, count(*) AS n_rows, md5(document_id) AS h FROM sentences WHERE document_id IS NOT NULL GROUP BY 1),
        c AS (SELECT *, sum(n_rows) OVER (ORDER BY h, document_id) AS until, sum(n_rows) OVER () AS total FROM s)
        SELECT document_id, n_rows, CASE WHEN until <= total * 0.1 THEN 'test' WHEN until <= total * 0.2 THEN 'dev' ELSE 'train' END AS part FROM c""",
    "hybrid_spans": f"""WITH {_EXTRACT}, {_M}, s AS (SELECT DISTINCT source_unit_id AS unit_id, mention_type, label, 1 AS s FROM m WHERE source_unit_id <> ''), f AS (SELECT DISTINCT unit_id, mention_type, label, 1 AS f FROM x),
        b AS (SELECT coalesce(s.mention_type, f.mention_type) AS mention_type, CASE WHEN s IS NULL THEN 'extracted' WHEN f IS NULL THEN 'stored' ELSE 'both' END AS source FROM s FULL JOIN f ON s.unit_id = f.unit_id AND s.mention_type = f.mention_type AND s.label = f.label)
        SELECT mention_type, source, count(*) AS n FROM b GROUP BY ALL""",
}
