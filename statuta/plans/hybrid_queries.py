"""Queries of the hybrid retriever, passages, graph tables, gazetteer and answer measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import answers as an
from statuta.operators import citations as ct
from statuta.operators import gazetteer as gz
from statuta.operators import graph as gr
from statuta.operators import passages as pa
from statuta.operators import retriever as rt
from statuta.operators import validity as va
from statuta.operators.corpus import latest, present
from statuta.plans import graph_queries as gq
from statuta.plans import retrieval_queries as rq
from statuta.plans.text_queries import KEY_SQL
from statuta.session import cut, table

#: How a citation is spoken in a question.
SPOKEN = {"article": "Điều ", "clause": "Khoản ", "point": "Điểm ", "chapter": "Chương ", "section": "Mục ", "appendix": "Phụ lục ", "form": "Mẫu số ", "document": "", "topic": ""}


#: Topics linked to passages beside citations, with their labels.
TOPICS = {
    "phanh": "VEHICLE_CONDITION_OR_EQUIPMENT", "lốp": "VEHICLE_CONDITION_OR_EQUIPMENT", "gương": "VEHICLE_CONDITION_OR_EQUIPMENT", "biển số": "VEHICLE_CONDITION_OR_EQUIPMENT", "kết cấu": "VEHICLE_CONDITION_OR_EQUIPMENT",
    "phù hiệu": "DOCUMENT", "vạch kẻ": "INFRASTRUCTURE", "hầm": "INFRASTRUCTURE", "bến xe": "INFRASTRUCTURE", "chủ xe": "ACTOR", "tín hiệu": "INFRASTRUCTURE", "kiểm định": "BEHAVIOR",
}


def _links(spark, sf_dir, units=None):
    """Citations, and topics at the weight of a gazetteer mention."""
    units = gq._units(spark, sf_dir, "content") if units is None else units
    cited = gq._links(spark, sf_dir, units).select(F.concat("passage", F.lit(".passage")).alias("passage"), "entity", "weight")
    words = spark.createDataFrame(list(TOPICS.items()), "word string, label string")
    known = words.select(F.concat(F.lit(" "), tx.match_key(F.col("word")), F.lit(" ")), F.concat(F.lit("topic:"), "word"), gz.weight(F.col("label"), F.col("word"), F.lit("gazetteer"), F.lit(1.0))).collect()
    topics = F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(row, ("key", "entity", "weight"))]) for row in known])
    # the text is bound to a name, so that it is folded once and not for every topic
    told = F.transform(F.array(F.concat(F.lit(" "), tx.match_key(F.col("content")), F.lit(" "))), lambda t: F.filter(topics, lambda x: F.contains(t, x["key"])))
    rows = units.where("content is not null").select("unit_id", F.explode(F.flatten(told)).alias("x"))
    return cited.unionByName(rows.select(F.concat("unit_id", F.lit(".passage")).alias("passage"), "x.entity", "x.weight"))


def _edges(spark, sf_dir, units=None):
    return gr.entity_links(_links(spark, sf_dir, units)).select("passage", "entity", "weight")


def _aliases(edges):
    kind, label = F.substring_index("entity", ":", 1), F.regexp_replace("entity", "^[^:]*:", "")
    spoken = F.create_map(*[F.lit(x) for pair in SPOKEN.items() for x in pair])
    return edges.select("entity").distinct().select("entity", F.concat(spoken[kind], label).alias("surface"), F.when(kind.isin("document", "topic"), 1.0).otherwise(0.5).alias("graph_weight"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "gold_questions").where("question_id is not null").dropDuplicates(["question_id"]).select("question_id", "question")


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per passage and entity."""
    return _edges(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.entity_nodes(_links(spark, sf_dir))


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    references = gr.reference_edges(gq._mentions(spark, sf_dir))
    nodes = edges.select(F.col("passage").alias("id"), F.lit("passage").alias("type")).unionByName(edges.select(F.col("entity").alias("id"), F.lit("entity").alias("type"))).distinct()
    kinds = edges.select(F.lit("HAS_ENTITY").alias("type")).unionByName(references.select(F.lit("REFERENCES").alias("type")))
    return gr.summary(nodes, kinds)


def reference_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 units that refer most."""
    return gr.top_degrees(gr.reference_edges(gq._mentions(spark, sf_dir)), "source", 20)


def entity_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that questions name."""
    exact = rt.exact_entities(_questions(spark, sf_dir), "question_id", "question", _aliases(_links(spark, sf_dir)))
    return rt.activate(exact).select(F.col("q").alias("question_id"), "entity", "activation")


def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(_edges(spark, sf_dir))  # read by the aliases and the links
    exact = rt.exact_entities(_questions(spark, sf_dir), "question_id", "question", _aliases(edges))
    out = rt.graph_scores(rt.activate(exact), edges, 300)
    return out.select(F.col("q").alias("question_id"), F.col("passage").alias("passage_id"), F.round("score", 6).alias("score"))


def _references(spark, sf_dir):
    mentions = latest(table(spark, sf_dir, "ref_mentions"), "mention_id", keep=["source_unit_id", "resolution"])
    passage = lambda c: F.concat(F.col(c), F.lit(".passage"))
    rows = mentions.where("resolution.status = 'resolved' and coalesce(resolution.target_type, 'unit') = 'unit' and source_unit_id <> ''")
    return rows.select(passage("source_unit_id").alias("source"), passage("resolution.target_id").alias("target"), F.coalesce("resolution.confidence", F.lit(1.0)).alias("weight"))


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to their five best passages, by the configuration without embeddings."""
    last = lambda c: F.max(F.struct("ingested_at", c))[c].alias(c)
    # of rows of one time the one last deleted holds, for links the largest text; units that aren't deleted have one text
    units = cut(table(spark, sf_dir, "units").where("unit_id is not null").groupBy("unit_id").agg(last("content"), last("deleted_at")))
    passages = present(units).where(F.length(F.trim("content")) > 0).select(F.concat("unit_id", F.lit(".passage")).alias("passage_id"), F.col("content").alias("index_text"))
    edges = cut(_edges(spark, sf_dir, units))  # read by the aliases and the links
    out = rt.retrieve(_questions(spark, sf_dir), passages, edges, _references(spark, sf_dir), _aliases(edges), rq.LEXICAL, k=5)
    return out.select(F.col("q").alias("question_id"), F.col("passage").alias("passage_id"), F.round("score", 4).alias("score"), "rank")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passage rows of all present units, with kind, dates, references and policies."""
    keep = ["package_id", "document_id", "document_number", "source_type", "attachment_id", "attachment_type", "unit_type", "parent_id", "unit_order", "path_text", "content", "structured_fields", "source_file", "deleted_at"]
    units = present(latest(table(spark, sf_dir, "units"), "unit_id", keep=keep)).drop("deleted_at", "ingested_at")
    mentions = gq._mentions(spark, sf_dir).select("source_unit_id", "raw", "mention_type", "resolution.status", "resolution.target_id", "resolution.target_type", "resolution.confidence")
    actions = ct.amendment_spans(units, "unit_id", "content").groupBy("unit_id").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    outgoing, incoming = pa.references(mentions, actions)
    known = va.register(table(spark, sf_dir, "effectivity_index"))
    dated = va.document_dates(units.select("unit_id", "document_id", "document_number"), known)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    dates = dated.select("unit_id", day("valid_from").alias("effective_from"), day("valid_to").alias("ceased_from"), F.lit(None).cast("string").alias("effective_to"), F.when(F.col("valid_from").isNotNull(), "known").alias("effectivity_status"))
    return pa.build(units, outgoing, incoming, dates, actions, pa.children(units))


def passage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by unit type, kind and expansion policies."""
    rows = passages(spark, sf_dir)
    return rows.groupBy("unit_type", "passage_kind", "has_long_reference", F.array_join("reference_expansion_policies", "|").alias("policies")).agg(F.count(F.lit(1)).alias("n"), F.count("effective_from").alias("n_dated"), F.sum(F.size(F.coalesce("incoming_refs", F.array()))).alias("n_incoming"))


def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of all units with places, raw text and scope."""
    return ct.spans(gq._units(spark, sf_dir, "content"), "unit_id", "content")


def attachment_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = gq._units(spark, sf_dir, "content", "source_type").where("source_type = 'attachment'")
    return ct.light_spans(units, "unit_id", "content")


def amendment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.amendment_spans(gq._units(spark, sf_dir, "content"), "unit_id", "content")


def question_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time each question asks about, if it names one, and the register's documents in force then."""
    asked = _questions(spark, sf_dir).select("question_id", va.scope(F.col("question"), F.lit("2026-01-01").cast("date")).alias("s"))
    return asked.where("s is not null").select("question_id", "s.*")


def documents_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the register in force at any time of 2025."""
    year = F.struct(F.lit("year").alias("kind"), F.lit("2025-01-01").cast("date").alias("from_day"), F.lit("2026-01-01").cast("date").alias("to_day"))
    known = va.register(table(spark, sf_dir, "effectivity_index"))
    return known.select("document_id", va.active_in(F.col("valid_from"), F.col("valid_to"), year).alias("active"))


def unit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per document, by whether their dates come from the register by id or by number."""
    units = gq._units(spark, sf_dir, "document_id", "document_number")
    known = va.register(table(spark, sf_dir, "effectivity_index"))
    rows = va.document_dates(units, known)
    return rows.groupBy("document_id", "valid_from", "valid_to").agg(F.count(F.lit(1)).alias("n_units"))


def _surfaces(spark, sf_dir):
    """Titles, units' short texts and raw citations as surfaces to be judged."""
    rows = latest(table(spark, sf_dir, "sentences"), "sentence_id", keep=["text"]).where("length(text) <= 80").select(tx.surface(F.col("text")).alias("surface"))
    raws = gq._mentions(spark, sf_dir).select(tx.surface(F.col("raw")).alias("surface"))
    return rows.unionByName(raws).where("surface <> ''").groupBy("surface").agg(F.count(F.lit(1)).alias("count"))


def surface_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sentences and citations as surfaces: citation, generic, valid, labels."""
    s = F.col("surface")
    return _surfaces(spark, sf_dir).select("surface", "count", gz.reference_like(s).alias("is_citation"), gz.too_generic(s).alias("is_generic"), gz.valid(s).alias("is_valid"), F.array_join(gz.guess_labels(s), "|").alias("labels"))


def _gazetteer(spark, sf_dir):
    s = F.col("surface")
    rows = _surfaces(spark, sf_dir).where(gz.valid(s)).select("surface", F.explode(gz.guess_labels(s)).alias("label"), "count")
    return rows.select("surface", s.alias("canonical"), "label", "count")


def pruned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gz.pruned(_gazetteer(spark, sf_dir)).select("surface", "label", "count", "match_mode", "graph_weight", "prune_reason")


def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gz.pruned(_gazetteer(spark, sf_dir)).withColumn("canonical", tx.surface_key(F.col("surface")))
    out = gz.canonical(rows)
    return out.select("label", "canonical", F.array_join("aliases", "|").alias("aliases"), "count", "min_graph_weight", "is_generic_hub")


def gazetteer_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gz.seeds(gz.pruned(_gazetteer(spark, sf_dir)), 30).select("label", "surface")


def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by key words of the labels, in text and context."""
    rows = latest(table(spark, sf_dir, "sentences"), "sentence_id", keep=["context_text", "text"])
    return gz.keyword_score(rows, "sentence_id", "text", "context_text", gz.KEYWORDS).select("sentence_id", "score", F.array_join("labels", "|").alias("labels"))


def _pairs(spark, sf_dir):
    """Each question's stored passages with their text, as answers to be judged."""
    runs = table(spark, sf_dir, "retrieval_results").where("question_id is not null and passage_id is not null").select("question_id", "passage_id").distinct()
    texts = rq._passages(spark, sf_dir).select(F.concat("unit_id", F.lit(".passage")).alias("passage_id"), "content")
    return runs.join(texts, "passage_id").join(_questions(spark, sf_dir), "question_id")


def answer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as answers to their question as target: the rule that decides, counted."""
    rows = _pairs(spark, sf_dir).select("question_id", an.agreement(F.col("question"), F.col("content"), F.col("question")).alias("rule"))
    return rows.groupBy("question_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def answer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units' texts as gold answers, cut into targets, and how many the passage's own text meets."""
    texts = rq._passages(spark, sf_dir)
    return an.coverage(texts.withColumn("own", F.col("content")), "unit_id", "content", "own")


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a question's passages have the citation the question names."""
    rows = _pairs(spark, sf_dir).where(F.size(an.requirements(F.col("question"))) > 0)
    return rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_passages"), F.count_if(an.cites(F.col("question"), F.col("content"))).alias("n_cited"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_links, entity_nodes, graph_summary, reference_degree, entity_activation, graph_scores, hybrid_retrieve, passages, passage_profile, citation_spans, attachment_citations, amendment_spans, question_scopes, documents_in_year, unit_dates,
        surface_rules, pruned_aliases, canonical_entities, gazetteer_seeds, keyword_candidates, answer_rules, answer_targets, citation_coverage,
    )
}

_TOPICS = "tp(word, w) AS (VALUES ('phanh', 0.463125), ('lốp', 0.463125), ('gương', 0.463125), ('biển số', 0.7125), ('kết cấu', 0.7125), ('phù hiệu', 0.7125), ('vạch kẻ', 0.6), ('hầm', 0.39), ('bến xe', 0.6), ('chủ xe', 0.6375), ('tín hiệu', 0.6), ('kiểm định', 0.8625))"
_L = gq._LINKS + f",\n{_TOPICS},\ntt AS (SELECT unit_id, {KEY_SQL('content')} AS t FROM u),\nlk AS (SELECT passage || '.passage' AS passage, entity, ln(1 + sum(weight)::DOUBLE) AS weight FROM (SELECT passage, entity, weight::DOUBLE AS weight FROM k UNION ALL SELECT unit_id, 'topic:' || word, w::DOUBLE FROM tt, tp WHERE contains(' ' || t || ' ', ' ' || {KEY_SQL('word')} || ' ')) GROUP BY ALL)"
_Q = f"q AS (SELECT question_id, {KEY_SQL('question')} AS t FROM (SELECT DISTINCT ON (question_id) question_id, question FROM gold_questions WHERE question_id IS NOT NULL))"
_SAID = "CASE split_part(entity, ':', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (("article", "Điều "), ("clause", "Khoản "), ("point", "Điểm "), ("chapter", "Chương "), ("section", "Mục "), ("appendix", "Phụ lục "), ("form", "Mẫu số "), ("document", ""), ("topic", ""))) + " END || regexp_replace(entity, '^[^:]*:', '')"
_ACTIVE = f"""{_L}, {_Q},
al AS (SELECT entity, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s, CASE WHEN entity LIKE 'document:%' OR entity LIKE 'topic:%' THEN 1.0::DOUBLE ELSE 0.5 END AS w FROM (SELECT entity, {KEY_SQL('said')} AS s FROM (SELECT DISTINCT entity, {_SAID} AS said FROM lk))),
ac0 AS (SELECT question_id, entity, max(w) AS activation FROM q, al WHERE s <> '' AND contains(' ' || t || ' ', ' ' || s || ' ') GROUP BY ALL),
ac AS (SELECT question_id, entity, activation FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY activation DESC, entity) AS r FROM ac0) WHERE r <= 20)"""
_GRAPH = _ACTIVE + """,
hv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, passage) AS r FROM {0}) WHERE r <= 300),
gs AS (SELECT question_id, passage AS passage_id, sum(activation * weight) AS score FROM ac JOIN hv USING (entity) GROUP BY ALL)"""
_NULLS = "CASE WHEN lower(trim({0})) IN ('null','none','nan','nat','') THEN NULL ELSE trim({0}) END"
_REG = f"g AS (SELECT document_id, max(document_number) AS document_number, min(try_strptime({_NULLS.format('effective_from')}, '%Y-%m-%d')::DATE) AS valid_from, min(try_strptime({_NULLS.format('effective_to')}, '%Y-%m-%d')::DATE) AS valid_to FROM effectivity_index WHERE document_id IS NOT NULL GROUP BY 1)"
_NUM = "regexp_replace(lower(strip_accents(replace(upper(regexp_replace(regexp_replace({0}, '\\s+', '', 'g'), '[‐‑–—−]', '-', 'g')), 'Đ', 'D'))), '[^a-z0-9]', '', 'g')"
_PAIRS = f"""pr AS (SELECT DISTINCT question_id, passage_id FROM retrieval_results WHERE question_id IS NOT NULL AND passage_id IS NOT NULL), {rq._PASSAGES},
qq AS (SELECT DISTINCT ON (question_id) question_id, question FROM gold_questions WHERE question_id IS NOT NULL),
pp AS (SELECT question_id, question, content FROM pr JOIN u ON u.unit_id || '.passage' = pr.passage_id JOIN qq USING (question_id))"""

SQL = {
    "entity_links": f"WITH {_L} SELECT passage, entity, round(weight, 6) AS weight FROM lk",
    "entity_nodes": f"WITH {_L}, dg AS (SELECT entity, count(DISTINCT passage) AS degree FROM lk GROUP BY 1) SELECT entity, degree, CASE WHEN degree > 5000 THEN 0.1 WHEN degree > 2000 THEN 0.2 WHEN degree > 800 THEN 0.35 ELSE 1.0 END::DOUBLE AS min_graph_weight, degree > 800 AS is_hub FROM dg",
    "graph_summary": f"WITH {_L}, {gq._M}, {gq._EDGES} SELECT 'node' AS part, 'passage' AS type, count(DISTINCT passage) AS n FROM lk UNION ALL SELECT 'node', 'entity', count(DISTINCT entity) FROM lk UNION ALL SELECT 'edge', 'HAS_ENTITY', count(*) FROM lk UNION ALL SELECT 'edge', 'REFERENCES', count(*) FROM e",
    "reference_degree": f"WITH {gq._M}, {gq._EDGES} SELECT source AS id, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, id LIMIT 20",
    "entity_activation": f"WITH {_ACTIVE} SELECT * FROM ac",
    "graph_scores": f"WITH {_GRAPH.replace('{0}', 'lk')} SELECT question_id, passage_id, round(score, 6) AS score FROM gs",
    "hybrid_retrieve": f"WITH {_GRAPH.replace('{0}', 'tl')}".replace("hv AS", f"tx AS (SELECT unit_id || '.passage' AS passage_id FROM (SELECT unit_id, deleted_at, content, row_number() OVER (PARTITION BY unit_id ORDER BY ingested_at DESC, deleted_at DESC NULLS LAST, content DESC NULLS LAST) AS r FROM units) WHERE r = 1 AND deleted_at IS NULL AND length(trim(content)) > 0),\ntl AS (SELECT * FROM lk WHERE passage IN (SELECT passage_id FROM tx)),\nhv AS", 1)
    + f""",
w AS (SELECT unit_id || '.passage' AS doc, list_filter(string_split({KEY_SQL('content')}, ' '), lambda x: x <> '') AS words FROM u WHERE unit_id || '.passage' IN (SELECT passage_id FROM tx)),
s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
p AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY ALL),
i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
bq AS (SELECT DISTINCT question_id, unnest(string_split(t, ' ')) AS term FROM q),
b0 AS (SELECT question_id, doc AS passage_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bq JOIN p USING (term) JOIN i USING (term), s GROUP BY ALL),
b AS (SELECT question_id, passage_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS r FROM b0) WHERE r <= 300),
sd AS (SELECT question_id, passage_id, sum(score) AS score FROM (SELECT question_id, passage_id, 0.7 * score AS score FROM b UNION ALL SELECT question_id, passage_id, 0.3 * score FROM gs) GROUP BY ALL),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS r FROM sd) WHERE r <= 100),
mm AS (SELECT mention_id, max_by({{'s': source_unit_id, 'r': resolution}}, ingested_at) AS x FROM ref_mentions WHERE mention_id IS NOT NULL GROUP BY mention_id),
re AS (SELECT x.s || '.passage' AS source, x.r.target_id || '.passage' AS target, coalesce(x.r.confidence, 1.0) AS weight FROM mm WHERE x.r.status = 'resolved' AND coalesce(x.r.target_type, 'unit') = 'unit' AND x.s <> '' AND x.r.target_id || '.passage' IN (SELECT passage_id FROM tx)),
rf AS (SELECT question_id, target AS passage_id, sum(score * weight) AS score FROM st JOIN re ON re.source = st.passage_id GROUP BY ALL),
al4 AS (SELECT question_id, passage_id, max(CASE WHEN c = 'b' THEN score END) AS b, max(CASE WHEN c = 'g' THEN score END) AS g, max(CASE WHEN c = 'r' THEN score END) AS r FROM (SELECT 'b' AS c, * FROM b UNION ALL SELECT 'g', * FROM gs UNION ALL SELECT 'r', * FROM rf) GROUP BY ALL),
nm AS (SELECT question_id, passage_id, {", ".join(f"coalesce(CASE WHEN {c} IS NULL THEN NULL WHEN max({c}) OVER z <= min({c}) OVER z THEN 1.0 ELSE ({c} - min({c}) OVER z) / (max({c}) OVER z - min({c}) OVER z) END, 0) AS {c}" for c in "bgr")} FROM al4 WINDOW z AS (PARTITION BY question_id)),
fs AS (SELECT question_id, passage_id, 0.25 * b + 0.15 * g * CASE WHEN b = 0 THEN 0.65 ELSE 1.0 END + 0.60 * r AS score FROM nm),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS rank FROM fs WHERE score > 0)
SELECT question_id, passage_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 5""",
    "documents_in_year": f"WITH {_REG} SELECT document_id, NOT (coalesce(valid_from >= DATE '2026-01-01', false) OR coalesce(valid_to <= DATE '2025-01-01', false)) AS active FROM g",
    "unit_dates": f"""WITH {_REG}, n AS (SELECT {_NUM.format('document_number')} AS k, min({{'f': valid_from, 't': valid_to}}) AS d FROM g WHERE document_number IS NOT NULL GROUP BY 1), u AS {gq._latest('units', 'unit_id', 'document_id', 'document_number')}
        SELECT u.document_id, CASE WHEN g.document_id IS NOT NULL THEN g.valid_from ELSE n.d.f END AS valid_from, CASE WHEN g.document_id IS NOT NULL THEN g.valid_to ELSE n.d.t END AS valid_to, count(*) AS n_units FROM u LEFT JOIN g ON g.document_id = u.document_id LEFT JOIN n ON n.k = {_NUM.format('u.document_number')} GROUP BY ALL""",
    "question_scopes": r"""WITH q AS (SELECT DISTINCT ON (question_id) question_id, question FROM gold_questions WHERE question_id IS NOT NULL),
x AS (SELECT question_id, regexp_matches(question, '(?i)(^|[^\p{L}\p{N}_])(hiện nay|hiện tại|hiện hành|bây giờ|hôm nay)($|[^\p{L}\p{N}_])') AS now, nullif(regexp_extract(question, '(?:^|[^\p{L}\p{N}_])(\d{1,2}/\d{1,2}/\d{4})(?:$|[^\p{L}\p{N}_])', 1), '') AS d, nullif(regexp_extract(question, '(?i)(?:^|[^\p{L}\p{N}_])năm\s+((?:19|20)\d{2})(?:$|[^\p{L}\p{N}_])', 1), '') AS y FROM q),
z AS (SELECT question_id, CASE WHEN now OR d IS NOT NULL THEN 'point' WHEN y IS NOT NULL THEN 'year' END AS kind, CASE WHEN now THEN DATE '2026-01-01' WHEN d IS NOT NULL THEN try_strptime(d, '%d/%m/%Y')::DATE ELSE make_date(y::INT, 1, 1) END AS from_day, CASE WHEN now THEN DATE '2026-01-01' WHEN d IS NOT NULL THEN try_strptime(d, '%d/%m/%Y')::DATE ELSE make_date(y::INT + 1, 1, 1) END AS to_day FROM x)
SELECT * FROM z WHERE from_day IS NOT NULL""",
    "citation_coverage": f"""WITH {_PAIRS}, kk AS (SELECT question_id, {KEY_SQL('question')} AS s, {KEY_SQL('content')} AS h FROM pp),
rr AS (SELECT *, list_concat(regexp_extract_all(s, '\\b(diem [a-z0-9]+)\\b', 1), regexp_extract_all(s, '\\b(khoan [0-9]+[a-z]?)\\b', 1), regexp_extract_all(s, '\\b(dieu [0-9]+[a-z]?)\\b', 1), regexp_extract_all(s, '\\b(muc [0-9ivxlcdm]+)\\b', 1), regexp_extract_all(s, '\\b(chuong [0-9ivxlcdm]+)\\b', 1), regexp_extract_all(s, '\\b(phu luc [0-9ivxlcdm]+)\\b', 1)) AS a FROM kk)
SELECT question_id, count(*) AS n_passages, count_if(s <> '' AND (contains(h, s) OR len(list_filter(a, lambda x: NOT contains(h, x))) = 0)) AS n_cited FROM rr WHERE len(a) > 0 GROUP BY 1""",
}
