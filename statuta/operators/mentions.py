"""Citations in legal text: extraction, deduplication, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.operators import citations as ct
from statuta.operators import gazetteer as gz

# Fixed value: a document number, laws with their assembly's number included.
NUMBER = r"(?<![\p{L}\p{N}/])(\d+/\d{4}/[A-ZĐ]+\d*(?:-[A-ZĐ0-9]+)*)(?![\p{L}\p{N}])"
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, mention_type, label``, one row per citation, in no order: members of lists,
    then single citations outside of them, and document numbers. Look-around keeps
    neighbours apart; everything stays in the JVM. Places and scope: see ``citations``."""

    def of(kind: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: F.struct(F.lit(kind).alias("mention_type"), x.alias("label")))

    def members(lists: Column, label: str) -> Column:
        return F.flatten(F.transform(lists, lambda m: F.array_distinct(F.regexp_extract_all(m, F.lit(rf"(?iU){_EDGE}({label}){_END}"), F.lit(1)))))

    found = []
    for kind, pattern in ct.SINGLE.items():
        rest = F.col(text)
        if kind in ct.LISTED:
            word, label = ct.LISTED[kind]
            many = rf"(?iU){_EDGE}{word}\s+{label}(?:\s*(?:,|\bvà\b|\bhoặc\b)\s*(?:{word}\s+)?{label})+"
            found.append(of(kind, members(F.regexp_extract_all(rest, F.lit(many), F.lit(0)), label)))
            rest = F.regexp_replace(rest, many, " ")
        found.append(of(kind, F.regexp_extract_all(rest, F.lit(rf"(?U){_EDGE}{pattern}{_END}"), F.lit(1))))
    found.append(of("document", F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(1))))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*found)).alias("m")).select(key, "m.*")


# What an amendment does, and what it is done to.
AMENDMENT = r"(sửa đổi|bổ sung|thay thế|bãi bỏ|hủy bỏ|đính chính)[^.;]{0,100}?(Điều|khoản|điểm|Phụ lục|Mẫu số|cụm từ|Thông tư|Nghị định|Quyết định)"


def amendments(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, action, target``: amending verbs that name a part of the law within 100
    characters of the same sentence."""
    plain = F.lower(text)
    pattern = F.lit(AMENDMENT.lower())
    both = F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("action"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("target"))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(both).alias("m")).select(key, "m.action", "m.target")


# Fixed value: a line of a form with its label and what is filled in.
FORM_LINE = r"^([^:\n]{2,80}):\s*(.*)$"


def form_fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, label, value, filled``: lines "label: value" of forms; dots, dashes and
    underscores alone mean that nothing is filled in, and the value is null."""
    line = F.explode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line")
    rows = df.where(F.col(text).isNotNull()).select(key, line).select(key, tx.strip(F.col("line")).alias("line")).where(F.col("line").rlike(FORM_LINE))
    value = tx.strip(F.regexp_extract("line", FORM_LINE, 2))
    solid = F.nullif(F.regexp_replace(value, r"^[.…_\s-]+$", ""), F.lit(""))
    return rows.select(key, tx.strip(F.regexp_extract("line", FORM_LINE, 1)).alias("label"), solid.alias("value"), solid.isNotNull().alias("filled"))


def dedupe(mentions: DataFrame, scope: str) -> DataFrame:
    """Mentions merged per scope, type and folded label (raw text where there is no label):
    occurrences summed, distinct units and raw texts counted, the first raw text kept."""
    label = F.lower(F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("raw"), F.lit("")))
    return mentions.groupBy(scope, "mention_type", label.alias("label_key")).agg(
        F.sum(F.coalesce("occurrence_count", F.lit(1))).alias("occurrences"), F.countDistinct("source_unit_id").alias("n_units"), F.countDistinct("raw").alias("n_raws"), F.min("raw").alias("first_raw")
    )


def resolve_articles(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """``mention_id, n_targets, status``: article mentions against the articles of their own
    document. One target resolves, several are ambiguous, none leaves it unresolved."""
    articles = units.where(F.col("unit_type") == "dieu").select("document_id", tx.path_level(F.col("path_text"), "Điều").alias("label"), "unit_id").where(F.col("label").isNotNull())
    counted = articles.groupBy("document_id", "label").agg(F.countDistinct("unit_id").alias("n_targets"))
    asked = mentions.where(F.col("mention_type") == "article").select("mention_id", "document_id", "label")
    n = F.coalesce("n_targets", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return asked.join(counted, ["document_id", "label"], "left").select("mention_id", n.alias("n_targets"), status.alias("status"))


def _selector(name: str, of: str) -> Column:
    """The number or letter after a level's name in the raw text of a mention; null if it has none."""
    found = F.regexp_extract("raw", rf"(?iu)(?:^|[^\p{{L}}]){name} ({of})(?![\p{{L}}\d])", 1)
    return F.when(found != "", found)


def resolve(mentions: DataFrame, units: DataFrame, attachments: DataFrame, documents: DataFrame) -> DataFrame:
    """``mention_id, mention_type, target, score, n_candidates, status`` of every mention.
    Documents are found by number (.99), appendices by their label in the package (.98), forms
    by number or label in the package (.72, .12 more for the number and .03 for the label, at
    least .93 if the number is of one form only). Articles, clauses and points are found at
    the finest selector of the raw text: point .98, clause .97, article .96, else what lies
    below the article .72, in the document whose number the raw text names, else in their own.
    A level that the raw text leaves out is that of the place of the mention. Documents and
    appendices that aren't there give the status unresolved_missing_document or _attachment."""
    rows = mentions.select("mention_id", "mention_type", "package_id", "document_id", "label", F.coalesce("raw", F.lit("")).alias("raw"), "source_path_text")
    known = documents.where("document_id is not null and document_number is not null").select(tx.compact_key(tx.document_number(F.col("document_number"))).alias("number_key"), F.col("document_id").alias("found_id")).distinct()
    said = F.regexp_extract("raw", NUMBER, 1)
    named = F.coalesce(F.when(said != "", said), F.when(F.col("mention_type") == "document", F.col("label")))
    rows = rows.withColumn("number_key", tx.compact_key(tx.document_number(named))).join(known, "number_key", "left")

    def found(hits: DataFrame, score: Column | float) -> DataFrame:
        return hits.select("mention_id", "target", (score if isinstance(score, Column) else F.lit(score)).alias("score"))

    # documents
    of_document = rows.where("mention_type = 'document'")
    out = [found(of_document.where("found_id is not null").withColumnRenamed("found_id", "target"), 0.99)]

    # attachments
    label = tx.compact_key(F.col("label"))
    last = tx.compact_key(F.element_at(F.split(tx.strip(F.col("label")), r"\s+"), -1))
    keyed = attachments.where("attachment_id is not null").select("package_id", F.col("attachment_id").alias("target"), F.explode(F.array_distinct(F.filter(F.array(label, last, tx.compact_key(F.col("title"))), lambda k: k != ""))).alias("key"))
    wanted = [tx.compact_key(F.concat(F.lit("Phụ lục "), F.col("label"))), tx.compact_key(F.col("label"))]
    of_appendix = rows.where("mention_type = 'appendix'").select("mention_id", "package_id", F.explode(F.array_distinct(F.array(*wanted))).alias("key"))
    out.append(found(of_appendix.join(keyed, ["package_id", "key"]), 0.98))

    def number(col: Column) -> Column:
        digits = F.regexp_extract(F.lower(col), r"(?:mẫu|mau)(?:[ _]+(?:số|so))?[ _]*0*(\d+[a-z]?)", 1)
        return F.when(digits != "", digits)

    forms = attachments.where("attachment_id is not null and attachment_kind in ('form', 'appendix_form')").select("package_id", F.col("attachment_id").alias("target"), label.alias("label_key"), tx.compact_key(F.col("title")).alias("title_key"), F.filter(F.array(number(F.col("label")), number(F.col("title")), number(F.element_at(F.split("source_file", "/"), -1))), lambda k: k.isNotNull()).alias("numbers"))
    by_key = forms.withColumn("key", F.explode(F.array_distinct(F.concat(F.transform("numbers", lambda n: F.concat(F.lit("#"), n)), F.filter(F.array("label_key", "title_key"), lambda k: k != "")))))
    of_form = rows.where("mention_type = 'form'").select("mention_id", "package_id", number(F.concat(F.lit("mẫu số "), F.col("label"))).alias("own"), tx.compact_key(F.concat(F.lit("Mẫu số "), F.col("label"))).alias("own_key"))
    hits = of_form.withColumn("key", F.explode(F.array(F.concat(F.lit("#"), "own"), F.col("own_key")))).join(by_key, ["package_id", "key"]).dropDuplicates(["mention_id", "target"])
    alone = hits.groupBy("mention_id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    same = F.array_contains("numbers", F.col("own"))
    base = F.when(same, F.when(F.col("alone"), 0.93).otherwise(0.84)).otherwise(0.72)
    by_label = F.contains("label_key", "own_key") | F.contains("title_key", "own_key")
    out.append(found(hits.join(alone, "mention_id"), F.least(F.round(base + F.when(by_label, 0.03).otherwise(0.0), 4), F.lit(0.99))))

    # units, at the finest selector
    path = F.col("source_path_text")
    of_unit = rows.where("mention_type in ('article', 'clause', 'point')").where("number_key is null or found_id is not null")
    own_article, own_clause, own_point = _selector("Điều", r"\d+\p{L}?"), _selector("khoản", r"\d+\p{L}?"), _selector("điểm", r"\p{L}")
    article = F.coalesce(own_article, tx.path_level(path, "Điều"))
    clause = F.coalesce(own_clause, F.when(own_article.isNull() & own_point.isNotNull(), tx.path_level(path, "Khoản")))
    of_unit = of_unit.select("mention_id", F.coalesce("found_id", "document_id").alias("document_id"), tx.compact_key(article).alias("article"), tx.compact_key(clause).alias("clause"), tx.point_key(own_point).alias("point"))
    upath = F.col("path_text")
    lies = units.where("document_id is not null").select("document_id", F.col("unit_id").alias("target"), "unit_type", tx.compact_key(tx.path_level(upath, "Điều")).alias("article"), tx.compact_key(tx.path_level(upath, "Khoản")).alias("clause"), tx.point_key(tx.path_level(upath, "Điểm")).alias("point")).where("article is not null")
    out.append(found(of_unit.where("clause is not null and point is not null").join(lies.where("unit_type = 'diem'"), ["document_id", "article", "clause", "point"]), 0.98))
    out.append(found(of_unit.where("clause is not null and point is null").join(lies.where("unit_type = 'khoan'").drop("point"), ["document_id", "article", "clause"]), 0.97))
    whole = of_unit.where("clause is null").select("mention_id", "document_id", "article")
    exact = whole.join(lies.where("unit_type = 'dieu'").select("document_id", "article", "target"), ["document_id", "article"])
    below = whole.join(exact.select("mention_id"), "mention_id", "left_anti").join(lies.select("document_id", "article", "target"), ["document_id", "article"])
    out += [found(exact, 0.96), found(below, 0.72)]

    candidates = out[0]
    for more in out[1:]:
        candidates = candidates.unionByName(more)
    best = best_candidates(candidates, "mention_id", "target", "score")
    asked = rows.groupBy("mention_id", "mention_type").agg(F.bool_or(F.col("number_key").isNotNull() & F.col("found_id").isNull()).alias("no_document"))
    none = F.col("target").isNull()
    hint = F.when(none & F.col("no_document"), "unresolved_missing_document").when(none & (F.col("mention_type") == "appendix"), "unresolved_missing_attachment")
    status = F.coalesce(hint, F.col("status"), F.lit("unresolved"))
    return asked.join(best, "mention_id", "left").select("mention_id", "mention_type", "target", F.col("best").alias("score"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), status.alias("status"))


def decide(best: Column, second: Column, missing: Column | None = None) -> Column:
    """Decision over candidate scores: a missing-target hint wins (``missing`` names it); at
    least .90 resolves unless the runner-up is not less than .03 behind; at least .65 is ambiguous; anything else, and no
    candidate, is unresolved."""
    close = second.isNotNull() & (second >= F.round(best - 0.03, 6))
    ladder = F.when(best >= 0.90, F.when(close, "ambiguous").otherwise("resolved")).when(best >= 0.65, "ambiguous").otherwise("unresolved")
    return ladder if missing is None else F.coalesce(missing, ladder)


def best_candidates(candidates: DataFrame, key: str, target: str, score: str, keep: int = 8) -> DataFrame:
    """Per key the decision over its distinct targets, each at its best score; at most
    ``keep`` targets are listed in order of score and target."""
    per = candidates.groupBy(key, target).agg(F.max(score).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), target)
    ranked = per.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
    out = ranked.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col(target))).alias("target"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"), F.count(F.lit(1)).alias("n_candidates"))
    return out.withColumn("status", decide(F.col("best"), F.col("second")))


def alias_ladder(surface: Column, label: Column, count: Column, n_labels: Column) -> Column:
    """Review status of a surface: rejected as a citation or too generic, in conflict if its
    key carries several labels, accepted from three occurrences, else for review."""
    plain = gz.status(surface, label, count)
    return F.when(plain == "reject", "reject").when(n_labels > 1, "conflict").otherwise(plain)


def vocabulary(mentions: DataFrame) -> DataFrame:
    """Surface forms by folded key and label: counts, distinct documents, the most frequent
    spelling (ties: the first), the number of labels of the key, and the review status."""
    rows = mentions.select(tx.match_key(F.col("raw")).alias("surface_key"), F.col("mention_type").alias("entity_label"), "raw", "document_id", F.coalesce("occurrence_count", F.lit(1)).alias("k")).where("surface_key <> ''")
    spelled = rows.groupBy("surface_key", "entity_label", "raw").agg(F.sum("k").alias("k"))
    spelling = spelled.groupBy("surface_key", "entity_label").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("o"), F.col("raw").alias("raw"))).alias("m"))
    documents = rows.groupBy("surface_key", "entity_label").agg(F.countDistinct("document_id").alias("n_documents"))
    labels = rows.groupBy("surface_key").agg(F.countDistinct("entity_label").alias("n_labels"))
    out = spelling.join(documents, ["surface_key", "entity_label"]).join(labels, "surface_key")
    return out.select("surface_key", "entity_label", "n", "n_documents", F.col("m.raw").alias("surface"), "n_labels", alias_ladder(F.col("m.raw"), F.col("entity_label"), F.col("n"), F.col("n_labels")).alias("status"))
