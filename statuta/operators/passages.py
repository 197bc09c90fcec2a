"""Passages: units with their kind, dates, references, amendments and the text that is
searched and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx

# Unit types that are read by themselves, and those that hold others.
ATOMIC = ["diem", "khoan", "text", "table_row", "appendix_item_decimal", "appendix_point", "appendix_bullet", "appendix_paragraph", "form_field", "form_text", "technical_requirement", "qcvn_requirement"]
CONTAINER = ["phan", "chuong", "muc", "tieu_muc", "dieu", "attachment_summary", "appendix_section_alpha", "appendix_section_roman", "appendix_table", "form_summary", "form_section", "form_table", "embedded_form_title"]


def children(units: DataFrame) -> DataFrame:
    """``unit_id, n_children``: units under each unit, by their parent id, else by the nearest
    ancestor that exists in the dotted id."""
    named = units.where("parent_id <> ''").select(F.col("parent_id").alias("unit_id"))
    orphaned = units.where("coalesce(parent_id, '') = ''").select(F.col("unit_id").alias("child"), F.split("unit_id", r"\.").alias("parts"))
    above = orphaned.where(F.size("parts") > 1).select("child", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"), "parts").select("child", "n", F.array_join(F.slice("parts", F.lit(1), F.col("n")), ".").alias("unit_id"))
    nearest = above.join(units.select("unit_id"), "unit_id", "left_semi").groupBy("child").agg(F.max_by("unit_id", "n").alias("unit_id"))
    return named.unionByName(nearest.select("unit_id")).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_children"))


def kind(unit_type: Column, n_children: Column) -> Column:
    """atomic or container, by type; an article without children is atomic; other types by
    whether they have children."""
    n = F.coalesce(n_children, F.lit(0))
    named = F.when(unit_type.isin(*ATOMIC), "atomic").when((unit_type == "dieu") & (n == 0), "atomic").when(unit_type.isin(*CONTAINER), "container")
    return F.coalesce(named, F.when(n > 0, "container").otherwise("atomic"))


def policy(target_type: Column, label: Column, raw: Column) -> Column:
    """How a reference may be expanded: inline_if_short, search_within_target or candidate_only."""
    wide = lambda c: F.coalesce(F.lower(c).rlike("phụ lục|qcvn|quy chuẩn"), F.lit(False))
    t = F.coalesce(target_type, F.lit(""))
    return F.when(t.isin("unit", "dieu", "khoan", "diem"), "inline_if_short").when(t.isin("attachment", "attachment_container", "appendix_group", "document") | wide(label) | wide(raw), "search_within_target").otherwise("candidate_only")


def references(resolved: DataFrame, actions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Outgoing and incoming references per unit: ``unit_id, refs, policies``. ``resolved``:
    source_unit_id, target_id, target_type, raw, mention_type, status, confidence;
    ``actions``: unit_id, actions, of the unit that refers, which make them amendments."""
    rows = resolved.where("coalesce(source_unit_id, '') <> ''")
    if actions is not None:
        rows = rows.join(actions.select(F.col("unit_id").alias("source_unit_id"), "actions"), "source_unit_id", "left")
    own = F.coalesce("actions", F.array().cast("array<string>")) if actions is not None else F.array().cast("array<string>")
    ref = F.struct("source_unit_id", "raw", "mention_type", "status", "target_id", "target_type", "confidence", policy(F.col("target_type"), F.lit(None).cast("string"), F.col("raw")).alias("expansion_policy"), F.when(F.size(own) > 0, "amendment").otherwise("reference").alias("relation_type"), own.alias("amendment_actions"))
    rows = rows.select("source_unit_id", "target_id", ref.alias("ref"))
    grouped = lambda c: rows.where(F.coalesce(c, F.lit("")) != "").groupBy(F.col(c).alias("unit_id")).agg(F.sort_array(F.collect_list("ref")).alias("refs"), F.array_sort(F.collect_set("ref.expansion_policy")).alias("policies"))
    return grouped("source_unit_id"), grouped("target_id").drop("policies")


def shown(rows: DataFrame, most_refs: int = 8) -> Column:
    """The text of a passage: its document, attachment, dates, path, amendments, resolved
    references, content and structured fields, a line each; what is empty has no line."""
    filled = lambda c: F.nullif(tx.squeeze(F.col(c).cast("string")), F.lit(""))
    line = lambda name, value: F.concat(F.lit(name), value)
    attached = filled("attachment_id")
    ends = F.coalesce(line("Hết hiệu lực từ: ", filled("ceased_from")), line("Hiệu lực đến: ", filled("effective_to")))
    named = F.transform(F.filter(F.slice(F.coalesce("outgoing_refs", F.array()), 1, most_refs), lambda r: r["target_id"].isNotNull()), lambda r: F.concat(F.lit("- "), F.coalesce(r["raw"], F.lit("None")), F.lit(" -> "), r["target_id"], F.lit(" ("), r["expansion_policy"], F.lit(")")))
    fields = F.nullif(F.to_json("structured_fields"), F.lit("{}")) if "structured_fields" in rows.columns else F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        line("Văn bản: ", filled("document_number")), line("Tên văn bản: ", filled("document_title")), line("Tài liệu đính kèm: ", attached),
        F.when(attached.isNotNull(), line("Loại tài liệu đính kèm: ", filled("attachment_type"))), line("Hiệu lực từ: ", filled("effective_from")), ends, line("Đường dẫn pháp lý: ", filled("path_text")),
        F.when(F.size("amendment_actions") > 0, line("Thao tác sửa đổi/bổ sung: ", F.array_join("amendment_actions", ", "))),
        F.when(F.size(named) > 0, F.concat(F.lit("Tham chiếu đã giải:\n"), F.array_join(named, "\n"))), line("Nội dung:\n", filled("content")), line("Dữ liệu cấu trúc: ", fields),
    )


def build(units: DataFrame, outgoing: DataFrame, incoming: DataFrame, dates: DataFrame, actions: DataFrame, counts: DataFrame) -> DataFrame:
    """One passage per unit: four left joins by unit and one for the number of children.
    ``dates``: unit_id, effective_from, ceased_from, effective_to, effectivity_status."""
    none = F.array().cast("array<string>")
    rows = units.join(outgoing.select("unit_id", F.col("refs").alias("outgoing_refs"), "policies"), "unit_id", "left").join(incoming.select("unit_id", F.col("refs").alias("incoming_refs")), "unit_id", "left")
    rows = rows.join(dates, "unit_id", "left").join(actions.select("unit_id", F.col("actions").alias("amendment_actions")), "unit_id", "left").join(counts, "unit_id", "left")
    rows = rows.withColumn("amendment_actions", F.coalesce("amendment_actions", none)).withColumn("content", tx.squeeze(F.coalesce("content", F.lit("")))).withColumn("path_text", tx.squeeze(F.coalesce("path_text", F.lit(""))))
    rows = rows.withColumn("document_title", F.lit(None).cast("string")) if "document_title" not in rows.columns else rows
    rows = rows.withColumn("passage_text", shown(rows))
    source = F.coalesce(F.nullif(F.col("source_type"), F.lit("")), F.when(F.col("attachment_id").isNotNull(), "attachment").otherwise("main_document"))
    policies = F.coalesce("policies", none)
    return rows.select(
        F.concat("unit_id", F.lit(".passage")).alias("passage_id"), F.col("unit_id").alias("source_unit_id"), "package_id", "document_id", "document_number", "document_title", source.alias("source_type"), "attachment_id", "attachment_type", "unit_type",
        kind(F.col("unit_type"), F.col("n_children")).alias("passage_kind"), F.lit("source_law").alias("passage_role"), "path_text", "content", "passage_text", "effective_from", "ceased_from", "effective_to",
        F.coalesce("effectivity_status", F.lit("unknown")).alias("effectivity_status"), (F.size("amendment_actions") > 0).alias("has_amendment_action"), "amendment_actions", "outgoing_refs", "incoming_refs",
        F.array_contains(policies, "search_within_target").alias("has_long_reference"), policies.alias("reference_expansion_policies"), F.coalesce("unit_order", F.lit(0)).alias("passage_order"), "source_file", F.md5("passage_text").alias("content_hash"),
    )
