"""Rules of surface forms: what names an entity, how much it weighs, what is a citation or
too generic; seeds, pruning and rollups of a gazetteer.

All rules are column expressions over a surface and its label. Null and blank surfaces are
rejected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as tx

LABELS = ["ACTOR", "BEHAVIOR", "CONDITION", "DOCUMENT", "INFRASTRUCTURE", "VEHICLE", "VEHICLE_CONDITION_OR_EQUIPMENT"]
# The importance of a label.
IMPORTANCE = {"BEHAVIOR": 1.15, "CONDITION": 1.05, "VEHICLE": 1.00, "DOCUMENT": 0.95, "VEHICLE_CONDITION_OR_EQUIPMENT": 0.95, "ACTOR": 0.85, "INFRASTRUCTURE": 0.80}
# Surfaces too generic for the graph.
HUBS = ["đường bộ", "xe cơ giới", "phương tiện", "phương tiện giao thông", "người", "tổ chức", "cá nhân", "cơ quan", "thiết bị", "hệ thống", "đường", "làn", "khu vực", "giấy tờ", "hồ sơ", "văn bản"]
# Surfaces too generic under their label.
GENERIC = {
    "BEHAVIOR": ["vi phạm", "vi phạm quy định", "thực hiện", "tham gia giao thông", "bị xử phạt", "xử phạt"],
    "VEHICLE": ["xe", "phương tiện", "loại xe", "phương tiện giao thông"],
    "ACTOR": ["người", "cá nhân", "tổ chức", "đối tượng", "người điều khiển phương tiện", "cơ quan có thẩm quyền"],
    "INFRASTRUCTURE": ["đường", "nơi", "khu vực", "vị trí", "địa điểm", "hệ thống", "thiết bị"],
    "DOCUMENT": ["văn bản", "quy định", "hồ sơ", "giấy tờ"],
    "VEHICLE_CONDITION_OR_EQUIPMENT": ["không đạt chuẩn", "không đúng quy định", "không bảo đảm", "thiết bị", "bộ phận"],
    "CONDITION": ["điều kiện", "yêu cầu", "tiêu chuẩn", "quy định", "phù hợp", "được phép", "không được"],
}
# Surfaces too generic whatever their label.
GENERIC_ANYWHERE = [
    "vi phạm", "vi phạm quy định", "thực hiện", "tham gia giao thông", "bị xử phạt", "xử phạt", "xe", "phương tiện", "loại xe", "phương tiện giao thông", "người", "cá nhân", "tổ chức", "đối tượng", "người điều khiển phương tiện",
    "đường", "nơi", "khu vực", "vị trí", "địa điểm", "hệ thống", "thiết bị", "văn bản", "quy định", "hồ sơ", "giấy tờ", "bộ phận", "điều kiện", "yêu cầu", "tiêu chuẩn", "phù hợp", "được phép", "không được",
]
# Surfaces that are citations.
CITATION = (
    r"(?iu)^(?:điều\s+\d+[a-z]?|khoản\s+\d+|điểm\s+[a-zđ]|phụ\s+lục\s+(?:[ivxlcdm]+|\d+|[a-z])|mẫu\s+(?:số\s+)?[0-9a-z_./-]+|(?:chương|mục)\s+(?:[ivxlcdm]+|\d+)|qcvn\s+.+"
    r"|\d+/\d{4}/[a-zđ]+.*|(?:thông tư|nghị định|luật|quyết định|nghị quyết)\s+(?:này|số\s+.+))$"
)
# Pruning lists.
KEPT = ["xe mô tô", "xe gắn máy", "xe ô tô", "xe cơ giới", "chủ xe", "chủ phương tiện", "người lái xe", "đường cao tốc", "sân sát hạch", "sân tập lái", "phù hiệu", "hộ chiếu", "căn cước", "căn cước công dân", "số khung", "số máy", "màu sơn"]
REJECTED = ["phương tiện", "xe", "đường", "thiết bị", "hệ thống", "giấy tờ", "hồ sơ", "quy định", "đối tượng", "cá nhân", "tổ chức"]
LOWERED = ["sản xuất", "vận chuyển", "bảo quản", "mua bán", "mua bán trái phép", "tài liệu", "giấy phép", "chứng chỉ", "đường bộ", "động cơ", "nhãn hiệu", "bánh xe", "cán bộ", "học viên"]
SENSITIVE = ["BEHAVIOR", "DOCUMENT", "INFRASTRUCTURE", "VEHICLE_CONDITION_OR_EQUIPMENT"]
SAFE = ["lái xe", "đăng ký", "kiểm định", "cao tốc", "thu phí", "giám sát", "hành trình", "tín hiệu"]
# Words of candidate spans' labels, and words no span begins or ends with.
KEYWORDS = {
    "BEHAVIOR": ["không", "vượt", "đi ngược", "chở quá", "quá tốc độ", "nồng độ cồn", "ma túy", "không chấp hành", "không đội", "không cài", "điều khiển", "dừng xe", "đỗ xe", "sử dụng", "đua xe", "lạng lách", "đánh võng"],
    "VEHICLE": ["xe", "mô tô", "gắn máy", "ô tô", "rơ moóc", "sơ mi rơ moóc", "máy kéo", "xe máy chuyên dùng"],
    "ACTOR": ["người điều khiển", "người lái", "chủ xe", "chủ phương tiện", "cảnh sát", "sát hạch viên", "thí sinh", "cơ sở đào tạo"],
    "INFRASTRUCTURE": ["đường", "làn", "biển báo", "đèn tín hiệu", "vạch kẻ", "cao tốc", "trạm", "cầu", "hầm", "bến xe"],
    "DOCUMENT": ["giấy phép", "giấy đăng ký", "chứng nhận", "chứng chỉ", "biên bản", "hồ sơ", "phù hiệu", "sổ"],
    "VEHICLE_CONDITION_OR_EQUIPMENT": ["gương", "phanh", "đèn", "biển số", "thiết bị", "kết cấu", "lốp", "bánh", "khí thải", "niên hạn"],
    "CONDITION": ["đủ tuổi", "không có", "chưa đủ", "phù hợp", "còn hiệu lực", "hết hiệu lực"],
}
NEVER_FIRST = ["và", "hoặc", "thì", "là", "của", "cho", "với", "tại", "theo", "trong", "khi", "nếu", "để", "về", "các", "những", "một", "này", "đó"]
NEVER_LAST = [*NEVER_FIRST, "sau", "trước"]
DANGLING = ["sau đây", "như sau", "quy định"]


def _words(surface: Column) -> Column:
    return F.filter(F.split(surface, " "), lambda w: w != "")


def reference_like(text: Column) -> Column:
    return F.coalesce(tx.surface(text).rlike(CITATION), F.lit(False))


def too_generic(text: Column, label: Column | None = None) -> Column:
    """Generic under its label (or, without one, anywhere), of two letters or less, or a number."""
    s = tx.surface(text)
    if label is None:
        listed = s.isin(*GENERIC_ANYWHERE)
    else:
        listed = reduce(lambda c, k: c | ((label == k) & s.isin(*GENERIC[k])), GENERIC, F.lit(False))
    return F.coalesce(listed, F.lit(False)) | F.coalesce((F.length(s) <= 2) | s.rlike(r"^\d+$"), F.lit(True))


def status(text: Column, label: Column, count: Column) -> Column:
    """Review status of a surface: rejected as a citation or too generic, accepted from three
    occurrences, else for review."""
    return F.when(reference_like(text) | too_generic(text, label), "reject").when(count >= 3, "accept").otherwise("review")


def valid(text: Column, longest: int = 14) -> Column:
    """Whether a span may be a candidate: 2 to ``longest`` words, no citation, not generic, no
    number, no connecting word at its ends."""
    s = tx.surface(text)
    words = _words(s)
    ends = F.element_at(words, 1).isin(*NEVER_FIRST) | F.element_at(words, -1).isin(*NEVER_LAST)
    dangling = reduce(lambda c, d: c | F.endswith(s, F.lit(d)), DANGLING, F.lit(False))
    ok = (F.size(words) >= 2) & (F.size(words) <= longest) & ~reference_like(text) & ~too_generic(text) & ~s.rlike(r"^[\d\s.,/%-]+$") & ~dangling
    return F.coalesce(F.when(F.size(words) >= 2, ok & ~ends).otherwise(F.lit(False)), F.lit(False))


def guess_labels(text: Column, most: int = 3) -> Column:
    """Labels by key words, in the fixed order, at most ``most``."""
    s = tx.surface(text)
    has = lambda words: reduce(lambda c, w: c | F.contains(s, F.lit(w)), words, F.lit(False))
    base = F.array_compact(F.array(*[F.when(has(words), F.lit(label)) for label, words in KEYWORDS.items()]))
    paper = has(["giấy phép lái xe", "giấy đăng ký", "chứng nhận"])
    unfit = F.startswith(s, F.lit("không có giấy phép lái xe")) | F.contains(s, F.lit("chưa đủ tuổi"))
    acts = F.startswith(s, F.lit("không ")) & has(["mũ", "chấp hành", "cài quai"]) & ~has(["gương", "giấy phép"])
    more = F.array_compact(F.array(F.when(paper, F.lit("DOCUMENT")), F.when(unfit, F.lit("CONDITION")), F.when(acts, F.lit("BEHAVIOR"))))
    return F.slice(F.array_distinct(F.concat(base, more)), 1, most)


def prune(surface: Column, canonical: Column, label: Column, blocked: Column | None = None) -> Column:
    """(match_mode, graph_weight, prune_reason) of an alias, by the first rule that holds."""
    s, c = tx.surface(surface), tx.surface(F.coalesce(canonical, surface))
    either = lambda words: F.coalesce(s.isin(*words), F.lit(False)) | F.coalesce(c.isin(*words), F.lit(False))
    out = lambda mode, weight, reason: F.struct(F.lit(mode).alias("match_mode"), F.lit(weight).alias("graph_weight"), F.lit(reason).alias("prune_reason"))
    n = F.size(_words(F.coalesce(s, F.lit(""))))
    safe = reduce(lambda a, w: a | F.contains(s, F.lit(w)), SAFE, F.lit(False))
    return (
        F.when(either(KEPT), out("keep", 1.0, "always_keep"))
        .when(F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False), out("reject", 0.0, "match_blocklist"))
        .when(either(REJECTED), out("reject", 0.0, "manual_reject_generic"))
        .when(either(LOWERED), out("downweight", 0.25, "manual_downweight_generic_hub"))
        .when(n <= 1, out("downweight", 0.25, "one_token_surface"))
        .when((n <= 2) & label.isin(*SENSITIVE) & ~safe, out("downweight", 0.5, "short_surface_sensitive_label"))
        .otherwise(out("keep", 1.0, "specific_enough"))
    )


def weight(label: Column, text: Column, source: Column, confidence: Column, inherited: Column | None = None) -> Column:
    """The graph weight of a mention: importance of its label, trust in its source, less for
    inherited, generic and single-word mentions."""
    key = tx.graph_key(text)
    importance = reduce(lambda w, k: w.when(label == k, F.lit(IMPORTANCE[k])), IMPORTANCE, F.when(F.lit(False), F.lit(0.0))).otherwise(1.0)
    sure = F.least(F.greatest(F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    trust = F.when(source == "hybrid_agree", 1.10).when(source == "gliner", 0.70 * sure).when(source == "gazetteer", 0.75).otherwise(0.60)
    out = importance * trust * F.when(key.isin(*HUBS), 0.35).otherwise(1.0) * F.when(F.size(_words(key)) <= 1, 0.65).otherwise(1.0)
    if inherited is not None:
        out = out * F.when(inherited, 0.35).otherwise(1.0)
    return F.round(out, 6)


def entity_id(label: Column, canonical: Column, text: Column) -> Column:
    return tx.stable_id("ent_", label, tx.graph_key(F.coalesce(F.nullif(canonical, F.lit("")), text, F.lit(""))))


def blocklist(lines: DataFrame, value: str = "value") -> DataFrame:
    """``surface``: the entries of a list file, without comments, marks of order and case."""
    plain = F.lower(tx.strip(F.element_at(F.split(F.regexp_replace(value, "^﻿", ""), "#"), 1)))
    return lines.select(plain.alias("surface")).where("surface <> ''").distinct()


def pruned(aliases: DataFrame, blocked: DataFrame | None = None, keep_rejected: bool = False) -> DataFrame:
    """Aliases (surface, canonical, label and more) with their match mode, weight and reason;
    rejected ones are left out unless asked for."""
    rows = aliases.withColumn("_s", tx.surface(F.col("surface"))).withColumn("_c", tx.surface(F.coalesce("canonical", "surface")))
    hit = F.lit(False)
    if blocked is not None:
        names = blocked.select(F.col("surface").alias("_b")).distinct()
        rows = rows.join(names.withColumn("_x", F.lit(True)), F.col("_s") == F.col("_b"), "left").drop("_b")
        rows = rows.join(names.select(F.col("_b").alias("_d")).withColumn("_y", F.lit(True)), F.col("_c") == F.col("_d"), "left").drop("_d")
        hit = F.coalesce("_x", F.lit(False)) | F.coalesce("_y", F.lit(False))
    out = rows.withColumn("_p", prune(F.col("surface"), F.col("canonical"), F.col("label"), hit)).select(*aliases.columns, "_p.*")
    return out if keep_rejected else out.where("match_mode <> 'reject'")


def accepted(reviewed: DataFrame, least: int = 8, conflicts: bool = False) -> DataFrame:
    """Reviewed surfaces (status, count, label, label_conflict) fit for a gazetteer, with the
    reason for the others: ``skip_reason`` null means accepted."""
    reason = F.when(F.col("status") != "accept", "status").when(F.col("count") < least, "low_count").when(F.coalesce("label_conflict", F.lit(False)) & F.lit(not conflicts), "label_conflict").when(~F.col("label").isin(*LABELS), "label")
    return reviewed.withColumn("skip_reason", F.when(F.col("label").isNull(), "label").otherwise(reason))


def canonical(aliases: DataFrame) -> DataFrame:
    """``label, canonical, aliases, count, min_graph_weight, is_generic_hub``: aliases of one
    entity, the longest first."""
    weight_, mode = (F.col(c) if c in aliases.columns else F.lit(d) for c, d in (("graph_weight", 1.0), ("match_mode", "keep")))
    rows = aliases.groupBy("label", "canonical").agg(F.collect_set("surface").alias("s"), F.sum("count").alias("count"), F.min(weight_).alias("min_graph_weight"), F.bool_or(mode == "downweight").alias("is_generic_hub"))
    longest = F.transform(F.array_sort(F.transform("s", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda y: y["x"])
    return rows.select("label", "canonical", longest.alias("aliases"), "count", "min_graph_weight", "is_generic_hub")


def seeds(aliases: DataFrame, most: int = 30) -> DataFrame:
    """``label, surface, canonical, source``: per label the best ``most`` aliases, kept before
    lowered, longer before shorter."""
    rows = aliases.where(F.col("label").isin(*LABELS) & (F.coalesce("match_mode", F.lit("keep")) != "reject")).withColumn("surface", tx.surface(F.col("surface"))).where("surface <> ''").dropDuplicates(["label", "surface"])
    order = Window.partitionBy("label").orderBy(F.when(F.coalesce("match_mode", F.lit("keep")) == "keep", 0).otherwise(1), F.desc(F.length("surface")), "surface")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("label", "surface", F.coalesce("canonical", "surface").alias("canonical"), F.lit("gazetteer_pruned").alias("source"))


def union_seeds(*sources: DataFrame) -> DataFrame:
    """Seeds of several sources, one per label and surface; hand-made core ones win, then the
    source named first."""
    out = None
    for i, rows in enumerate(sources):
        rows = rows.select("label", "surface", "canonical", "source").withColumn("_o", F.when(F.col("source") == "manual_core", -1).otherwise(i))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("label", "surface").agg(F.min_by(F.struct("canonical", "source"), F.struct("_o", "canonical")).alias("b")).select("label", "surface", "b.*")


def keyword_score(df: DataFrame, key: str, text: str, around: str, words: dict[str, list[str]], least: int = 1) -> DataFrame:
    """``key, score, labels``: two for each key word in the text, one each for the words for
    vehicle and for papers; key words that are only around it add their label once something
    was found before. Texts under ``least`` are left out."""
    low, ctx = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(around, F.lit("")))
    score, labels = F.lit(0), []
    for label, list_ in words.items():
        own = reduce(lambda a, w: a + F.contains(low, F.lit(w)).cast("int"), list_, F.lit(0))
        near = reduce(lambda a, w: a | (F.contains(ctx, F.lit(w)) & ~F.contains(low, F.lit(w))), list_, F.lit(False))
        score = score + 2 * own
        labels.append(F.when((own > 0) | (near & (score > 0)), F.lit(label)))
    vehicle, paper = low.rlike(r"(?U)\bxe\b"), low.rlike(r"(?U)\b(?:giấy|chứng nhận|biên bản)\b")
    score = score + vehicle.cast("int") + paper.cast("int")
    labels += [F.when(vehicle, F.lit("VEHICLE")), F.when(paper, F.lit("DOCUMENT"))]
    out = df.select(key, score.alias("score"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("labels"))
    return out.where(F.col("score") >= least)


def link_summary(links: DataFrame, package: str, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Links per package and label with the sentences they are in (and over all: null), and
    the ``top`` entities of each package."""
    counts = links.rollup(package, "label").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("sentence_id").alias("n_sentences"))
    per = links.groupBy(package, "entity").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(package).orderBy(F.desc("n"), "entity")
    return counts, per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
