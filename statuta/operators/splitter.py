"""Legal sentences of passages with the engine's own ids: enumerators and abbreviations
don't end a sentence, long semicolon lists are divided, repeats in a passage are dropped.

Built from JVM expressions only. (Boundaries in every script, with offsets, are another
operator.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx

_HELD = ""  # stands for a full stop that ends nothing
# What is protected, and by what.
_RULES = (
    (r"(?<=\d)\.(?=\d)", _HELD),
    (r"(?iu)\b(TP|TS|ThS)\.(?=\s*\p{Lu})", "$1" + _HELD),
    (r"(?iu)\b(P?GS)\.(?=\s*TS)", "$1" + _HELD),
    (r"(?iu)(^|[\"'(\[{:;.!?]\s*|(?:Điều|Khoản|Mục|Chương|Phần|Bảng|Mẫu)\s+)(\d+\p{L}?(?:" + _HELD + r"\d+\p{L}?)*)\.(?=\s*\S)", "$1$2" + _HELD),
)
_END = r"(?<=(?<!\.)[.!?])(?!\.)(?=[ \"')\]}]*(?:[\p{Lu}\d\-–•]|$))"


def sentences(text: Column) -> Column:
    """The distinct sentences of a text, in order of first appearance; null and wordless
    texts have none."""
    plain = tx.squeeze(F.translate(text, "“”‘’", "\"\"''"))
    for pattern, mark in _RULES:
        plain = F.regexp_replace(plain, pattern, mark)
    parts = F.transform(F.split(plain, _END), lambda s: F.trim(F.replace(s, F.lit(_HELD), F.lit("."))))

    def listed(sentence: Column) -> Column:
        items = F.filter(F.transform(F.split(sentence, ";"), lambda s: F.trim(s)), lambda s: s != "")
        several = F.size(F.filter(items, lambda s: F.length(s) >= 12)) >= 2
        return F.when(several, F.transform(items, lambda s, i: F.when(i < F.size(items) - 1, F.concat(s, F.lit(";"))).otherwise(s))).otherwise(F.array(sentence))

    flat = F.flatten(F.transform(parts, listed))
    worded = F.filter(flat, lambda s: s.rlike(r"[\p{L}\p{N}]") & ~s.rlike(r"^\d+(\.\d+)*\.?$"))
    return F.coalesce(F.array_distinct(worded), F.array().cast("array<string>"))


def passages_to_sentences(df: DataFrame, key: str, text: str, unit_type: str, whole: tuple[str, ...] = ("table_row",), shortest: int = 3) -> DataFrame:
    """``key, sentence_id, sentence_order, sentence_type, text, text_hash``. Orders count
    after repeats are dropped, so skipped short sentences leave gaps; units of the ``whole``
    types are one sentence each."""
    kept = F.coalesce(F.col(unit_type).isin(*whole), F.lit(False))
    plain = tx.squeeze(F.col(text))
    parts = F.when(kept, F.when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>"))).otherwise(sentences(F.col(text)))
    rows = df.where(F.col(key).isNotNull()).select(key, kept.alias("_whole"), F.col(unit_type).alias("_type"), F.posexplode(parts).alias("_pos", "text"))
    rows = rows.where(F.col("_whole") | (F.length("text") >= shortest)).withColumn("sentence_order", F.col("_pos") + 1)
    return rows.select(key, F.format_string("%s.s%03d", F.col(key), F.col("sentence_order")).alias("sentence_id"), "sentence_order", F.when(F.col("_whole"), F.concat("_type", F.lit("_sentence"))).otherwise("legal_sentence").alias("sentence_type"), "text", F.md5("text").alias("text_hash"))
