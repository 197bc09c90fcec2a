"""The tree of a legal text from its ordered lines, by window functions.

A line opens a unit if it begins with a heading of one of seven levels. Its parent is
the latest open unit of a higher level; a unit closes where one of its own or a higher
level opens. Lines that open nothing belong to the unit open there. No state machine is
needed: a level is open iff its last heading comes after the last one of every higher level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as tx

_NUMERAL = r"[IVXLCDM]+"
# Heading levels from the top, with the pattern of their number; the case of letters doesn't matter but in clauses.
LEVELS = {
    "phan": r"(?iu)^Phần\s+(thứ\s+\p{L}+|[IVXLCDM\d]+)",
    "chuong": r"(?iu)^Chương\s+([IVXLCDM\d]+)",
    "muc": rf"(?iu)^Mục\s+(\d+|{_NUMERAL})",
    "tieu_muc": rf"(?iu)^Tiểu\s*mục\s+(\d+|{_NUMERAL})",
    "dieu": r"(?iu)^Điều\s+(\d+[a-zA-Z]*)",
    "khoan": r"^(\d+)\.",
    "diem": r"(?iu)^([a-zđ])\)",
}
NAMES = {"phan": "Phần", "chuong": "Chương", "muc": "Mục", "tieu_muc": "Tiểu mục", "dieu": "Điều", "khoan": "Khoản", "diem": "Điểm"}

# The same for annexes.
ANNEX_LEVELS = {
    "roman": rf"^({_NUMERAL})\.\s",
    "alpha": r"^([A-ZĐ])\.\s",
    "decimal_1": r"^(\d+)\.\s",
    "decimal_2": r"^(\d+\.\d+)\.?\s",
    "decimal_3": r"^(\d+(?:\.\d+){2,})\.?\s",
    "point": r"^([a-zđ])\)\s*",
    "bullet": r"^([-–•])\s",
}
ANNEX_NAMES = {"roman": "Mục", "alpha": "Phần", "decimal_1": "", "decimal_2": "", "decimal_3": "", "point": "Điểm", "bullet": ""}


def lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, ord, line``: the non-blank lines of each text, numbered from 0 by place."""
    rows = df.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("ord", "line"))
    return rows.select("doc", "ord", tx.strip(F.col("line")).alias("line")).where("line <> ''")


def outline(rows: DataFrame, levels: dict[str, str] = LEVELS, names: dict[str, str] = NAMES) -> DataFrame:
    """``doc, ord, unit_type, label, parent_ord, path_text, line`` of ordered lines. The
    first level whose pattern fits a line is taken; ``names`` are written in the path."""
    label = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    kind = reduce(lambda w, k: w.when(F.col("line").rlike(levels[k]), F.lit(k)), levels, F.when(F.lit(False), F.lit("")))
    typed = rows.withColumn("unit_type", kind).withColumn("label", F.coalesce(*[label(p) for p in levels.values()]))
    so_far = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("unit_type")]
    named = F.concat_ws(" ", F.nullif(word, F.lit("")), F.col("label"))
    opened = F.struct(F.col("ord").alias("o"), named.alias("n"))
    last = typed.select("*", *[F.last(F.when(F.col("unit_type") == k, opened), ignorenulls=True).over(so_far).alias(k) for k in levels])
    order = list(levels)
    # open levels: those whose last heading comes after every higher level's
    is_open = {k: F.col(k).isNotNull() & reduce(lambda c, h: c & (F.col(h).isNull() | (F.col(h)["o"] < F.col(k)["o"])), order[:i], F.lit(True)) for i, k in enumerate(order)}
    own = {k: F.col("unit_type") == k for k in order}
    above = [F.when(is_open[k] & ~F.coalesce(own[k], F.lit(False)), F.col(k)["o"]) for k in reversed(order)]
    path = F.array_join(F.array_compact(F.array(*[F.when(is_open[k], F.col(k)["n"]) for k in order])), " > ")
    return last.select("doc", "ord", F.coalesce("unit_type", F.lit("text")).alias("unit_type"), "label", F.coalesce(*above).alias("parent_ord"), path.alias("path_text"), "line")
