"""Events of validity in legal text: when documents and units begin, and what they end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx

# Parts of the patterns.
_DAY = r"(?:ngày )?(\d{1,2} tháng \d{1,2} năm \d{4}|\d{1,2}/\d{1,2}/\d{4})"
_FROM = r"(?:kể từ |kể |từ )"
_THIS = r"((?:Bộ luật|Luật|Nghị định|Thông tư|Quyết định|Nghị quyết|Văn bản) này)"
_FORCE = r"có hiệu lực(?: thi hành)?"
_KINDS = r"(?:Thông tư liên tịch|Bộ luật|Luật|Nghị định|Thông tư|Quyết định|Nghị quyết|Chỉ thị)"
_NUMBER = r"(\d+/(?:\d{4}/)?[A-ZĐ]+[0-9]*(?:-[A-ZĐ0-9]+)*)"

DOCUMENT_START = rf"(?:^|[^\p{{L}}]){_THIS} {_FORCE} {_FROM}{_DAY}"
UNIT_START = rf"((?:điểm [a-zđ] )?(?:khoản \d+[a-z]? )?Điều \d+[a-z]?)(?: (?:của )?{_THIS[1:-1]})? {_FORCE} {_FROM}{_DAY}"
SIGNING = rf"{_THIS} {_FORCE} {_FROM}?ngày ký"
AFTER_SIGNING = rf"{_THIS} {_FORCE} sau (\d{{1,3}}) ngày,? {_FROM}?ngày ký"
REPEAL = rf"(?:bãi bỏ|thay thế|hủy bỏ) {_KINDS}(?: \p{{L}}+){{0,8}}? số {_NUMBER}"
ENDED = rf"{_KINDS}(?: \p{{L}}+){{0,8}}? số {_NUMBER}(?:[^.;]{{0,200}}?) (?:hết hiệu lực|chấm dứt hiệu lực|ngưng hiệu lực)"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(group))


def _date(raw: Column) -> Column:
    return F.date_format(F.try_to_date(F.regexp_replace(raw, " tháng | năm ", "/"), "d/M/yyyy"), "yyyy-MM-dd")


def extract(df: DataFrame, key: str, text: str, issued: str | None = None) -> DataFrame:
    """``key, event_type, target, event_date, confidence``. Types: document_start,
    unit_start, repeal. A start without an existing date is left out; one relative to the
    signing needs the column ``issued`` (ISO date). Repeals have no date of their own, see
    ``date_repeals``."""
    plain = tx.squeeze(F.col(text))
    event = lambda kind, target, day, confidence: F.struct(F.lit(kind).alias("event_type"), target.alias("target"), day.alias("event_date"), F.lit(confidence).cast("double").alias("confidence"))
    none = F.lit(None).cast("string")
    starts = F.zip_with(_all(plain, DOCUMENT_START, 1), _all(plain, DOCUMENT_START, 2), lambda t, d: event("document_start", t, _date(d), 0.98))
    units = F.zip_with(_all(plain, UNIT_START, 1), _all(plain, UNIT_START, 2), lambda t, d: event("unit_start", t, _date(d), 0.93))
    repeals = F.transform(F.array_distinct(F.concat(_all(plain, REPEAL, 1), _all(plain, ENDED, 1))), lambda t: event("repeal", tx.document_number(t), none, 0.80))
    found = [starts, units, repeals]
    if issued:
        day = F.try_to_date(F.col(issued), "yyyy-MM-dd")
        shown = lambda d: F.date_format(d, "yyyy-MM-dd")
        found.append(F.transform(_all(plain, SIGNING, 1), lambda t: event("document_start", t, shown(day), 0.90)))
        found.append(F.zip_with(_all(plain, AFTER_SIGNING, 1), _all(plain, AFTER_SIGNING, 2), lambda t, n: event("document_start", t, shown(F.date_add(day, n.cast("int"))), 0.88)))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.explode(F.concat(*found)).alias("e")).select(key, "e.*")
    return rows.where("event_type = 'repeal' or event_date is not null").distinct()


def date_repeals(events: DataFrame, document: str) -> DataFrame:
    """Repeals without a date take the last start of their document; their confidence is at least .76 then."""
    starts = events.where("event_type = 'document_start'").groupBy(document).agg(F.max("event_date").alias("_start"))
    late = (F.col("event_type") == "repeal") & F.col("event_date").isNull() & F.col("_start").isNotNull()
    joined = events.join(starts, document, "left")
    return joined.withColumn("confidence", F.when(late, F.greatest("confidence", F.lit(0.76))).otherwise(F.col("confidence"))).withColumn("event_date", F.when(late, F.col("_start")).otherwise(F.col("event_date"))).drop("_start")
