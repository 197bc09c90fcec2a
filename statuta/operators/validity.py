"""Validity intervals of documents and units, half open: [from, to)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx


def register(df: DataFrame) -> DataFrame:
    """One row per document of the register: typed dates and flag. Of several rows the
    earliest start and end that any of them names hold."""
    day = lambda c: F.try_to_date(tx.none_if_null(F.col(c)), "yyyy-MM-dd")
    return df.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("document_number").alias("document_number"), F.min(day("effective_from")).alias("valid_from"), F.min(day("effective_to")).alias("valid_to"), F.max(tx.truth(F.col("in_corpus"))).alias("in_corpus"))


def active(start: Column, end: Column, as_of: Column) -> Column:
    """Whether an interval covers a day; an unknown start is null, an open end never ends."""
    return F.when(start.isNull(), None).otherwise((start <= as_of) & (end.isNull() | (as_of < end)))


def best_dates(events: DataFrame, key: str, confidence: str, day: str) -> DataFrame:
    """Per key the date of the highest confidence, of equal ones the earliest."""
    best = F.min(F.struct((-F.col(confidence)).alias("c"), F.col(day).alias("d"))).alias("b")
    return events.where(F.col(day).isNotNull() & F.col(confidence).isNotNull()).groupBy(key).agg(best).select(key, F.col("b.d").alias(day), (-F.col("b.c")).alias(confidence))


def override(units: DataFrame, overrides: DataFrame) -> DataFrame:
    """The dates of each unit: its point's override, else its clause's, else its article's,
    else the document's. The first level that has a row replaces the date even with null.
    ``units``: document_id, article, clause, point, valid_from; ``overrides`` the same keys
    with empty strings for levels left open, and ``new_from``."""
    out = units
    levels = (("article", "clause", "point"), ("article", "clause"), ("article",))
    for i, level in enumerate(levels):
        blank = [c for c in ("article", "clause", "point") if c not in level]
        rows = overrides
        for c in blank:
            rows = rows.where(F.coalesce(c, F.lit("")) == "")
        for c in level:
            rows = rows.where(F.coalesce(c, F.lit("")) != "")
        rows = rows.groupBy("document_id", *level).agg(F.max(F.struct(F.col("new_from"))).alias(f"o{i}"))
        out = out.join(rows, ["document_id", *level], "left")
    hit = F.coalesce("o0", "o1", "o2")
    return out.withColumn("valid_from", F.when(hit.isNotNull(), hit["new_from"]).otherwise(F.col("valid_from"))).drop("o0", "o1", "o2")


def scope(question: Column, today: Column) -> Column:
    """(kind, from, to) of the time a question asks about: the present, a day it names, or a
    year; null if it names none. ``today`` is given, never read from the clock."""
    now = question.rlike(r"(?iuU)\b(?:hiện nay|hiện tại|hiện hành|bây giờ|hôm nay)\b")
    day = F.try_to_date(F.regexp_extract(question, r"(?U)\b(\d{1,2}/\d{1,2}/\d{4})\b", 1), "d/M/yyyy")
    year = F.regexp_extract(question, r"(?iuU)\bnăm\s+((?:19|20)\d{2})\b", 1)
    first = F.try_to_date(F.concat(F.nullif(year, F.lit("")), F.lit("-01-01")), "yyyy-MM-dd")
    slashed = question.rlike(r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b")
    out = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_day"), b.alias("to_day"))
    return F.when(now, out("point", today, today)).when(slashed, F.when(day.isNotNull(), out("point", day, day))).when(first.isNotNull(), out("year", first, F.add_months(first, 12)))


def active_in(start: Column, end: Column, asked: Column) -> Column:
    """Whether an interval covers the day, or touches the year, of a scope; open ends never
    exclude; null without a scope."""
    point = ~(F.coalesce(asked["from_day"] < start, F.lit(False)) | F.coalesce(asked["from_day"] >= end, F.lit(False)))
    year = ~(F.coalesce(start >= asked["to_day"], F.lit(False)) | F.coalesce(end <= asked["from_day"], F.lit(False)))
    return F.when(asked.isNull(), None).otherwise(F.when(asked["kind"] == "point", point).otherwise(year))


def document_dates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (document_id, document_number) with the register's dates, by id, else by number."""
    by_id = known.select("document_id", F.struct("valid_from", "valid_to").alias("_i"))
    number = tx.compact_key(tx.document_number(F.col("document_number")))
    by_number = known.where("document_number is not null").groupBy(number.alias("_k")).agg(F.min(F.struct("valid_from", "valid_to")).alias("_n"))
    out = rows.join(by_id, "document_id", "left").withColumn("_k", number).join(by_number, "_k", "left")
    hit = F.coalesce("_i", "_n")
    return out.withColumn("valid_from", hit["valid_from"]).withColumn("valid_to", hit["valid_to"]).drop("_i", "_n", "_k")


def index(events: DataFrame, corpus: DataFrame) -> DataFrame:
    """``document_key, document_id, document_number, effective_from, effective_to, in_corpus``:
    per document (by number, else id) the best start and end of its events; documents that
    are only ended by others come in as outside of the corpus. ``events``: document_number,
    document_id, event_type, event_date, confidence; ``corpus``: document_id, document_number."""
    key = lambda: F.coalesce(F.nullif(tx.compact_key(tx.document_number(F.col("document_number"))), F.lit("")), F.col("document_id"))
    keyed = events.withColumn("document_key", key()).where("document_key is not null and event_date is not null")
    best = lambda kind, name: F.min_by(F.when(F.col("event_type") == kind, F.col("event_date")), F.when(F.col("event_type") == kind, F.struct((-F.col("confidence")).alias("c"), F.col("event_date").alias("d")))).alias(name)
    dated = keyed.groupBy("document_key").agg(best("document_start", "effective_from"), best("repeal", "effective_to"), F.max("document_number").alias("_number"))
    held = corpus.withColumn("document_key", key()).where("document_key is not null").groupBy("document_key").agg(F.max("document_id").alias("document_id"), F.max("document_number").alias("document_number"))
    out = held.join(dated, "document_key", "full")
    return out.select("document_key", "document_id", F.coalesce("document_number", "_number").alias("document_number"), "effective_from", "effective_to", F.col("document_id").isNotNull().alias("in_corpus"))
