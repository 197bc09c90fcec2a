"""Agreement of answers with gold targets: containment, numbers, polarity, word recall;
citation requirements of gold spans.

All rules are column expressions. Null answers count as empty; null targets give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text as tx

# Folded phrases of refusals.
REFUSALS = ["khong tim thay can cu", "khong co can cu", "khong du can cu", "khong du ro", "khong co thong tin", "khong xac dinh"]
# Folded words that carry no content, and words that are units of numbers.
STOP = [
    "a", "an", "anh", "ap", "bi", "bo", "cac", "can", "cho", "co", "con", "cua", "da", "de", "den", "do", "duoc", "giao", "hoac", "khi", "la", "lai", "mot", "nay", "nguoi", "nhung", "phai", "qua", "quy", "tai", "theo", "thi", "trong", "tu", "va", "ve", "voi", "xe",
]
UNITS = ["chu", "diem", "dong", "gio", "kg", "km", "lan", "met", "nam", "ngay", "nguoi", "phan", "so", "tan", "thang", "tram", "trieu", "tuoi"]
# Folded phrases of denial, of assent, of open and of yes-or-no questions.
NEGATIVE = r"\b(?:khong (?:duoc|co|phai|su dung|cap|ap dung)|cam)\b"
POSITIVE = r"\b(?:duoc|co the|co quyen|phai|bat buoc)\b"
OPEN = "bao nhieu|bao lau|muc phat|thoi han|thoi gian|toc do|la gi|nhu the nao|khi nao|o dau"
BINARY = "co duoc|duoc phep|co phai|khong"
# Folded levels a citation may name, with their values.
LEVELS = {"diem": "[a-z0-9]+", "khoan": "[0-9]+[a-z]?", "dieu": "[0-9]+[a-z]?", "muc": "[0-9ivxlcdm]+", "chuong": "[0-9ivxlcdm]+", "phu luc": "[0-9ivxlcdm]+"}


def refusal(answer: Column) -> Column:
    return F.coalesce(tx.match_key(answer).rlike("|".join(REFUSALS)), F.lit(False))


def polarity(text: Column) -> Column:
    """negative, positive or null; denial is looked for first."""
    key = tx.match_key(text)
    return F.when(key.rlike(NEGATIVE), "negative").when(key.rlike(POSITIVE), "positive")


def yes_or_no(question: Column) -> Column:
    key = tx.match_key(question)
    return F.coalesce(~key.rlike(OPEN) & key.rlike(BINARY), F.lit(False))


def content(text: Column) -> Column:
    return tx.content_terms(text, STOP)


def word_recall(target: Column, answer: Column) -> tuple[Column, Column]:
    """Share and number of the target's content words (repeats count) that the answer has; 0 without any."""
    words, theirs = content(target), content(answer)
    hits = F.size(F.filter(words, lambda w: F.array_contains(theirs, w)))
    return F.coalesce(F.try_divide(hits, F.size(words)), F.lit(0.0)), hits


def numbers(text: Column) -> Column:
    """Number tokens in one spelling: thousand marks removed, decimals with a point and no
    zeros alone behind it, no leading zeros. A fraction comes with its parts. Numbers that
    touch letters are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\d])(?<!\d[.,/])\d+(?:[.,]\d+)*(?:/\d+(?:[.,]\d+)*)?(?![\p{L}\d])"), F.lit(0))

    def plain(n: Column) -> Column:
        grouped = n.rlike(r"^\d{1,3}([.,]\d{3})+$")
        dotted = F.when(n.contains(",") & ~n.contains("."), F.regexp_replace(n, r",(?=[^,]*$)", ".")).otherwise(n)
        whole = F.when(dotted.rlike(r"^[^.]*\.0+$"), F.regexp_replace(dotted, r"\.0+$", "")).otherwise(dotted)
        short = F.when(whole.rlike(r"^\d+$"), F.regexp_replace(whole, r"^0+(?=\d)", "")).otherwise(whole)
        return F.when(grouped, F.regexp_replace(n, "[.,]", "")).otherwise(short)

    def each(n: Column) -> Column:
        parts = F.transform(F.split(n, "/"), plain)
        return F.when(n.contains("/"), F.concat(F.array(F.array_join(parts, "/")), parts)).otherwise(parts)

    return F.coalesce(F.flatten(F.transform(found, each)), F.array().cast("array<string>"))


def within(needles: Column, haystack: Column) -> Column:
    """Multiset containment: every token occurs at least as often; false without needles."""
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return (F.size(needles) > 0) & F.forall(F.array_distinct(needles), lambda x: count(haystack, x) >= count(needles, x))


def targets(gold: Column) -> Column:
    """The parts of a gold answer, each once by its folded text: cut at lines, semicolons and
    ends of sentences, and at the words for "or"; parts under three words are dropped unless
    nothing is left, then the whole answer is the target."""
    pieces = F.flatten(F.transform(F.split(gold, r"\n+|;|[.?!]\s+"), lambda p: F.split(p, r"(?iu)\s+(?:còn|hoặc)\s+")))
    kept = F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^[ \t\r\n–•-]+|[ \t\r\n–•-]+$", "")), lambda p: F.size(tx.tokens(p)) >= 3)
    first = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, 1, F.when(i > 0, i).otherwise(0)), lambda q: tx.match_key(q) == tx.match_key(p)))
    whole = F.when(tx.match_key(gold) != "", F.array(tx.strip(gold))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(kept) > 0, first).otherwise(whole)


def agreement(target: Column, answer: Column, question: Column | None = None) -> Column:
    """The rule that decides: exact_containment, number_subset, yes_no_polarity and token_recall
    agree; refusal, number_mismatch, polarity_mismatch and miss don't."""
    answer = F.coalesce(answer, F.lit(""))
    share, hits = word_recall(target, answer)
    wanted, given = numbers(target), numbers(answer)
    units = F.arrays_overlap(F.array_intersect(content(target), F.array(*map(F.lit, UNITS))), F.array_intersect(content(answer), F.array(*map(F.lit, UNITS))))
    enough = (F.size(F.array_distinct(wanted)) >= 2) | F.coalesce(units, F.lit(False)) | (share >= 0.35)
    mine, theirs = polarity(target), polarity(answer)
    binary = yes_or_no(question) if question is not None else F.lit(False)
    return (
        F.when(target.isNull(), None)
        .when((tx.match_key(target) != "") & F.contains(tx.match_key(answer), tx.match_key(target)), "exact_containment")
        .when(refusal(answer), "refusal")
        .when(F.size(wanted) > 0, F.when(within(wanted, given) & enough, "number_subset").otherwise("number_mismatch"))
        .when(F.coalesce(mine != theirs, F.lit(False)), "polarity_mismatch")
        .when(binary & F.coalesce(mine == theirs, F.lit(False)) & ((share >= 0.18) | (hits >= 2)), "yes_no_polarity")
        .when((F.size(content(target)) >= 3) & (hits >= 3) & (share >= 0.9), "token_recall")
        .otherwise("miss")
    )


AGREES = ("exact_containment", "number_subset", "yes_no_polarity", "token_recall")


def requirements(span: Column) -> Column:
    """What a citation span asks for, as folded "level value" texts."""
    key = tx.match_key(span)
    found = []
    for level, value in LEVELS.items():
        found.append(F.regexp_extract_all(key, F.lit(rf"\b({level} {value})\b"), F.lit(1)))
    return F.concat(*found)


def cites(span: Column, text: Column) -> Column:
    """Whether a text has the citation: the span itself, else all it requires, else (if it
    requires nothing) all its words."""
    key, hay, asked = tx.match_key(span), tx.match_key(text), requirements(span)
    words = F.forall(tx.tokens(span), lambda w: F.contains(hay, w))
    rule = F.when(F.size(asked) == 0, words).otherwise(F.forall(asked, lambda r: F.contains(hay, r)))
    return F.coalesce((key != "") & (F.contains(hay, key) | rule), F.lit(False))


def coverage(df: DataFrame, key: str, gold: str, answer: str, question: str | None = None) -> DataFrame:
    """``key, n_targets, n_met, share``: the targets of each gold answer that the answer
    meets. Rows without a target have share 0."""
    one = df.select(key, answer, *([question] if question else []), F.explode_outer(targets(F.col(gold))).alias("_t"))
    rule = agreement(F.col("_t"), F.col(answer), F.col(question) if question else None)
    counted = one.select(key, F.col("_t").isNotNull().alias("_is"), F.coalesce(rule.isin(*AGREES), F.lit(False)).alias("_ok")).groupBy(key).agg(F.count_if("_is").alias("n_targets"), F.count_if("_ok").alias("n_met"))
    return counted.withColumn("share", F.coalesce(F.try_divide(F.col("n_met"), F.col("n_targets")), F.lit(0.0)))
