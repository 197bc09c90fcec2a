"""Queries of the text functions over the corpus tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import text as tx
from statuta.session import table


def fold_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units share a match key, for keys of more than one unit."""
    units = table(spark, sf_dir, "units").select("unit_id", tx.match_key(F.col("content")).alias("match_key"))
    return units.where("match_key <> ''").groupBy("match_key").agg(F.countDistinct("unit_id").alias("n_units")).where("n_units > 1")


def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "sentences").select("sentence_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sentence_id").alias("n_sentences"))


def text_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sentences").where(F.col("text").isNotNull())
    own = F.md5("text")
    return rows.select("sentence_id", own.alias("content_hash"), tx.stable_id("s", F.col("source_unit_id"), F.col("document_number"), F.col("text")).alias("stable_id"), (own == F.col("text_hash")).alias("as_stored")).distinct()


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "units").select("unit_id", F.explode(tx.numbers(F.col("content"))).alias("number"))
    return found.groupBy("number").agg(F.countDistinct("unit_id").alias("n_units"))


def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "units").select("unit_id", F.explode(tx.dates(F.col("content"))).alias("iso_date")).distinct()


def path_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path_text")
    levels = [tx.path_level(path, name).alias(column) for column, name in (("article", "Điều"), ("clause", "Khoản"), ("point", "Điểm"))]
    return table(spark, sf_dir, "units").select("unit_id", *levels).distinct()


def document_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.col("document_number").isNotNull())
    return rows.select("document_number", tx.document_number(F.col("document_number")).alias("number_key"), tx.compact_key(F.col("document_number")).alias("compact_key"), tx.slug(F.col("title")).alias("title_slug")).distinct()


def register_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "effectivity_index")
    clean = [tx.none_if_null(F.col(c)).alias(c) for c in ("effective_from", "effective_to", "effective_to_source_document_number")]
    return rows.select("document_id", *clean, tx.truth(F.col("in_corpus")).alias("known")).distinct()


QUERIES = {f.__name__: f for f in (fold_normalise, token_frequency, text_hash_ids, number_tokens, date_mentions, path_selectors, document_slugs, register_clean)}

def _compat_sql() -> tuple[str, str, str]:
    """Compatibility forms, from the Unicode tables: pairs of one character for translate,
    and nested replacements for those of several."""
    one = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in (0xA0, *range(0xAA, 0xC0), *range(0x2000, 0x2080), *range(0x2080, 0x20A0), 0x3000, *range(0xFF01, 0xFF5F), *range(0x2460, 0x2469))}
    one = {k: v for k, v in one.items() if len(v) == 1 and v.isascii() and k != v and v != "'"}
    nested = "lower({0})"
    for c in (0xB4, 0xA8, 0xAF, 0xB8, *range(0x2D8, 0x2DE), *range(0xBC, 0xBF), 0x2026, 0x2103, 0x2109, 0x2116, 0x2122, *range(0x2150, 0x215F), *range(0x2161, 0x2164), *range(0x2165, 0x2169), *range(0x216A, 0x216C), 0x33A1, 0x339D, 0x339C, 0x338F, *range(0xFB00, 0xFB05)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii()).lower()
        nested = f"replace({nested}, '{chr(c).lower()}', '{plain}')"
    braces = lambda t: t.replace("{", "{{").replace("}", "}}")
    return nested, braces("".join(one)), braces("".join(one.values()))


_NESTED, _ONE, _PLAIN = _compat_sql()
_FOLD = f"regexp_replace(replace(strip_accents(translate({_NESTED}, '{_ONE}', '{_PLAIN}')), 'đ', 'd'), '[^\\x00-\\x7F]', '', 'g')"


def _key(col: str) -> str:
    return f"trim(regexp_replace({_FOLD.format(col)}, '[^a-z0-9]+', ' ', 'g'))"


KEY_SQL = _key

_NULL = "CASE WHEN lower(trim({0})) IN ('null', 'none', 'nan', 'nat', '') THEN NULL ELSE trim({0}) END"

SQL = {
    "fold_normalise": f"SELECT match_key, count(DISTINCT unit_id) AS n_units FROM (SELECT unit_id, {_key('content')} AS match_key FROM units) WHERE match_key <> '' GROUP BY 1 HAVING count(DISTINCT unit_id) > 1",
    "token_frequency": f"SELECT token, count(*) AS n, count(DISTINCT sentence_id) AS n_sentences FROM (SELECT sentence_id, unnest(string_split({_key('text')}, ' ')) AS token FROM sentences WHERE text IS NOT NULL) WHERE token <> '' GROUP BY 1",
    "text_hash_ids": "SELECT DISTINCT sentence_id, md5(text) AS content_hash, 's' || substr(md5(coalesce(source_unit_id, '') || '|' || coalesce(document_number, '') || '|' || text), 1, 16) AS stable_id, md5(text) = text_hash AS as_stored FROM sentences WHERE text IS NOT NULL",
    "number_tokens": r"""SELECT CASE WHEN regexp_matches(x, '^\d{1,3}(\.\d{3})+(,\d+)?$') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '.') END AS number, count(DISTINCT unit_id) AS n_units
        FROM (SELECT unit_id, unnest(regexp_extract_all(content, '\d+(?:[.,]\d+)*')) AS x FROM units) GROUP BY 1""",
    "date_mentions": r"""WITH found AS (
        SELECT unit_id, unnest(regexp_extract_all(content, '\b(\d{1,2}/\d{1,2}/\d{4})\b', 1)) AS d FROM units
        UNION ALL SELECT unit_id, regexp_replace(unnest(regexp_extract_all(content, 'ngày (\d{1,2} tháng \d{1,2} năm \d{4})\b', 1)), ' tháng | năm ', '/', 'g') FROM units)
        SELECT DISTINCT unit_id, strftime(try_strptime(d, '%d/%m/%Y'), '%Y-%m-%d') AS iso_date FROM found WHERE try_strptime(d, '%d/%m/%Y') IS NOT NULL""",
    "path_selectors": "SELECT DISTINCT unit_id, "
    + ", ".join(f"nullif(regexp_extract(path_text, '(?:^|> ){name} ([^ >]+)', 1), '') AS {column}" for column, name in (("article", "Điều"), ("clause", "Khoản"), ("point", "Điểm")))
    + " FROM units",
    "document_slugs": f"""SELECT DISTINCT document_number, upper(regexp_replace(regexp_replace(document_number, '\\s+', '', 'g'), '[‐‑–—−]', '-', 'g')) AS number_key,
        regexp_replace({_FOLD.format('document_number')}, '[^a-z0-9]', '', 'g') AS compact_key,
        CASE WHEN length(s) > 96 THEN substr(s, 1, 80) || '_' || substr(md5(s), 1, 8) ELSE s END AS title_slug
        FROM (SELECT document_number, replace({_key('title')}, ' ', '_') AS s FROM documents WHERE document_number IS NOT NULL)""",
    "register_clean": f"""SELECT DISTINCT document_id, {_NULL.format('effective_from')} AS effective_from, {_NULL.format('effective_to')} AS effective_to, {_NULL.format('effective_to_source_document_number')} AS effective_to_source_document_number,
        CASE WHEN lower(trim(in_corpus)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(in_corpus)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS known FROM effectivity_index""",
}
