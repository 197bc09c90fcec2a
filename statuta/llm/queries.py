"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import encoding, mixing, ranking, repetition, scripts, sentences, tokens
from statuta.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = sentences.split_table(table(spark, sf_dir, "units"), "units", "unit_id", "content")
    stored = sentences.split_table(table(spark, sf_dir, "sentences"), "sentences", "sentence_id", "text")
    return sentences.sentences(units.unionByName(stored))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.components(table(spark, sf_dir, "retrieval_results"), "question_id", "passage_id", "score_components", ranking.COMPONENTS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best(ranking.percentiles(_scored(spark, sf_dir)), 3)


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_all(ranking.percentiles(_scored(spark, sf_dir)))


_TEXTS = (("units", "unit_id", "content"), ("sentences", "sentence_id", "text"))


def _pair_model(spark: SparkSession, sf_dir: str) -> encoding.Model:
    texts = [table(spark, sf_dir, name).select(F.col(text).alias("value")) for name, _, text in _TEXTS]
    return encoding.Model.of(encoding.pair_counts(texts[0].unionByName(texts[1])))


def _examined(spark: SparkSession, sf_dir: str, examine, **options) -> DataFrame:
    model = _pair_model(spark, sf_dir)
    units, stored = [examine(table(spark, sf_dir, name), name, record, text, model, **options) for name, record, text in _TEXTS]
    return encoding.once(units.unionByName(stored))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examined(spark, sf_dir, encoding.examine, find_only=True).select("src", "record_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled records, whether nothing was lost, and their text as far as it could be restored."""
    return _examined(spark, sf_dir, encoding.examine)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examined(spark, sf_dir, scripts.examine).select("src", "record_id")


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in the one form, garbled ones restored first."""
    return _examined(spark, sf_dir, scripts.examine, everything=True)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    counted = tokens.count_table(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")
    return mixing.mix(counted, table(spark, sf_dir, "mix_targets"), exact=exact)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, per target source, in a mix of one pass over their tokens."""
    return _mixed(spark, sf_dir)[1]


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mixed(spark, sf_dir)[0]


def p7_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the largest total at which no source with documents misses its target."""
    return _mixed(spark, sf_dir, exact=True)[1]


def p7_drawn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix of ``p7_mix_exact``."""
    return _mixed(spark, sf_dir, exact=True)[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By divergence from the language at the text's length; what stands out is counted."""
    return repetition.found(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_share(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.divergence(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


_P2 = """
WITH raw AS (
  SELECT DISTINCT question_id, passage_id, score_components AS c FROM retrieval_results WHERE question_id IS NOT NULL AND passage_id IS NOT NULL),
v AS (
  SELECT question_id, passage_id,
         max(CASE WHEN isnan(c.dense) THEN NULL ELSE c.dense END) AS d, max(CASE WHEN isnan(c.bm25) THEN NULL ELSE c.bm25 END) AS b,
         max(CASE WHEN isnan(c.graph) THEN NULL ELSE c.graph END) AS g, max(CASE WHEN isnan(c.reference) THEN NULL ELSE c.reference END) AS r
  FROM raw GROUP BY ALL),
p AS (
  SELECT question_id, passage_id,
         CASE WHEN d IS NULL THEN 0.0 ELSE percent_rank() OVER (PARTITION BY question_id ORDER BY d NULLS FIRST) END AS d,
         CASE WHEN b IS NULL THEN 0.0 ELSE percent_rank() OVER (PARTITION BY question_id ORDER BY b NULLS FIRST) END AS b,
         CASE WHEN g IS NULL THEN 0.0 ELSE percent_rank() OVER (PARTITION BY question_id ORDER BY g NULLS FIRST) END AS g,
         CASE WHEN r IS NULL THEN 0.0 ELSE percent_rank() OVER (PARTITION BY question_id ORDER BY r NULLS FIRST) END AS r
  FROM v),
k AS (SELECT question_id, passage_id, list_sort([d, b, g, r]) AS own FROM p),
f AS (
  SELECT question_id, passage_id,
         row_number() OVER (PARTITION BY question_id ORDER BY own[1] DESC, own[2] DESC, own[3] DESC, own[4] DESC, passage_id) AS fused_rank
  FROM k)
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_normalized": p4_normalized,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_drawn": p7_drawn,
    "p7_mix_exact": p7_mix_exact,
    "p7_drawn_exact": p7_drawn_exact,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_divergence": p8_divergence,
}

SQL = {
    "p2_found": _P2 + "SELECT question_id, fused_rank, passage_id FROM f WHERE fused_rank <= 3",
    "p2_ranking": _P2 + "SELECT question_id, fused_rank, passage_id FROM f",
}
