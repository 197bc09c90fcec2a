"""Queries of problem 5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.operators import orphans as op
from statuta.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, mentions = table(spark, sf_dir, "units"), table(spark, sf_dir, "ref_mentions")
    parents = op.corpus_targets(units, table(spark, sf_dir, "attachments"), table(spark, sf_dir, "effectivity_index"))
    return op.orphans(op.corpus_references(units, mentions), parents, op.ranges_for(units, mentions))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphan_report(p5_found(spark, sf_dir))


_FOUND = """
WITH refs AS (
  SELECT 'units' AS src_table, 'parent_id' AS src_field, unit_id AS record_id, parent_id AS target_key, 'unit' AS space, ingested_at AS seen_at FROM units
  UNION ALL SELECT 'ref_mentions', 'target_id', mention_id, resolution.target_id, coalesce(resolution.target_type, 'unit'), ingested_at FROM ref_mentions
  UNION ALL SELECT 'ref_mentions', 'source_unit_id', mention_id, source_unit_id, 'unit', ingested_at FROM ref_mentions),
firsts AS (SELECT src_table, src_field, record_id, min(seen_at) AS first_at FROM refs GROUP BY ALL),
wanted AS (
  SELECT DISTINCT r.src_table, r.src_field, r.record_id, r.target_key, r.space, f.first_at
  FROM refs r JOIN firsts f USING (src_table, src_field, record_id) WHERE r.target_key <> ''),
keys AS (
  SELECT 'unit' AS space, unit_id AS k, min(ingested_at) AS first_at,
         max_by(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END, ingested_at) AS gone FROM units GROUP BY unit_id
  UNION ALL SELECT 'attachment', attachment_id, min(ingested_at), 0 FROM attachments GROUP BY attachment_id
  UNION ALL SELECT 'document', document_id, min(ingested_at), 0 FROM effectivity_index GROUP BY document_id),
found AS (
  SELECT w.src_table, w.src_field, w.record_id, w.target_key,
         CASE WHEN k.k IS NULL THEN 'missing' WHEN k.gone = 1 THEN 'deleted' WHEN k.first_at > w.first_at THEN 'late' END AS orphan_kind,
         strftime(w.first_at, '%Y-%m') AS period
  FROM wanted w LEFT JOIN keys k ON k.space = w.space AND k.k = w.target_key)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

SQL = {
    "p5_found": _FOUND + "SELECT * FROM found WHERE orphan_kind IS NOT NULL",
    "p5_report": _FOUND
    + """SELECT src_table, src_field, orphan_kind, period, count(*) AS n_orphans, count(DISTINCT target_key) AS n_keys
         FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL""",
}
