"""Queries on references between chunks, vectors, golden and docs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.references import find_orphans, orphan_report, parents_by_key, references
from millrace.plans.registry import Registry
from millrace.tables import load

R = Registry()

_SQL = """
WITH d AS (
  SELECT path AS key, min(CASE WHEN deleted_at IS NULL THEN coalesce(epoch_us(ingested_at), -9223372036854775807) END) AS since
  FROM docs WHERE path IS NOT NULL GROUP BY 1),
c AS (
  SELECT id AS key, min(CASE WHEN deleted_at IS NULL THEN coalesce(epoch_us(ingested_at), -9223372036854775807) END) AS since
  FROM chunks WHERE id IS NOT NULL GROUP BY 1),
refs AS (
  SELECT 'chunks' AS ref_table, CAST(x.id AS VARCHAR) AS ref_id, x.ingested_at AS seen, d.key IS NOT NULL AS there, d.since
  FROM chunks x LEFT JOIN d ON d.key = x.doc WHERE x.doc IS NOT NULL
  UNION ALL
  SELECT 'golden', x.id, x.added_at, d.key IS NOT NULL, d.since
  FROM golden x LEFT JOIN d ON d.key = x.gold_doc WHERE x.gold_doc IS NOT NULL
  UNION ALL
  SELECT 'vectors', CAST(x.chunk_id AS VARCHAR), x.ingested_at, c.key IS NOT NULL, c.since
  FROM vectors x LEFT JOIN c ON c.key = x.chunk_id WHERE x.chunk_id IS NOT NULL),
found AS (
  SELECT DISTINCT ref_table, ref_id, strftime(seen AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN NOT there THEN 'missing' WHEN since IS NULL THEN 'deleted'
         WHEN since > epoch_us(seen) THEN 'late' END AS state
  FROM refs)
"""


def _found(spark, where):
    docs = parents_by_key(load(spark, where, "docs"), "path", "ingested_at", "deleted_at")
    chunks = load(spark, where, "chunks")
    to_docs = references("chunks", chunks, F.col("id"), "doc", "ingested_at").unionByName(
        references("golden", load(spark, where, "golden"), F.col("id"), "gold_doc", "added_at")
    )
    to_chunks = references("vectors", load(spark, where, "vectors"), F.col("chunk_id"), "chunk_id", "ingested_at")
    of_chunks = parents_by_key(chunks, "id", "ingested_at", "deleted_at")
    return find_orphans(to_docs, docs).unionByName(find_orphans(to_chunks, of_chunks))


@R.query("p1_found", _SQL + "SELECT ref_table, ref_id, state FROM found WHERE state IS NOT NULL")
def p1_found(spark, where):
    """Every broken reference of chunks, golden and vectors."""
    return _found(spark, where).select("ref_table", "ref_id", "state")


@R.query(
    "p1_report",
    _SQL + "SELECT ref_table, period, state, count(*) AS n_refs FROM found WHERE state IS NOT NULL GROUP BY ALL",
)
def p1_report(spark, where):
    """Broken references per table and month."""
    return orphan_report(_found(spark, where))
