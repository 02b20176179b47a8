"""Problem 5: orphan references of relations and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.references import normal_key, orphan_report, resolve_references
from quarrylight.session import table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    rel = table(spark, root, "relations").select("rel_id", "source_id", "target_id", "extracted_at")
    ent = table(spark, root, "entities").select("mention_id", "entity_id", "source_chunk_id", "extracted_at", "deleted_at")
    chunks = table(spark, root, "chunks").select("chunk_id", "indexed_at", "deleted_at").withColumn("key", normal_key(F.col("chunk_id")))
    entities = ent.select(normal_key(F.col("entity_id")).alias("key"), "extracted_at", "deleted_at")
    # both fields of a relation go through one join: the field is part of the row's key
    ends = rel.select(
        F.explode(F.array(*[F.struct(F.struct(F.lit("relations").alias("t"), F.lit(f).alias("f"), F.col("rel_id").alias("k")).alias("row"), normal_key(F.col(f)).alias("ref")) for f in ("source_id", "target_id")])).alias("x"), "extracted_at"
    ).select("x.row", "x.ref", "extracted_at")
    homes = ent.select(F.struct(F.lit("entities").alias("t"), F.lit("source_chunk_id").alias("f"), F.col("mention_id").alias("k")).alias("row"), normal_key(F.col("source_chunk_id")).alias("ref"), "extracted_at")
    a = resolve_references(ends, "row", ["ref"], "extracted_at", entities, ["key"], "extracted_at", "deleted_at")
    b = resolve_references(homes, "row", ["ref"], "extracted_at", chunks, ["key"], "indexed_at", "deleted_at")
    return a.unionAll(b).where(F.col("state") != "ok").select(
        F.col("row.t").alias("ref_table"), F.col("row.f").alias("ref_field"), F.col("row.k").alias("row_key"), F.date_format(F.to_utc_timestamp("extracted_at", F.current_timezone()), "yyyy-MM").alias("period"), "state"
    )


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(p5_found(spark, root))


_KEY = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^entity::\s*', '')"
P5_SQL = f"""
WITH refs AS (
  SELECT DISTINCT 'relations' AS ref_table, 'source_id' AS ref_field, rel_id AS row_key, {_KEY.format('source_id')} AS k, extracted_at FROM relations WHERE source_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'relations', 'target_id', rel_id, {_KEY.format('target_id')}, extracted_at FROM relations WHERE target_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'entities', 'source_chunk_id', mention_id, {_KEY.format('source_chunk_id')}, extracted_at FROM entities WHERE source_chunk_id IS NOT NULL),
targets AS (
  SELECT 'relations' AS ref_table, {_KEY.format('entity_id')} AS k, min(extracted_at) AS arrived, min(deleted_at) AS gone FROM entities GROUP BY 1, 2
  UNION ALL SELECT 'entities', {_KEY.format('chunk_id')}, min(indexed_at), min(deleted_at) FROM chunks GROUP BY 1, 2),
states AS (
  SELECT r.ref_table, r.ref_field, r.row_key, strftime(r.extracted_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN t.gone <= r.extracted_at THEN 'deleted' WHEN t.arrived > r.extracted_at THEN 'late' END AS state
  FROM refs r LEFT JOIN targets t USING (ref_table, k))
"""
QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": P5_SQL + "SELECT * FROM states WHERE state IS NOT NULL",
    "p5_report": P5_SQL + "SELECT ref_table, ref_field, period, state, count(*) AS n_orphans FROM states WHERE state IS NOT NULL GROUP BY ALL",
}
