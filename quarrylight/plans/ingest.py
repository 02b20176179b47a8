"""Readers over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.session import table
from quarrylight.sources import readers

QUERIES, SQL = {}, {}


def line_elements(spark, root):
    return readers.line_elements(table(spark, root, "documents").select("doc_name", "text")).select("element_id", "doc_name", "pos", "content")


def eval_items(spark, root):
    q = table(spark, root, "eval_queries").distinct()
    docs = F.when(F.size("expected_docs") > 0, F.col("expected_docs")).when(F.col("source_doc").isNotNull(), F.array("source_doc")).otherwise(F.array().cast("array<string>"))
    return q.select("query_id", docs.alias("docs"), F.when(F.size("expected_docs") > 1, "multi").otherwise("single").alias("kind"))


def arrivals(spark, root):
    from quarrylight.streaming.incremental import arrivals as per_window

    d = per_window(table(spark, root, "documents").select("ingested_at", "source", "n_chars"))
    return d.select(F.date_format(F.to_utc_timestamp("window.start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "source", "n_docs", "n_chars")


QUERIES.update(line_elements=line_elements, eval_items=eval_items, arrivals=arrivals)
SQL["eval_items"] = "SELECT query_id, CASE WHEN len(expected_docs) > 0 THEN expected_docs WHEN source_doc IS NOT NULL THEN [source_doc] ELSE [] END AS docs, CASE WHEN len(expected_docs) > 1 THEN 'multi' ELSE 'single' END AS kind FROM (SELECT DISTINCT * FROM eval_queries)"
SQL["arrivals"] = "SELECT strftime(date_trunc('day', ingested_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS day, source, count(*) AS n_docs, sum(n_chars)::bigint AS n_chars FROM documents WHERE ingested_at IS NOT NULL GROUP BY 1, 2"
SQL["line_elements"] = r"""WITH l AS (SELECT doc_name, unnest(s) AS content, unnest(range(len(s)))::bigint AS pos FROM (SELECT doc_name, regexp_split_to_array(text, '\r\n|\n|\r') AS s FROM documents WHERE text IS NOT NULL))
SELECT substr(sha256(concat_ws('::', doc_name, 'paragraph', pos::varchar, substr(content, 1, 100))), 1, 16) AS element_id, doc_name, pos, content FROM l WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 0"""
