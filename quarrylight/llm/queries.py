"""Queries of the problems on training data, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.contamination import leaked_items, without_leaks
from quarrylight.llm.langid import LanguageModel, canonical_label, context_line, fit, language_segments
from quarrylight.llm.names import link_names, linked_pairs
from quarrylight.llm.ranking import inverse_normal_sql, joint_ranking
from quarrylight.llm.reading import body, fit_reading, graded_sample, reading_levels
from quarrylight.llm.sentences import sentence_positions
from quarrylight.llm.split import split_oversized, with_text
from quarrylight.llm.tokenizer import encode
from quarrylight.session import spread, table

SCORES = ("vector_score", "graph_score", "policy_score")


def _items(spark: SparkSession, root: str) -> DataFrame:
    elements = table(spark, root, "elements").select(F.lit("elements").alias("item_table"), F.col("element_id").alias("item_id"), "content")
    return elements.unionAll(table(spark, root, "chunks").select(F.lit("chunks"), "chunk_id", "content"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pieces = split_oversized(_items(spark, root), ["item_table", "item_id"])
    return pieces.groupBy("item_table", "item_id").agg(F.when(F.every("natural"), "natural").otherwise("forced").alias("cut"))


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    items = _items(spark, root)
    keys = ["item_table", "item_id"]
    return with_text(split_oversized(items, keys), items, keys)


# Entity types that are neither persons nor organisations.
OTHER_KINDS = ("role", "limit", "definition", "product", "currency", "regulation", "condition", "percentage", "loan_type")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "entities").select("mention_id", "name", "mentions", F.lower(F.trim("entity_type")).alias("kind")).distinct()
    # each row votes on the kind of the strings it holds; the votes of one entity's strings are counted together
    strings = rows.select(F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>"))))).alias("sid"), "kind").where(F.col("sid").isNotNull())
    votes = strings.groupBy("sid").agg(F.count_if(F.col("kind").isin("person", "organization")).alias("named"), F.count_if(F.col("kind").isin(*OTHER_KINDS)).alias("other"))
    members = link_names(votes).join(votes, "sid")
    kept = members.groupBy("entity").agg(F.sum("named").alias("named"), F.sum("other").alias("other"), F.count(F.lit(1)).alias("n")).where("named > 0 and named >= other and n > 1").select("entity")
    return linked_pairs(members.join(kept, "entity").select("sid", "entity"))


def _language_model(spark: SparkSession, root: str) -> LanguageModel:
    paragraphs = table(spark, root, "elements").where(F.col("element_type") == "paragraph")
    return fit(paragraphs, "element_id", "content", "language")


def _language_items(spark: SparkSession, root: str) -> DataFrame:
    letters = F.length(F.regexp_replace("content", r"[^\p{L}]+", ""))
    elements = table(spark, root, "elements").where(F.col("element_type") == "paragraph").where((F.length("content") >= 20) & (letters >= 20)).select(F.lit("elements").alias("item_table"), F.col("element_id").alias("item_id"), "content", "language", F.lit(0).alias("skip"))
    chunks = table(spark, root, "chunks").where(F.col("element_type") == "text").select(F.lit("chunks"), "chunk_id", "content", "language", context_line(F.col("content")))
    return elements.unionAll(chunks).select("item_table", "item_id", canonical_label(F.col("language")).alias("label"), "content", "skip")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    keys = ["item_table", "item_id", "label"]
    found = language_segments(spread(_language_items(spark, root)), keys, "content", _language_model(spark, root), "skip", per_sentence=False)
    # the languages of an item come from one row of it; items are compared with their label after the few columns are reduced
    items = found.groupBy(*keys).agg(F.collect_set("lang").alias("langs"))
    cases = items.where((F.size("langs") > 1) | (F.element_at("langs", 1) != F.col("label")))
    return cases.select("item_table", "item_id", F.explode("langs").alias("lang")).distinct()


def p3_segments(spark: SparkSession, root: str) -> DataFrame:
    keys = ["item_table", "item_id"]
    return language_segments(spread(_language_items(spark, root)), keys, "content", _language_model(spark, root), "skip").distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    paragraphs = table(spark, root, "elements").where(F.col("element_type") == "paragraph").select("element_id", "content")
    return sentence_positions(spread(paragraphs), ["element_id"])


def p4_chunks(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks").where(F.col("element_type") == "text").select("chunk_id", "content")
    return sentence_positions(spread(chunks), ["chunk_id"])


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    results = table(spark, root, "retrieval_results").select("query_id", "chunk_id", *SCORES)
    return joint_ranking(results, "query_id", "chunk_id", dict.fromkeys(SCORES, 1.0), top_k=5).select("query_id", "chunk_id")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode(spread(table(spark, root, "documents").select("doc_id", "text")), ["doc_id"])


PASSAGES = ("question", "expected_answer", "reasoning_chain")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    documents = spread(table(spark, root, "documents").select("doc_id", "text"))
    return leaked_items(documents, table(spark, root, "eval_queries").select("query_id", *PASSAGES), "doc_id", "text", "query_id", PASSAGES)


def p8_clean(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "doc_name")
    return without_leaks(documents, p8_found(spark, root), "doc_id")


def p9_profile(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text", "lang")
    graded = graded_sample(documents, table(spark, root, "reading_labels"), "doc_id", "text", "band")
    reader = fit_reading([body(t) for t, _ in graded], [g for _, g in graded]) if len({g for _, g in graded}) > 1 else None
    # the head of a document is in one language everywhere, which says nothing of its own
    spoken = fit(documents, "doc_id", "text", "lang", rows=2500, skip=3)
    return reading_levels(spread(documents.where(F.length("text") >= 600)), "doc_id", "text", reader, spoken)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_profile(spark, root).where(F.col("band").isNotNull()).select("doc_id", "band")


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile, "p3_found": p3_found, "p3_segments": p3_segments, "p8_found": p8_found, "p8_clean": p8_clean, "p1_found": p1_found, "p1_pieces": p1_pieces, "p7_ids": p7_ids, "p2_found": p2_found, "p4_found": p4_found, "p4_chunks": p4_chunks, "p6_found": p6_found}
SQL = {
    "p6_found": f"""
WITH base AS (SELECT query_id, chunk_id, max(vector_score) AS s0, max(graph_score) AS s1, max(policy_score) AS s2 FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
long AS (SELECT query_id, chunk_id, 0 AS kind, s0 AS score FROM base WHERE s0 IS NOT NULL UNION ALL SELECT query_id, chunk_id, 1, s1 FROM base WHERE s1 IS NOT NULL UNION ALL SELECT query_id, chunk_id, 2, s2 FROM base WHERE s2 IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, kind ORDER BY score)::double AS f, count(*) OVER (PARTITION BY query_id, kind, score)::double AS t, count(*) OVER (PARTITION BY query_id, kind)::double AS n FROM long),
p AS (SELECT *, (f + (t - 1) / 2.0) / (n + 1.0) AS p FROM r WHERE t < n),
z AS (SELECT query_id, chunk_id, {inverse_normal_sql("p")} AS z FROM p),
m AS (SELECT query_id, chunk_id, round(avg(z), 9) AS mean, count(*) AS n FROM z GROUP BY 1, 2)
SELECT query_id, chunk_id FROM base LEFT JOIN m USING (query_id, chunk_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mean DESC NULLS LAST, coalesce(n, 0) DESC, chunk_id) <= 5""",
}
