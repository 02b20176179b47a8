"""Fusion of scores, gates, evidence and evaluation of retrieval, for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

ALPHA, BETA, GAMMA = 0.4, 0.4, 0.2
TOP_K, THRESHOLD, LEAST = 5, 0.3, 2


def fused(mode: Column, vector: Column, graph: Column, policy: Column, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> Column:
    """The weighted sum; without the graph the other two weights are scaled to one.  Missing scores count 0, policy 1."""
    v, g, p = F.coalesce(vector, F.lit(0.0)), F.coalesce(graph, F.lit(0.0)), F.coalesce(policy, F.lit(1.0))
    rest = alpha + gamma
    return F.when(mode == "vector_only", v * (alpha / rest) + p * (gamma / rest)).otherwise(v * alpha + g * beta + p * gamma)


def ranked(results: DataFrame, score: Column | None = None, k: int | None = None, name: str = "rank") -> DataFrame:
    """Distinct candidates with ``score`` (four places) and rank; ties go to the better vector score, then the chunk id."""
    score = score if score is not None else fused(F.col("retrieval_mode"), F.col("vector_score"), F.col("graph_score"), F.col("policy_score"))
    # nine places first, so that engines agree on what lies between two values
    r = results.withColumn("score", F.round(F.round(score, 9), 4)).dropDuplicates(["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("vector_score"), "chunk_id")
    r = r.withColumn(name, F.row_number().over(order))
    return r if k is None else r.where(F.col(name) <= k)


def confidence(top: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(query_id, n_results, confidence, sufficient): mean of the three best vector scores among the final results, and
    up to 0.2 for three documents or more; at most 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("vector_score"), "chunk_id")
    best = top.withColumn("_n", F.row_number().over(w))
    c = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.avg(F.when(F.col("_n") <= 3, F.coalesce("vector_score", F.lit(0.0)))).alias("mean"), F.count_distinct("doc_name").alias("docs"))
    value = F.round(F.least(F.col("mean") + 0.2 * F.least(F.col("docs") / 3.0, F.lit(1.0)), F.lit(1.0)), 4)
    return c.select("query_id", "n_results", value.alias("confidence")).withColumn("sufficient", (F.col("confidence") >= threshold) & (F.col("n_results") >= least))


def compare(results: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, only_vector, only_fused, shared, moved): how the fused ranking differs from the one by vectors alone."""
    a = ranked(results, F.coalesce("vector_score", F.lit(0.0)), k, "rank_a").select("query_id", "chunk_id", "rank_a")
    b = ranked(results, None, k, "rank_b").select("query_id", "chunk_id", "rank_b")
    j = a.join(b, ["query_id", "chunk_id"], "full_outer")
    return j.groupBy("query_id").agg(
        F.count_if(F.col("rank_b").isNull()).alias("only_vector"), F.count_if(F.col("rank_a").isNull()).alias("only_fused"),
        F.count_if(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()).alias("shared"), F.count_if(F.col("rank_a") != F.col("rank_b")).alias("moved"),
    )


def evidence_blocks(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, evidence): the results of each query as numbered blocks in the order of their rank."""
    c = chunks.select("chunk_id", "section_path", "element_type", "content").dropDuplicates(["chunk_id"])
    head = F.format_string("[Evidence %d] (Score: %s, Type: %s)\nSource: %s | %s\n%s", F.col("rank"), F.round(F.col("score").cast("decimal(18,4)"), 3).cast("string"), F.col("element_type"), F.col("doc_name"), T.section_label(F.col("section_path")), F.col("content"))
    rows = top.join(c, "chunk_id").select("query_id", F.struct("rank", head.alias("block")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["block"]), "\n\n").alias("evidence"))


def citations(top: DataFrame, chunks: DataFrame) -> DataFrame:
    c = chunks.select("chunk_id", "section_path", "element_type").dropDuplicates(["chunk_id"])
    return top.join(c, "chunk_id").select("query_id", "rank", "doc_name", T.section_label(F.col("section_path")).alias("section"), "element_type", F.round("score", 4).alias("relevance"))


def answers(evidence: DataFrame, gate: DataFrame) -> DataFrame:
    """(query_id, answer, answered): the first evidence, or the refusal where the evidence does not suffice."""
    refusal = "I don't have enough evidence to answer this question."
    j = gate.select("query_id", "sufficient").join(evidence, "query_id", "left")
    answered = F.col("sufficient") & F.col("evidence").isNotNull()
    text = F.concat(F.element_at(T.sentences(F.split_part("evidence", F.lit("\n"), F.lit(-1))), 1), F.lit(" [1]"))
    return j.select("query_id", F.when(answered, F.coalesce(text, F.lit(refusal))).otherwise(refusal).alias("answer"), answered.alias("answered"))


def retrieval_metrics(top: DataFrame, expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, recall, precision, section_recall, entity_recall) of results against what was expected.

    ``expected``: query_id, expected_docs, source_section, expected_entities.  A document is met if its expected name
    is part of a retrieved one.  Nothing expected: recall, precision and section recall 0, entity recall null.
    """
    c = chunks.select("chunk_id", "section_path", "content").dropDuplicates(["chunk_id"])
    got = top.select("query_id", "chunk_id", "doc_name").join(c, "chunk_id", "left")
    # a query has few results, as only its best ones are kept
    per = got.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.lower("doc_name"))).alias("docs"), F.array_sort(F.collect_list(F.lower(F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")))).alias("sections"),
        F.array_join(F.array_sort(F.collect_list(F.lower(F.coalesce("content", F.lit(""))))), " ").alias("text"),
    )
    e = expected.select("query_id", F.coalesce("expected_docs", F.array().cast("array<string>")).alias("want"), "source_section", F.coalesce("expected_entities", F.array().cast("array<string>")).alias("entities")).join(per, "query_id")
    met = F.size(F.filter("want", lambda w: F.exists("docs", lambda d: F.contains(d, F.lower(w)))))
    relevant = F.size(F.filter("docs", lambda d: F.exists("want", lambda w: F.contains(d, F.lower(w)))))
    section = F.when(F.col("source_section").isNull() | (F.col("source_section") == ""), 0.0).otherwise(F.exists("sections", lambda s: F.contains(s, F.lower("source_section"))).cast("double"))
    named = F.size(F.filter("entities", lambda w: F.contains("text", F.lower(w))))
    return e.select(
        "query_id", F.when(F.size("want") > 0, F.round(met / F.size("want"), 4)).otherwise(0.0).alias("recall"), F.when(F.size("docs") > 0, F.round(relevant / F.size("docs"), 4)).otherwise(0.0).alias("precision"),
        section.alias("section_recall"), F.when(F.size("entities") > 0, F.round(named / F.size("entities"), 4)).alias("entity_recall"),
    )


def report(metrics: DataFrame, by: str) -> DataFrame:
    """Means per group and over all; what is not applicable is left out of means."""
    names = ("recall", "precision", "section_recall", "entity_recall")
    return metrics.groupingSets([[F.col(by)], []], by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 4).alias(f"avg_{n}") for n in names])
