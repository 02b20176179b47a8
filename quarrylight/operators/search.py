"""Retrieval from questions to ranked chunks: vector search, entities, expansion over the graph, gates and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import graph as G
from quarrylight.operators import vectors as V
from quarrylight.operators.access import allowed
from quarrylight.operators.retrieval import fused, ranked
from quarrylight.session import cut

TOP_VECTORS, HOPS, MOST_NODES = 10, 2, 300


def vector_hits(questions: DataFrame, chunks: DataFrame, k: int = TOP_VECTORS, filters: str = "true") -> DataFrame:
    """(query_id, chunk_id, vector_score, vector_rank) of the k chunks nearest to each question, of those that ``filters`` lets pass.

    ``questions``: query_id, embedding; ``chunks``: chunk_id, embedding, and what the filters ask for.
    """
    found = V.top_k(questions.select(F.concat(F.lit("?"), "query_id").alias("id"), "embedding"), chunks.where(filters).select(F.col("chunk_id").alias("id"), "embedding"), k, id_="id")
    return found.select(F.substring("query_id", 2, 1 << 30).alias("query_id"), F.col("id").alias("chunk_id"), F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))


def subgraph(hits: DataFrame, matched: DataFrame, edges: DataFrame, hops: int = HOPS, cap: int = MOST_NODES) -> DataFrame:
    """(query_id, node, hop) around the retrieved chunks and the matched entities of each question."""
    seeds = hits.select("query_id", F.col("chunk_id").alias("node")).unionAll(matched.select("query_id", F.col("entity").alias("node")))
    return G.expand(seeds, edges, hops, cap)


def candidates(questions: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame, access: DataFrame, level: int | None, use_graph: bool = True) -> DataFrame:
    """(query_id, chunk_id, doc_name, retrieval_mode, found_by, vector_score, graph_score, policy_score) of all chunks that a question reaches.

    ``questions``: query_id, question.  Chunks come from the vectors, and from the graph where the vectors missed them;
    deleted chunks, blank ones and those of documents above the user's level (null: no level) never come.  A question
    without tokens reaches what its entities reach.
    """
    live = G.live_chunks(chunks).where(F.col("content").rlike(r"\S"))
    seen = allowed(live.select("chunk_id", "doc_name").distinct(), access, level).select("chunk_id", "doc_name")
    vectors = cut(V.hashed_vectors(live.select("chunk_id", "content").distinct(), "chunk_id", "content").join(seen, "chunk_id"))
    asked = cut(V.hashed_vectors(questions.where("query_id is not null").select("query_id", "question").distinct(), "query_id", "question"))
    hits = cut(vector_hits(asked, vectors))
    base = hits.join(seen, "chunk_id").select("query_id", "chunk_id", "doc_name", F.lit("vector").alias("found_by"), "vector_score")
    if not use_graph:
        return base.select("query_id", "chunk_id", "doc_name", F.lit("vector_only").alias("retrieval_mode"), "found_by", "vector_score", F.lit(0.0).alias("graph_score"), F.lit(1.0).alias("policy_score"))
    matched = cut(G.match_entities(questions, mentions))
    around = subgraph(hits, matched, G.edges(live, mentions, relations))
    new = around.select("query_id", F.col("node").alias("chunk_id")).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(vectors, "chunk_id")
    scored = new.join(asked.withColumnRenamed("embedding", "q"), "query_id", "left").withColumn("vector_score", F.coalesce(F.greatest(F.lit(0.0), F.round(V.cosine(F.col("q"), F.col("embedding")), 6)), F.lit(0.0)))
    every = cut(base.unionByName(scored.select("query_id", "chunk_id", "doc_name", F.lit("graph").alias("found_by"), "vector_score")))
    links = G.mention_links(mentions, live)[0]
    g = G.graph_scores(every, links, matched, G.cross_document(mentions, live))
    return every.join(g, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "doc_name", F.lit("hybrid").alias("retrieval_mode"), "found_by", "vector_score", "graph_score", F.lit(1.0).alias("policy_score"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each question with ``score`` and ``rank``."""
    return ranked(found, fused(F.col("retrieval_mode"), F.col("vector_score"), F.col("graph_score"), F.col("policy_score")), k)
