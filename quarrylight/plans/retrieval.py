"""Vector search, fusion, gates, evidence and evaluation over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import retrieval as R
from quarrylight.operators import vectors as V
from quarrylight.operators.access import allowed
from quarrylight.plans.registry import register
from quarrylight.session import table

QUERIES, SQL = {}, {}


query = register(QUERIES, SQL)


_COS = "round(list_dot_product(q.embedding::double[], e.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]))), 6)"


def _top(where: str = "true", source: str = "embeddings", k: int = 10) -> str:
    return f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id)::int AS rank FROM embeddings q JOIN {source} e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id WHERE {where}) WHERE rank <= {k}"


def _vectors(spark, root):
    e = table(spark, root, "embeddings")
    return e.where(F.col("vec_id") % 20 == 0), e


@query(_top())
def vector_topk(spark, root):
    return V.top_k(*_vectors(spark, root), 10)


@query(_top("e.label < 5"))
def vector_topk_filtered(spark, root):
    q, e = _vectors(spark, root)
    return V.top_k(q, e.where("label < 5"), 10)


# Fixed value: labels stand for documents; one of them has no level and counts as the strictest
_LEVELS = "CASE WHEN label < 4 THEN 1 WHEN label < 7 THEN 2 ELSE 3 END"


@query(_top(f"({_LEVELS.replace('label', 'e.label')}) <= 2"))
def vector_topk_rbac(spark, root):
    q, e = _vectors(spark, root)
    names = e.select("vec_id", "embedding", F.col("label").cast("string").alias("doc_name"))
    access = spark.createDataFrame([(str(i), 1 if i < 4 else 2) for i in range(7)], "doc_name string, level int")
    return V.top_k(q, allowed(names, access, 2), 10)


def vector_ann(spark, root):
    return V.approximate_top_k(*_vectors(spark, root), 10)


QUERIES["vector_ann"] = vector_ann


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id + 1")
def cosine_next(spark, root):
    e = table(spark, root, "embeddings")
    j = e.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("a")).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b")), "id")
    return j.select("query_id", "id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id")
def cosine_pairs(spark, root):
    return V.all_scores(*_vectors(spark, root))


@query("SELECT label, count(*) AS n, len(any_value(embedding)) AS dim FROM embeddings GROUP BY 1")
def collection_info(spark, root):
    return table(spark, root, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))


@query(r"""WITH t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM (SELECT DISTINCT chunk_id, content FROM chunks)),
h AS (SELECT chunk_id, ('0x' || substr(md5(t), 1, 8))::bigint AS n FROM t), w AS (SELECT chunk_id, (n % 64)::int AS bucket, sum(CASE WHEN (n // 64) % 2 = 0 THEN 1 ELSE -1 END)::bigint AS w FROM h GROUP BY 1, 2 HAVING w <> 0)
SELECT chunk_id, bucket, round(w / sqrt((sum(w * w) OVER (PARTITION BY chunk_id))::double), 6) AS weight FROM w""")
def hashed_embedding(spark, root):
    c = table(spark, root, "chunks").select("chunk_id", "content").distinct()
    return V.hashed_features(c, "chunk_id", "content")


def semantic_breaks(spark, root):
    from quarrylight.functions import text as T

    e = table(spark, root, "elements").where("element_type = 'paragraph'").select("element_id", "content").distinct()
    s = e.select("element_id", F.posexplode(T.sentences(F.col("content"))).alias("sent_no", "sentence"))
    return V.semantic_breaks(s, ["element_id"], "sent_no", "sentence")


QUERIES["semantic_breaks"] = semantic_breaks

_R = "r AS (SELECT DISTINCT ON (query_id, chunk_id) * FROM retrieval_results)"
_FUSED = "round(round(CASE WHEN retrieval_mode = 'vector_only' THEN coalesce(vector_score, 0.0::double) * (0.4::double / (0.4::double + 0.2::double)) + coalesce(policy_score, 1.0::double) * (0.2::double / (0.4::double + 0.2::double)) ELSE coalesce(vector_score, 0.0::double) * 0.4::double + coalesce(graph_score, 0.0::double) * 0.4::double + coalesce(policy_score, 1.0::double) * 0.2::double END, 9)::decimal(18, 9), 4)::double"
_RANKED = f"{_R}, s AS (SELECT *, {_FUSED} AS score FROM r), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_score DESC NULLS LAST, chunk_id)::int AS rank FROM s QUALIFY rank <= 5)"
_ONE = "k AS (SELECT DISTINCT ON (chunk_id) chunk_id, section_path, element_type, content FROM chunks)"


def _results(spark, root):
    return table(spark, root, "retrieval_results")


@query(f"WITH {_RANKED} SELECT query_id, chunk_id, score, rank FROM top")
def hybrid_retrieve(spark, root):
    return R.ranked(_results(spark, root), k=R.TOP_K).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_R}, top AS (SELECT *, round(round(coalesce(vector_score, 0.0::double), 9)::decimal(18, 9), 4)::double AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(round(coalesce(vector_score, 0.0::double), 9)::decimal(18, 9), 4)::double DESC, vector_score DESC NULLS LAST, chunk_id)::int AS rank FROM r QUALIFY rank <= 5) SELECT query_id, chunk_id, score, rank FROM top")
def vector_only_retrieve(spark, root):
    return R.ranked(_results(spark, root), F.coalesce("vector_score", F.lit(0.0)), R.TOP_K).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_R} SELECT query_id, chunk_id FROM r LEFT JOIN (SELECT doc_name, max(level) AS level FROM doc_access GROUP BY 1) a USING (doc_name) WHERE coalesce(a.level, 3) <= 2")
def rbac_gate(spark, root):
    return allowed(_results(spark, root), table(spark, root, "doc_access"), 2).select("query_id", "chunk_id").distinct()


@query("SELECT doc_name, max(level) AS level FROM doc_access WHERE doc_name IS NOT NULL GROUP BY 1 HAVING max(level) <= 2")
def accessible_docs(spark, root):
    a = table(spark, root, "doc_access")
    return allowed(a.select("doc_name").where("doc_name is not null").distinct(), a, 2).select("doc_name", "level")


_GATE = f"{_RANKED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC NULLS LAST, chunk_id) AS n FROM top), g AS (SELECT query_id, count(*) AS n_results, round(least(avg(CASE WHEN n <= 3 THEN coalesce(vector_score, 0.0::double) END) + 0.2::double * least(count(DISTINCT doc_name) / 3.0::double, 1.0::double), 1.0::double), 4) AS confidence FROM b GROUP BY 1)"


@query(f"WITH {_GATE} SELECT *, confidence >= 0.3 AND n_results >= 2 AS sufficient FROM g")
def confidence(spark, root):
    return R.confidence(R.ranked(_results(spark, root), k=R.TOP_K))


@query(f"""WITH {_RANKED}, va AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(round(coalesce(vector_score, 0.0::double), 9)::decimal(18, 9), 4)::double DESC, vector_score DESC NULLS LAST, chunk_id) AS rank FROM r QUALIFY rank <= 5)
SELECT query_id, count(*) FILTER (b.rank IS NULL) AS only_vector, count(*) FILTER (a.rank IS NULL) AS only_fused, count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) AS shared, count(*) FILTER (a.rank <> b.rank) AS moved FROM va a FULL JOIN top b USING (query_id, chunk_id) GROUP BY 1""")
def ab_compare(spark, root):
    return R.compare(_results(spark, root))


_BLOCK = "'[Evidence ' || rank || '] (Score: ' || round(score::decimal(18, 4), 3)::varchar || ', Type: ' || element_type || ')' || chr(10) || 'Source: ' || doc_name || ' | ' || CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE 'root' END || chr(10) || content"


@query(f"WITH {_RANKED}, {_ONE} SELECT query_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank) AS evidence FROM (SELECT top.query_id, top.rank, top.score, top.doc_name, k.* FROM top JOIN k USING (chunk_id)) GROUP BY 1")
def evidence_block(spark, root):
    return R.evidence_blocks(R.ranked(_results(spark, root), k=R.TOP_K), table(spark, root, "chunks"))


@query(f"WITH {_RANKED}, {_ONE} SELECT query_id, rank, doc_name, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE 'root' END AS section, k.element_type, score AS relevance FROM top JOIN k USING (chunk_id)")
def citations(spark, root):
    return R.citations(R.ranked(_results(spark, root), k=R.TOP_K), table(spark, root, "chunks"))


def refusal(spark, root):
    top = R.ranked(_results(spark, root), k=R.TOP_K)
    return R.answers(R.evidence_blocks(top, table(spark, root, "chunks")), R.confidence(top))


QUERIES["refusal"] = refusal

@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT chunk_id, token_estimate FROM chunks) WHERE token_estimate > 512) AS oversize, (SELECT count(DISTINCT doc_name) FROM chunks WHERE doc_name NOT IN (SELECT source_doc FROM entities WHERE source_doc IS NOT NULL)) AS docs_without_entities,
 (SELECT count(DISTINCT rel_id) FROM relations WHERE relation_type IS NULL) AS untyped_relations, (SELECT count(DISTINCT chunk_id) FROM chunks WHERE deleted_at IS NOT NULL) AS deleted_chunks""")
def health_check(spark, root):
    c, e, r = table(spark, root, "chunks"), table(spark, root, "entities"), table(spark, root, "relations")
    a = c.select("chunk_id", "token_estimate").distinct().agg(F.count_if(F.col("token_estimate") > 512).alias("oversize"))
    b = c.select("doc_name").distinct().where("doc_name is not null").join(e.select(F.col("source_doc").alias("doc_name")).distinct(), "doc_name", "left_anti").agg(F.count(F.lit(1)).alias("docs_without_entities"))
    d = r.where("relation_type is null").agg(F.count_distinct("rel_id").alias("untyped_relations"))
    g = c.where("deleted_at is not null").agg(F.count_distinct("chunk_id").alias("deleted_chunks"))
    return a.join(b).join(d).join(g)
