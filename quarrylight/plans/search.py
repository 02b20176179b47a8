"""From questions to ranked chunks, prompts and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import graph as G
from quarrylight.operators import prompts as P
from quarrylight.operators import retrieval as R
from quarrylight.operators import search as S
from quarrylight.plans.graph import ALL, CHUNKS, NODES, WORDS
from quarrylight.plans.registry import register
from quarrylight.session import cut, table

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)
#: the level of the user who asks
LEVEL = 2
METRICS = ("recall", "precision", "section_recall", "entity_recall")

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_LIVE = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_name, element_type, section_path, content FROM chunks WHERE chunk_id IS NOT NULL AND regexp_matches(content, '\\S') AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE deleted_at IS NOT NULL AND chunk_id IS NOT NULL) ORDER BY chunk_id, indexed_at)"
_FOUND = (
    ALL.replace(CHUNKS, _LIVE)
    + f""", {NODES}, {WORDS},
a AS (SELECT c.*, coalesce(l.level, 3) AS level FROM c LEFT JOIN (SELECT doc_name, max(level) AS level FROM doc_access GROUP BY 1) l USING (doc_name)),
seen AS (SELECT * FROM a WHERE level <= {LEVEL}),
t AS (SELECT 'c' AS k, chunk_id AS id, unnest({_TOKENS.format('content')}) AS t FROM seen UNION ALL SELECT 'q', query_id, unnest({_TOKENS.format('question')}) FROM (SELECT DISTINCT query_id, question FROM eval_queries)),
h AS (SELECT k, id, ('0x' || substr(md5(t), 1, 8))::bigint AS n FROM t),
w AS (SELECT k, id, (n % 64)::int AS b, sum(CASE WHEN (n // 64) % 2 = 0 THEN 1 ELSE -1 END)::double AS w FROM h GROUP BY 1, 2, 3),
v AS (SELECT k, id, list(coalesce(w.w, 0.0::double) ORDER BY b) AS v FROM (SELECT DISTINCT k, id FROM w) i CROSS JOIN (SELECT unnest(range(64))::int AS b) r LEFT JOIN w USING (k, id, b) GROUP BY 1, 2),
u AS (SELECT k, id, v, sqrt(list_dot_product(v, v)) AS norm FROM v),
cos AS (SELECT q.id AS query_id, c.id AS chunk_id, CASE WHEN q.norm * c.norm = 0 THEN 0.0::double ELSE round(list_dot_product(q.v, c.v) / (q.norm * c.norm), 6) + 0.0::double END AS score FROM u q JOIN u c ON q.k = 'q' AND c.k = 'c'),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cos QUALIFY rank <= 10),
e2 AS (SELECT DISTINCT src, dst FROM (SELECT src, dst, relation_type FROM edges UNION ALL SELECT dst, src, relation_type FROM edges) WHERE src <> dst AND relation_type NOT IN ('belongs_to_document', 'belongs_to_section', 'child_of_section', 'table_belongs_to_clause')),
s0 AS (SELECT query_id, chunk_id AS node, 0 AS hop FROM hits UNION SELECT query_id, entity, 0 FROM matched),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, node) AS n FROM (SELECT * FROM s0 UNION ALL SELECT DISTINCT query_id, dst, 1 FROM s0 JOIN e2 ON src = node WHERE (query_id, dst) NOT IN (SELECT query_id, node FROM s0)) QUALIFY n <= 300),
s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, node) AS m FROM (SELECT query_id, node, hop FROM s1 UNION ALL SELECT DISTINCT query_id, dst, 2 FROM s1 JOIN e2 ON src = node WHERE hop = 1 AND (query_id, dst) NOT IN (SELECT query_id, node FROM s1)) QUALIFY m <= 300),
every AS (SELECT query_id, chunk_id, doc_name, 'vector' AS found_by, score AS vector_score FROM hits JOIN seen USING (chunk_id)
 UNION ALL SELECT s2.query_id, s2.node, seen.doc_name, 'graph', coalesce(greatest(0.0::double, cos.score), 0.0::double) FROM s2 JOIN seen ON seen.chunk_id = s2.node LEFT JOIN cos ON cos.query_id = s2.query_id AND cos.chunk_id = s2.node WHERE (s2.query_id, s2.node) NOT IN (SELECT query_id, chunk_id FROM hits)),
j AS (SELECT k.query_id, k.chunk_id, count(*) * 2 AS n, max(CASE WHEN m.entity IS NULL THEN 0 ELSE 1 END) AS wanted, max(CASE WHEN x.entity IS NULL THEN 0 ELSE 1 END) AS x
 FROM every k JOIN links USING (chunk_id) LEFT JOIN matched m ON m.query_id = k.query_id AND m.entity = links.entity LEFT JOIN across x ON x.entity = links.entity GROUP BY 1, 2),
g AS (SELECT every.*, CASE WHEN n IS NULL THEN 0.0::double ELSE round(least(0.3::double * least(n / 5.0::double, 1.0::double) + 0.5::double * wanted + 0.2::double * x, 1.0::double), 4) END AS graph_score FROM every LEFT JOIN j USING (query_id, chunk_id)),
f AS (SELECT 'hybrid' AS mode, query_id, chunk_id, doc_name, vector_score, round(round(vector_score * 0.4::double + graph_score * 0.4::double + 1.0::double * 0.2::double, 9)::decimal(18, 9), 4)::double AS score FROM g
 UNION ALL SELECT 'vector_only', query_id, chunk_id, doc_name, vector_score, round(round(vector_score * (0.4::double / (0.4::double + 0.2::double)) + 1.0::double * (0.2::double / (0.4::double + 0.2::double)), 9)::decimal(18, 9), 4)::double FROM every WHERE found_by = 'vector'),
top AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, vector_score DESC, chunk_id)::int AS rank FROM f QUALIFY rank <= 5)
"""
)


def _t(spark, root, *names):
    return [table(spark, root, n) for n in names]


def _questions(spark, root):
    return table(spark, root, "eval_queries").select("query_id", "question").distinct()


def _found(spark, root, use_graph=True):
    return S.candidates(_questions(spark, root), *_t(spark, root, "chunks", "entities", "relations", "doc_access"), LEVEL, use_graph)


def _top(spark, root, use_graph=True):
    return S.best(_found(spark, root, use_graph), R.TOP_K)


@query(_FOUND + "SELECT query_id, chunk_id, found_by, vector_score, graph_score FROM g")
def retrieve_union(spark, root):
    return _found(spark, root).select("query_id", "chunk_id", "found_by", "vector_score", "graph_score")


@query(_FOUND + "SELECT query_id, chunk_id, score, rank FROM top WHERE mode = 'hybrid'")
def retrieve_fused(spark, root):
    return _top(spark, root).select("query_id", "chunk_id", "score", "rank")


@query(_FOUND + "SELECT query_id, chunk_id, score, rank FROM top WHERE mode = 'vector_only'")
def retrieve_vector(spark, root):
    return _top(spark, root, False).select("query_id", "chunk_id", "score", "rank")


@query(_FOUND + "SELECT query_id, node, hop FROM s2")
def bfs_2hop(spark, root):
    """What is reached from each question's retrieved chunks and entities in two hops, 300 nodes at most."""
    c, e, r, a = _t(spark, root, "chunks", "entities", "relations", "doc_access")
    hits = _found(spark, root, False)
    live = G.live_chunks(c).where(F.col("content").rlike(r"\S"))
    return S.subgraph(hits, cut(G.match_entities(_questions(spark, root), e)), G.edges(live, e, r))


@query(_FOUND + "SELECT query_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM matched JOIN nn USING (entity) WHERE (query_id, entity) IN (SELECT query_id, node FROM s2) GROUP BY 1")
def matched_names(spark, root):
    """The names of a question's entities that are part of its subgraph."""
    e = table(spark, root, "entities")
    m = G.match_entities(_questions(spark, root), e)
    kept = m.join(bfs_2hop(spark, root).select("query_id", F.col("node").alias("entity")), ["query_id", "entity"], "left_semi")
    named = kept.join(G.entity_nodes(e).select("entity", "name"), "entity")
    return named.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


_ALL_EDGES = "e3 AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst)"


@query(
    ALL + f""", {NODES}, {WORDS}, {_ALL_EDGES}, seeds AS (SELECT DISTINCT entity AS query_id, entity AS node, 0 AS hop FROM matched),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, node) AS n FROM (SELECT * FROM seeds UNION ALL SELECT DISTINCT query_id, dst, 1 FROM seeds JOIN e3 ON src = node) QUALIFY n <= 50),
s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, node) AS m FROM (SELECT query_id, node, hop FROM s1 UNION ALL SELECT DISTINCT query_id, dst, 2 FROM s1 JOIN e3 ON src = node WHERE hop = 1 AND (query_id, dst) NOT IN (SELECT query_id, node FROM s1)) QUALIFY m <= 50)
SELECT query_id AS start, node, hop FROM s2"""
)
def neighbors_khop(spark, root):
    """The neighbourhood of every entity that a question names: two hops over all edges, 50 nodes at most."""
    c, e, r = _t(spark, root, "chunks", "entities", "relations")
    seeds = G.match_entities(_questions(spark, root), e).select("entity").distinct().select(F.col("entity").alias("query_id"), F.col("entity").alias("node"))
    return G.expand(seeds, G.edges(c, e, r), 2, 50, skip=()).withColumnRenamed("query_id", "start")


def _gate(top):
    return R.confidence(top)


_GATED = _FOUND + """, b AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY vector_score DESC, chunk_id) AS n FROM top),
gate AS (SELECT mode, query_id, count(*) AS n_results, round(least(avg(CASE WHEN n <= 3 THEN vector_score END) + 0.2::double * least(count(DISTINCT doc_name) / 3.0::double, 1.0::double), 1.0::double), 4) AS confidence FROM b GROUP BY 1, 2),
near AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY name, entity) AS n FROM (SELECT DISTINCT chunk_id, entity, lower(name) AS name FROM links JOIN nn USING (entity)) QUALIFY n <= 5),
asked AS (SELECT DISTINCT query_id FROM top WHERE mode = 'hybrid'),
named AS (SELECT query_id, 'Query entities detected: ' || string_agg(name, ', ' ORDER BY name, entity) AS said FROM matched JOIN nn USING (entity) GROUP BY 1),
lines AS (SELECT query_id, string_agg('  Chunk ' || substr(chunk_id, 1, 8) || '... connected to: ' || names, chr(10) ORDER BY rank) AS said FROM top JOIN (SELECT chunk_id, string_agg(name, ', ' ORDER BY n) AS names FROM near GROUP BY 1) USING (chunk_id) WHERE mode = 'hybrid' GROUP BY 1),
ents AS (SELECT query_id, coalesce(nullif(concat_ws(chr(10), named.said, lines.said), ''), 'No entity connections found.') AS entities FROM asked LEFT JOIN named USING (query_id) LEFT JOIN lines USING (query_id)),
trails AS (SELECT query_id, string_agg('  Path: ' || trail, chr(10) ORDER BY rank) AS said FROM top JOIN (SELECT chunk_id, string_agg('[chunk]' || chunk_id || ' --mentions_entity--> [entity]' || entity, ' → ' ORDER BY n) AS trail FROM near GROUP BY 1) USING (chunk_id) WHERE mode = 'hybrid' GROUP BY 1),
paths AS (SELECT query_id, coalesce(said, 'No graph evidence paths available.') AS paths FROM asked LEFT JOIN trails USING (query_id)),
judged AS (SELECT mode, query_id, substr(string_agg('[' || rank || '] (' || top.doc_name || ' | ' || array_to_string(coalesce(c.section_path, []), ' > ') || ')' || chr(10) || substr(coalesce(c.content, ''), 1, 500), chr(10) || chr(10) ORDER BY rank), 1, 6000) AS judged FROM top JOIN c USING (chunk_id) GROUP BY 1, 2),
blocks AS (SELECT query_id, string_agg('[Evidence ' || rank || '] (Score: ' || round(score::decimal(18, 4), 3)::varchar || ', Type: ' || element_type || ')' || chr(10) || 'Source: ' || top.doc_name || ' | ' || CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE 'root' END || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS evidence FROM top JOIN c USING (chunk_id) WHERE mode = 'hybrid' GROUP BY 1)
"""


def _near(spark, root):
    c, e = _t(spark, root, "chunks", "entities")
    names = G.entity_nodes(e)
    return P.connected(G.mention_links(e, G.live_chunks(c).where(F.col("content").rlike(r"\S")))[0], names), names


@query(_GATED + "SELECT query_id, entities, paths, judged FROM ents JOIN paths USING (query_id) JOIN judged USING (query_id) WHERE mode = 'hybrid'")
def prompt_blocks(spark, root):
    top = cut(_top(spark, root))
    near, names = _near(spark, root)
    matched = G.match_entities(_questions(spark, root), table(spark, root, "entities"))
    return P.entity_blocks(top, matched, names, near).join(P.path_blocks(top, near), "query_id").join(P.judged_evidence(top, table(spark, root, "chunks")), "query_id")


@query(_GATED + """SELECT query_id, '<USER_QUERY>' || coalesce(question, '') || '</USER_QUERY>' || chr(10) || chr(10) || 'Evidence Sufficiency: ' || CASE WHEN confidence >= 0.3 AND n_results >= 2 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END || chr(10) || 'Confidence Score: ' || round(confidence::decimal(18, 4), 2)::varchar || chr(10) || chr(10) ||
 '<EVIDENCE>' || chr(10) || evidence || chr(10) || '</EVIDENCE>' || chr(10) || chr(10) || '<ENTITIES>' || chr(10) || entities || chr(10) || '</ENTITIES>' || chr(10) || chr(10) || '<EVIDENCE_PATHS>' || chr(10) || paths || chr(10) || '</EVIDENCE_PATHS>' AS prompt
 FROM (SELECT DISTINCT query_id, question FROM eval_queries) JOIN gate USING (query_id) JOIN blocks USING (query_id) JOIN ents USING (query_id) JOIN paths USING (query_id) WHERE mode = 'hybrid'""")
def prompt(spark, root):
    top = cut(_top(spark, root))
    near, names = _near(spark, root)
    matched = G.match_entities(_questions(spark, root), table(spark, root, "entities"))
    evidence = R.evidence_blocks(top, table(spark, root, "chunks"))
    return P.prompts(_questions(spark, root), R.confidence(top), evidence, P.entity_blocks(top, matched, names, near), P.path_blocks(top, near))


_MEASURED = _GATED + """, x AS (SELECT DISTINCT query_id, reasoning_type, coalesce(nullif(expected_docs, []), CASE WHEN source_doc IS NULL THEN [] ELSE [source_doc] END) AS want, source_section, coalesce(expected_entities, []) AS wanted_entities FROM eval_queries),
p AS (SELECT mode, query_id, list(lower(top.doc_name)) AS docs, list(lower(coalesce(array_to_string(c.section_path, ' > '), ''))) AS sections, string_agg(lower(coalesce(c.content, '')), ' ' ORDER BY lower(coalesce(c.content, ''))) AS text FROM top LEFT JOIN c USING (chunk_id) GROUP BY 1, 2),
m AS (SELECT mode, query_id, reasoning_type, CASE WHEN len(want) > 0 THEN round(len(list_filter(want, lambda w: len(list_filter(docs, lambda d: contains(d, lower(w)))) > 0)) / len(want)::double, 4) ELSE 0.0::double END AS recall,
 round(len(list_filter(docs, lambda d: len(list_filter(want, lambda w: contains(d, lower(w)))) > 0)) / len(docs)::double, 4) AS "precision",
 CASE WHEN source_section IS NULL OR source_section = '' THEN 0.0::double ELSE (len(list_filter(sections, lambda s: contains(s, lower(source_section)))) > 0)::int::double END AS section_recall,
 CASE WHEN len(wanted_entities) > 0 THEN round(len(list_filter(wanted_entities, lambda w: contains(text, lower(w)))) / len(wanted_entities)::double, 4) END AS entity_recall, confidence, confidence >= 0.3 AND n_results >= 2 AS sufficient FROM x JOIN p USING (query_id) JOIN gate USING (mode, query_id)),
rep AS (SELECT mode, reasoning_type, count(*) AS n, round(avg(recall), 4) AS avg_recall, round(avg("precision"), 4) AS avg_precision, round(avg(section_recall), 4) AS avg_section_recall, round(avg(entity_recall), 4) AS avg_entity_recall, round(avg(CASE WHEN sufficient THEN 0.0::double ELSE 1.0::double END), 4) AS abstention_rate FROM m GROUP BY GROUPING SETS ((mode), (mode, reasoning_type)))
"""


def _metrics(spark, root):
    e = table(spark, root, "eval_queries").distinct()
    docs = F.when(F.size("expected_docs") > 0, F.col("expected_docs")).when(F.col("source_doc").isNotNull(), F.array("source_doc"))
    expected = e.select("query_id", "source_section", "expected_entities", docs.alias("expected_docs"))
    chunks, out = table(spark, root, "chunks"), None
    for mode, use_graph in (("vector_only", False), ("hybrid", True)):
        top = cut(_top(spark, root, use_graph))
        m = R.retrieval_metrics(top, expected, chunks).join(R.confidence(top).select("query_id", "confidence", "sufficient"), "query_id").withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    return out.join(e.select("query_id", "reasoning_type"), "query_id")


@query(_MEASURED + 'SELECT mode, query_id, recall, "precision", section_recall, entity_recall, confidence, sufficient FROM m')
def eval_metrics(spark, root):
    return _metrics(spark, root).drop("reasoning_type")


@query(_MEASURED + "SELECT * FROM rep")
def eval_by_type(spark, root):
    return P.mode_report(_metrics(spark, root), METRICS, "reasoning_type")


@query(_MEASURED + """SELECT reasoning_type, round(coalesce(h.avg_recall, 0.0) - coalesce(v.avg_recall, 0.0), 4) AS recall_delta, round(coalesce(h.avg_precision, 0.0) - coalesce(v.avg_precision, 0.0), 4) AS precision_delta, round(coalesce(h.avg_section_recall, 0.0) - coalesce(v.avg_section_recall, 0.0), 4) AS section_recall_delta,
 round(coalesce(h.avg_entity_recall, 0.0) - coalesce(v.avg_entity_recall, 0.0), 4) AS entity_recall_delta FROM (SELECT * FROM rep WHERE mode = 'vector_only' AND reasoning_type IS NOT NULL) v FULL JOIN (SELECT * FROM rep WHERE mode = 'hybrid' AND reasoning_type IS NOT NULL) h USING (reasoning_type)""")
def eval_delta(spark, root):
    return P.mode_delta(P.mode_report(_metrics(spark, root), METRICS, "reasoning_type"), METRICS, "reasoning_type")


@query(_MEASURED + """SELECT mode, coalesce(reasoning_type, 'all') AS "group", i AS line_no, rpad(label, 24, ' ') || round(v::decimal(18, 4), 3)::varchar AS line FROM (SELECT mode, reasoning_type, unnest([0, 1, 2, 3]) AS i, unnest(['Recall', 'Precision', 'Section recall', 'Entity recall']) AS label, unnest([avg_recall, avg_precision, avg_section_recall, avg_entity_recall]) AS v FROM rep) WHERE v IS NOT NULL""")
def eval_lines(spark, root):
    return P.report_lines(P.mode_report(_metrics(spark, root), METRICS, "reasoning_type"), METRICS, "reasoning_type")


def judged_answers(spark, root):
    """Extractive answers of both modes' hybrid side with word-share grades; no short SQL, tested on a small fixture."""
    top = cut(_top(spark, root))
    chunks = table(spark, root, "chunks")
    said = R.answers(R.evidence_blocks(top, chunks), R.confidence(top)).select("query_id", "answer")
    wanted = table(spark, root, "eval_queries").select("query_id", "expected_answer").distinct()
    return P.judge_proxies(said.join(P.judged_evidence(top, chunks), "query_id", "left").join(wanted, "query_id", "left"))


QUERIES["judged_answers"] = judged_answers
