"""Entity resolution, graph building and traversal over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import graph as G
from quarrylight.plans.registry import register
from quarrylight.plans.text import _QUESTION, _STOP, STEMS, STRIP, _stem_index_sql, _stem_query_sql
from quarrylight.session import cut, table

QUERIES, SQL = {}, {}
_S = STRIP.format
NORM = r"regexp_replace(lower(" + _S("name") + r"), '\s+', ' ', 'g')"
STEMS_OF_NORM = STEMS.replace(NORM, "norm")


query = register(QUERIES, SQL)


def _t(spark, root, *names):
    return [table(spark, root, n) for n in names]


CANON = f"canon AS (SELECT {NORM} AS norm, arg_min(entity_id, (extracted_at, mention_id)) AS canonical_id, min((extracted_at, mention_id)) AS seen FROM entities WHERE name IS NOT NULL AND entity_id IS NOT NULL AND {NORM} <> '' GROUP BY 1)"
CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_name, element_type, section_path FROM chunks WHERE chunk_id IS NOT NULL)"
SECTIONS = "s AS (SELECT chunk_id, doc_name, element_type, d AS depth, len(section_path) AS deepest, 'section::' || doc_name || '::' || array_to_string(section_path[1:d], ' > ') AS id, CASE WHEN d > 1 THEN 'section::' || doc_name || '::' || array_to_string(section_path[1:d - 1], ' > ') END AS parent FROM (SELECT *, unnest(range(1, len(section_path) + 1)) AS d FROM c WHERE len(section_path) > 0))"
LINKS = f"links AS (SELECT DISTINCT 'entity::' || canonical_id AS entity, source_chunk_id AS chunk_id FROM (SELECT *, {NORM} AS norm FROM entities WHERE name IS NOT NULL) JOIN canon USING (norm) WHERE source_chunk_id IN (SELECT chunk_id FROM c))"
RELS = f"""ids AS (SELECT entity_id, min(canonical_id) AS canonical_id FROM (SELECT entity_id, {NORM} AS norm FROM entities WHERE name IS NOT NULL) JOIN canon USING (norm) GROUP BY 1),
rels AS (SELECT 'entity::' || a.canonical_id AS src, 'entity::' || b.canonical_id AS dst, arg_max(coalesce(relation_type, 'related_to'), (extracted_at, rel_id)) AS relation_type FROM relations r JOIN ids a ON r.source_id = a.entity_id JOIN ids b ON r.target_id = b.entity_id GROUP BY 1, 2)"""
EDGES = """edges AS (SELECT chunk_id AS src, 'doc::' || doc_name AS dst, 'belongs_to_document' AS relation_type FROM c UNION ALL SELECT DISTINCT id, 'doc::' || doc_name, 'belongs_to_document' FROM s UNION ALL SELECT DISTINCT id, parent, 'child_of_section' FROM s WHERE parent IS NOT NULL
 UNION ALL SELECT chunk_id, id, CASE WHEN element_type = 'table' THEN 'table_belongs_to_clause' ELSE 'belongs_to_section' END FROM s WHERE depth = deepest UNION ALL SELECT entity, chunk_id, 'mentioned_in' FROM links UNION ALL SELECT chunk_id, entity, 'mentions_entity' FROM links UNION ALL SELECT * FROM rels)"""
CROSS = "across AS (SELECT entity, count(DISTINCT doc_name) AS n_docs FROM links JOIN c USING (chunk_id) GROUP BY 1 HAVING count(DISTINCT doc_name) > 1)"
NAMES = f"names AS (SELECT DISTINCT entity, {_S('lower(n)')} AS name FROM (SELECT 'entity::' || canonical_id AS entity, unnest(list_filter(list_prepend(name, coalesce(mentions, [])), lambda x: x IS NOT NULL)) AS n FROM (SELECT *, {NORM} AS norm FROM entities WHERE name IS NOT NULL) JOIN canon USING (norm)) WHERE length({_S('lower(n)')}) >= 2)"
ALL = f"WITH {CANON}, {CHUNKS}, {SECTIONS}, {LINKS}, {RELS}, {EDGES}, {CROSS}, {NAMES} "
NODES = f"""occ AS (SELECT 'entity::' || canonical_id AS entity, name, entity_type, value, source_doc, (extracted_at, mention_id) AS seen FROM (SELECT *, {NORM} AS norm FROM entities WHERE name IS NOT NULL) JOIN canon USING (norm)),
first_of AS (SELECT DISTINCT ON (entity) entity, name, entity_type, value, source_doc FROM occ ORDER BY entity, seen),
spelled AS (SELECT entity, list(name ORDER BY seen) AS mentions FROM (SELECT entity, name, min(seen) AS seen FROM occ GROUP BY 1, 2) GROUP BY 1),
nn AS (SELECT * FROM first_of JOIN spelled USING (entity))"""
WORDS = f"""kw AS (SELECT query_id, lower(question) AS q, {_QUESTION} AS kw, list_distinct(list_transform({_QUESTION}, lambda w: {_stem_query_sql('w')})) AS ks FROM (SELECT DISTINCT query_id, question FROM eval_queries WHERE question IS NOT NULL)),
toks AS (SELECT DISTINCT {_stem_index_sql('w')} AS stem, entity FROM (SELECT entity, unnest(regexp_split_to_array(name, '\\s+')) AS w FROM names) WHERE length(w) > 1),
cand AS (SELECT DISTINCT query_id, entity FROM (SELECT query_id, unnest(list_concat(kw, ks)) AS stem FROM kw) JOIN toks USING (stem)),
nw AS (SELECT entity, {_S('lower(name)')} AS name, entity_type, list_distinct(list_filter(regexp_split_to_array({_S('lower(name)')}, '\\s+'), lambda w: length(w) > 0 AND NOT list_contains({_STOP}, w))) AS w FROM nn),
nv AS (SELECT *, list_distinct(list_transform(w, lambda x: {_stem_query_sql('x')})) AS ws FROM nw WHERE length(name) >= 2),
by_words AS (SELECT query_id, entity FROM cand JOIN nv USING (entity) JOIN kw USING (query_id) WHERE (length(name) > 2 AND contains(q, name))
 OR (len(w) > 0 AND greatest(len(list_intersect(w, kw)), len(list_intersect(ws, ks))) >= greatest(1.0::double, 0.5::double * len(w)))
 OR (coalesce(entity_type IN ('organization', 'role', 'regulation', 'product'), false) AND len(list_filter(w, lambda x: length(x) > 3 AND (contains(q, x) OR list_contains(ks, {_stem_query_sql('x')})))) > 0)),
matched AS (SELECT query_id, entity FROM by_words UNION SELECT DISTINCT query_id, entity FROM eval_queries JOIN names ON contains(lower(question), name) AND length(name) >= 3)"""
WITH_REC = ALL.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"WITH {CANON} SELECT norm, canonical_id FROM canon")
def align_exact(spark, root):
    return G.canonical_names(table(spark, root, "entities")).select("norm", "canonical_id")


@query(f"WITH {CANON}, n AS (SELECT *, {STEMS_OF_NORM} AS stems FROM canon), k AS (SELECT stems, arg_max(canonical_id, seen) AS survivor FROM n WHERE len(stems) > 0 GROUP BY 1) SELECT norm, canonical_id, coalesce(survivor, canonical_id) AS merged_id FROM n LEFT JOIN k USING (stems)")
def align_stems(spark, root):
    return G.merged_by_stems(G.canonical_names(table(spark, root, "entities")))


@query(f"""WITH {CANON}, n AS (SELECT min(norm) AS norm, {STEMS_OF_NORM} AS stems FROM canon GROUP BY 2 HAVING len(stems) > 0)
SELECT a.norm AS norm_a, b.norm AS norm_b, len(list_intersect(a.stems, b.stems)) / len(list_distinct(a.stems || b.stems))::double AS score FROM n a JOIN n b ON a.norm < b.norm AND len(list_intersect(a.stems, b.stems)) >= 0.8::double * len(list_distinct(a.stems || b.stems))""")
def align_jaccard(spark, root):
    return G.similar_names(G.canonical_names(table(spark, root, "entities")), 0.8)


_MERGED = f"""WITH RECURSIVE {CANON}, n AS (SELECT *, {STEMS_OF_NORM} AS stems FROM canon),
p AS (SELECT a.norm, arg_min(b.norm, (-(len(list_intersect(a.stems, b.stems)) / len(list_distinct(a.stems || b.stems))::double), b.seen)) AS up FROM n a JOIN n b ON len(a.stems) > 0 AND len(b.stems) > 0 AND b.seen > a.seen
  AND len(list_intersect(a.stems, b.stems)) / len(list_distinct(a.stems || b.stems))::double >= 0.85::double GROUP BY 1),
w AS (SELECT norm, norm AS spot, 0 AS d FROM n UNION ALL SELECT w.norm, p.up, d + 1 FROM w JOIN p ON p.norm = w.spot),
m AS (SELECT norm, arg_max(spot, d) AS root FROM w GROUP BY 1), merged AS (SELECT n.norm, n.canonical_id, r.canonical_id AS merged_id FROM n JOIN m USING (norm) JOIN n r ON r.norm = m.root)
"""


@query(_MERGED + "SELECT norm, canonical_id, merged_id FROM merged")
def align_merged(spark, root):
    return G.merged_names(G.canonical_names(table(spark, root, "entities")))


@query(_MERGED + f"SELECT (SELECT count(DISTINCT entity_id) FROM entities WHERE name IS NOT NULL AND entity_id IS NOT NULL AND {NORM} <> '') AS n_entities, count(DISTINCT canonical_id) AS n_exact, count(DISTINCT merged_id) AS n_canonical, (SELECT count(DISTINCT entity_id) FROM entities WHERE name IS NOT NULL AND entity_id IS NOT NULL AND {NORM} <> '') - count(DISTINCT merged_id) AS n_merged FROM merged")
def align_stats(spark, root):
    e = table(spark, root, "entities")
    named = e.where("name is not null and entity_id is not null").where(T.strip(F.col("name")) != "").agg(F.count_distinct("entity_id").alias("n_entities"))
    merged = G.merged_names(G.canonical_names(e)).agg(F.count_distinct("canonical_id").alias("n_exact"), F.count_distinct("merged_id").alias("n_canonical"))
    return named.join(merged).withColumn("n_merged", F.col("n_entities") - F.col("n_canonical"))


@query(ALL + """SELECT chunk_id AS id, 'chunk' AS node_type, CASE WHEN element_type = 'text' THEN 'text' ELSE 'cross_modal' END AS layer, NULL AS name, doc_name, NULL::int AS depth FROM c
 UNION ALL SELECT DISTINCT 'doc::' || doc_name, 'document', 'text', doc_name, doc_name, NULL FROM c UNION ALL SELECT DISTINCT id, 'section', 'text', NULL, doc_name, depth FROM s
 UNION ALL SELECT 'entity::' || canonical_id, 'entity', 'text', arg_min(norm, seen), NULL, NULL FROM canon GROUP BY canonical_id""")
def graph_nodes(spark, root):
    return G.nodes(*_t(spark, root, "chunks", "entities"))


@query(ALL + "SELECT * FROM edges")
def graph_edges(spark, root):
    return G.edges(*_t(spark, root, "chunks", "entities", "relations"))


@query(ALL + "SELECT * FROM rels")
def relation_overwrite(spark, root):
    return G.relation_edges(*_t(spark, root, "entities", "relations"))


@query(ALL + "SELECT relation_type, count(*) AS n FROM edges GROUP BY GROUPING SETS ((relation_type), ())")
def graph_stats(spark, root):
    e = graph_edges(spark, root)
    return e.groupingSets([[F.col("relation_type")], []], "relation_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANON}, {CHUNKS} SELECT DISTINCT mention_id FROM (SELECT *, {NORM} AS norm FROM entities WHERE name IS NOT NULL) JOIN canon USING (norm) WHERE source_chunk_id IS NULL OR source_chunk_id NOT IN (SELECT chunk_id FROM c)")
def orphan_mentions(spark, root):
    e, c = _t(spark, root, "entities", "chunks")
    return G.mention_links(e, c)[1].distinct()


@query(ALL + "SELECT * FROM across")
def cross_doc_entities(spark, root):
    e, c = _t(spark, root, "entities", "chunks")
    return G.cross_document(e, c)


@query(ALL + "SELECT name, entity FROM names")
def name_index(spark, root):
    return G.name_index(table(spark, root, "entities")).select("name", "entity")


@query(ALL + f"SELECT DISTINCT {_stem_index_sql('w')} AS stem, entity FROM (SELECT entity, unnest(regexp_split_to_array(name, '\\s+')) AS w FROM names) WHERE length(w) > 1")
def token_index(spark, root):
    return G.token_index(table(spark, root, "entities"))


@query(ALL + "SELECT DISTINCT query_id, entity FROM eval_queries JOIN names ON contains(lower(question), name) AND length(name) >= 3")
def query_entity_match(spark, root):
    return G.match_questions(table(spark, root, "eval_queries").where("question is not null"), G.name_index(table(spark, root, "entities")))


@query(ALL + f", {NODES}, {WORDS} SELECT query_id, entity FROM by_words")
def query_entity_words(spark, root):
    e = table(spark, root, "entities")
    return G.match_by_words(table(spark, root, "eval_queries").where("question is not null"), G.entity_nodes(e), G.token_index(e))


@query(ALL + f", {NODES} SELECT entity, name, entity_type, value, source_doc, array_to_string(mentions, '|') AS mentions FROM nn")
def entity_nodes(spark, root):
    return G.entity_nodes(table(spark, root, "entities")).withColumn("mentions", F.array_join("mentions", "|"))


@query(ALL + "SELECT entity, name FROM names WHERE contains(name, 'council')")
def find_entity(spark, root):
    return G.name_index(table(spark, root, "entities")).where(F.contains("name", F.lit("council"))).select("entity", "name")


_SEEDS = "seeds AS (SELECT DISTINCT 'all' AS query_id, entity AS node FROM names WHERE contains(name, 'council of monetary'))"


@query(WITH_REC + f", {_SEEDS}, e3 AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst), r AS (SELECT node, 0 AS hop FROM seeds UNION SELECT e3.dst, r.hop + 1 FROM r JOIN e3 ON e3.src = r.node WHERE r.hop < 2) SELECT 'all' AS query_id, node, min(hop) AS hop FROM r GROUP BY node")
def neighbors_2hop(spark, root):
    e = table(spark, root, "entities")
    seeds = G.name_index(e).where(F.contains("name", F.lit("council of monetary"))).select(F.lit("all").alias("query_id"), F.col("entity").alias("node"))
    return G.expand(seeds, graph_edges(spark, root), 2, skip=())


def _trail_edges(spark, root):
    """(entity, chunk_id) links, and the edges (src, dst) between chunks and entities.

    Trails to entities need no others: from sections and documents no edge leads back to a chunk or an entity.
    """
    e, c, r = _t(spark, root, "entities", "chunks", "relations")
    links = cut(G.mention_links(e, c)[0].select("entity", "chunk_id"))
    between = cut(G.relation_edges(e, r).select("src", "dst"))
    return links, links.select(F.col("chunk_id").alias("src"), F.col("entity").alias("dst")).unionAll(links).unionAll(between)


@query(ALL + "SELECT chunk_id AS src, entity AS dst, chunk_id || ' > ' || entity AS path FROM links")
def evidence_paths(spark, root):
    links, edges = _trail_edges(spark, root)
    pairs = links.select(F.col("chunk_id").alias("src"), F.col("entity").alias("dst"))
    return G.shortest_path(pairs, edges, hops=1).select("src", "dst", F.array_join("path", " > ").alias("path"))


def shortest_path(spark, root):
    """Trails from each retrieved chunk to the wanted entities of its query that it does not name itself."""
    e, r = _t(spark, root, "entities", "retrieval_results")
    named = r.select("query_id", F.explode("connected_entities").alias("n")).select("query_id", F.lower("n").alias("name")).distinct()
    wanted = cut(named.join(G.name_index(e), "name").select("query_id", F.col("entity").alias("dst")).distinct())
    found = G.trails(r.select("query_id", F.col("chunk_id").alias("src")), wanted, _trail_edges(spark, root)[1])
    return found.where(F.size("path") != 2).select("src", "dst", F.array_join("path", " > ").alias("path"))


QUERIES["shortest_path"] = shortest_path


@query(ALL + """, w AS (SELECT DISTINCT r.query_id, l.entity FROM (SELECT DISTINCT query_id, unnest(connected_entities) AS n FROM retrieval_results) r JOIN (SELECT DISTINCT name, entity AS entity FROM names) l ON lower(r.n) = l.name),
k AS (SELECT DISTINCT query_id, chunk_id FROM retrieval_results), j AS (SELECT k.query_id, k.chunk_id, count(*) * 2 AS n, max(CASE WHEN w.entity IS NULL THEN 0 ELSE 1 END) AS wanted, max(CASE WHEN a.entity IS NULL THEN 0 ELSE 1 END) AS x
 FROM k JOIN links USING (chunk_id) LEFT JOIN w ON w.query_id = k.query_id AND w.entity = links.entity LEFT JOIN across a ON a.entity = links.entity GROUP BY 1, 2)
SELECT k.query_id, k.chunk_id, CASE WHEN n IS NULL THEN 0.0::double ELSE round(least(0.3::double * least(n / 5.0::double, 1.0::double) + 0.5::double * wanted + 0.2::double * x, 1.0::double), 4) END AS graph_score FROM k LEFT JOIN j USING (query_id, chunk_id)""")
def graph_score(spark, root):
    e, c, r = _t(spark, root, "entities", "chunks", "retrieval_results")
    named = r.select("query_id", F.explode("connected_entities").alias("n")).select("query_id", F.lower("n").alias("name")).distinct()
    wanted = named.join(G.name_index(e), "name").select("query_id", "entity").distinct()
    return G.graph_scores(r, G.mention_links(e, c)[0], wanted, G.cross_document(e, c))


@query(ALL + """, n AS (SELECT DISTINCT chunk_id, norm FROM links JOIN (SELECT 'entity::' || canonical_id AS entity, arg_min(norm, seen) AS norm FROM canon GROUP BY canonical_id) USING (entity))
SELECT chunk_id, array_to_string(list(norm ORDER BY norm)[1:5], '|') AS connected FROM n GROUP BY chunk_id""")
def connected_entities(spark, root):
    e, c = _t(spark, root, "entities", "chunks")
    names = G.canonical_names(e).groupBy(F.concat(F.lit("entity::"), "canonical_id").alias("entity")).agg(F.min_by("norm", "seen").alias("norm"))
    pairs = G.mention_links(e, c)[0].join(names, "entity").select("chunk_id", "norm").distinct()
    from pyspark.sql import Window

    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("norm"))).where("n <= 5")
    return first.groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "norm"))), lambda x: x["norm"]), "|").alias("connected"))


@query(ALL + ", focus AS (SELECT doc_name FROM c GROUP BY 1 ORDER BY count(*) DESC, doc_name LIMIT 1) SELECT DISTINCT l.entity, l.chunk_id FROM links l JOIN c USING (chunk_id) WHERE c.doc_name IN (SELECT doc_name FROM focus)")
def focus_subgraph(spark, root):
    e, c = _t(spark, root, "entities", "chunks")
    docs = G.chunk_nodes(c)
    focus = docs.groupBy("doc_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc_name").limit(1)
    return G.mention_links(e, c)[0].join(docs.join(focus, "doc_name", "left_semi").select("chunk_id"), "chunk_id", "left_semi").select("entity", "chunk_id")
