"""Extraction, stores and small reports over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import extraction as E
from quarrylight.operators import graph as G
from quarrylight.operators import stores as S
from quarrylight.operators.access import access_levels
from quarrylight.operators.references import resolve_references
from quarrylight.plans.graph import ALL
from quarrylight.plans.registry import register
from quarrylight.plans.text import STRIP
from quarrylight.session import table

QUERIES, SQL = {}, {}
query = register(QUERIES, SQL)
_S = STRIP.format


def _responses(spark, root):
    """Answers as a model would give them, made of the mentions and relations of each chunk: plain, fenced, in prose, or broken."""
    e = table(spark, root, "entities").where("source_chunk_id is not null").select("mention_id", "entity_id", "name", "entity_type", "value", "source_chunk_id", "source_doc").distinct()
    said = F.array_sort(F.collect_list(F.struct("mention_id", "name", F.col("entity_type").alias("type"), "value")))
    chunk = e.groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.min_by(F.coalesce("source_doc", F.lit("")), "mention_id").alias("doc_name"), F.min("mention_id").alias("k"), said.alias("es"))
    first = e.where("entity_id is not null").groupBy("entity_id").agg(F.min_by(F.struct("name", "source_chunk_id"), "mention_id").alias("m"))
    r = table(spark, root, "relations").select("rel_id", "source_id", "target_id", "relation_type").distinct()
    r = r.join(first.toDF("source_id", "s"), "source_id").join(first.toDF("target_id", "t"), "target_id")
    rel = r.groupBy(F.col("s.source_chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("rel_id", F.col("s.name").alias("source"), F.col("t.name").alias("target"), F.col("relation_type").alias("type")))).alias("rs"))
    j = chunk.join(rel, "chunk_id", "left")
    entities = F.transform("es", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["value"].alias("value")))
    relations = F.transform(F.coalesce("rs", F.array().cast("array<struct<rel_id:bigint,source:string,target:string,type:string>>")), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type")))
    text = F.to_json(F.struct(entities.alias("entities"), relations.alias("relations")))
    kind = F.pmod("k", F.lit(5))
    wrapped = F.when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), text, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), text, F.lit(" - done."))).when(kind == 4, F.concat(F.lit("I cannot. "), F.substring(text, 1, 20))).otherwise(text)
    return j.select("chunk_id", "doc_name", wrapped.alias("response"))


_MENTIONS = f"""e AS (SELECT DISTINCT mention_id, entity_id, name, entity_type, value, source_chunk_id AS chunk_id, source_doc FROM entities WHERE source_chunk_id IS NOT NULL),
k AS (SELECT chunk_id, min(mention_id) AS k, arg_min(coalesce(source_doc, ''), mention_id) AS doc FROM e GROUP BY 1),
x AS (SELECT e.chunk_id, row_number() OVER (PARTITION BY e.chunk_id ORDER BY mention_id) - 1 AS n, {_S('name')} AS name, {_S("coalesce(nullif(entity_type, ''), 'unknown')")} AS entity_type, CASE WHEN value NOT IN ('', '0', 'false') THEN value END AS value, doc FROM e JOIN k USING (chunk_id) WHERE k.k % 5 <> 4),
found AS (SELECT chunk_id, n, substr(sha256(concat_ws('::', doc, entity_type, {_S('lower(name)')})), 1, 12) AS entity_id, name, entity_type, value, doc FROM x WHERE length(name) > 0)"""


@query(f"WITH {_MENTIONS} SELECT chunk_id, n::int AS n, entity_id, name, entity_type, value, doc AS source_doc FROM found")
def extracted_entities(spark, root):
    return E.entities_of(E.parsed(_responses(spark, root))).drop("mentions")


@query(f"""WITH {_MENTIONS}, f AS (SELECT entity_id, arg_min({{'n': name, 'c': chunk_id}}, mention_id) AS m FROM e WHERE entity_id IS NOT NULL GROUP BY 1),
r AS (SELECT s.m.c AS chunk_id, row_number() OVER (PARTITION BY s.m.c ORDER BY rel_id) - 1 AS n, {_S('s.m.n')} AS s, {_S('t.m.n')} AS t, {_S("coalesce(nullif(relation_type, ''), 'related_to')")} AS relation_type FROM (SELECT DISTINCT rel_id, source_id, target_id, relation_type FROM relations) r JOIN f s ON s.entity_id = r.source_id JOIN f t ON t.entity_id = r.target_id),
ids AS (SELECT chunk_id, name, arg_max(entity_id, n) AS id FROM found GROUP BY 1, 2)
SELECT r.chunk_id, r.n::int AS n, a.id AS source_id, b.id AS target_id, relation_type FROM r JOIN ids a ON a.chunk_id = r.chunk_id AND a.name = r.s JOIN ids b ON b.chunk_id = r.chunk_id AND b.name = r.t""")
def extracted_relations(spark, root):
    return E.relations_of(E.parsed(_responses(spark, root)))


@query(f"WITH {_MENTIONS} SELECT chunk_id FROM k WHERE k.k % 5 = 4")
def extraction_failures(spark, root):
    return E.failed(E.parsed(_responses(spark, root)))


_RULED = " UNION ALL ".join(f"SELECT chunk_id, doc_name, '{k}' AS entity_type, unnest(list_distinct(regexp_extract_all(content, '{p}'))) AS name FROM c" for k, p in E.RULES)


@query(f"WITH c AS (SELECT DISTINCT chunk_id, doc_name, content FROM chunks) SELECT chunk_id, substr(sha256(concat_ws('::', doc_name, entity_type, lower(name))), 1, 12) AS entity_id, name, entity_type, name AS value FROM ({_RULED})")
def rule_entities(spark, root):
    c = table(spark, root, "chunks").select("chunk_id", "doc_name", "content").distinct()
    return E.entities_of(E.parsed(c.select("chunk_id", "doc_name", E.by_rules(F.col("content")).alias("response")))).select("chunk_id", "entity_id", "name", "entity_type", "value")


@query("SELECT vec_id, label, embedding FROM (SELECT DISTINCT ON (vec_id) vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, embedding FROM embeddings)")
def vector_upsert(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", "label", "embedding").dropDuplicates(["vec_id"])
    return S.merged_rows(e, e.where("vec_id % 3 = 0").withColumn("label", (F.col("label") + 100).cast(e.schema["label"].dataType)), ["vec_id"])


@query(ALL + "SELECT 'node' AS kind, id AS first, NULL AS second, count(*) AS n FROM (SELECT chunk_id AS id FROM c UNION ALL SELECT DISTINCT 'doc::' || doc_name FROM c UNION ALL SELECT DISTINCT id FROM s UNION ALL SELECT DISTINCT 'entity::' || canonical_id FROM canon) GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'edge', src, dst, count(*) FROM edges GROUP BY 2, 3 HAVING count(*) > 1")
def graph_repeats(spark, root):
    c, e, r = (table(spark, root, t) for t in ("chunks", "entities", "relations"))
    nodes = S.repeated_keys(G.nodes(c, e), ["id"]).select(F.lit("node").alias("kind"), F.col("id").alias("first"), F.lit(None).cast("string").alias("second"), "n")
    return nodes.unionAll(S.repeated_keys(G.edges(c, e, r), ["src", "dst"]).select(F.lit("edge"), "src", "dst", "n"))


_NODES = "nodes AS (SELECT chunk_id AS id, 'chunk' AS node_type, doc_name AS label FROM c UNION ALL SELECT DISTINCT 'doc::' || doc_name, 'document', substr(doc_name, 1, 25) FROM c UNION ALL SELECT DISTINCT id, 'section', substr(id, 1, 30) FROM s UNION ALL SELECT 'entity::' || canonical_id, 'entity', substr(arg_min(norm, seen), 1, 40) FROM canon GROUP BY canonical_id), kept AS (SELECT * FROM nodes WHERE node_type IN ('entity', 'document') ORDER BY id LIMIT 500)"


@query(ALL + f", {_NODES} SELECT id, node_type, label FROM kept")
def export_nodes(spark, root):
    c, e, r = (table(spark, root, t) for t in ("chunks", "entities", "relations"))
    return S.graph_export(G.nodes(c, e), G.edges(c, e, r), ("entity", "document"))[0]


@query(ALL + f", {_NODES} SELECT src, dst, relation_type AS label, 2 AS width FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) AND src LIKE 'entity::%'")
def export_edges(spark, root):
    c, e, r = (table(spark, root, t) for t in ("chunks", "entities", "relations"))
    return S.graph_export(G.nodes(c, e), G.edges(c, e, r), ("entity", "document"))[1]


@query(ALL + f", {_NODES} SELECT node_type, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((node_type), ())")
def node_stats(spark, root):
    n = G.nodes(table(spark, root, "chunks"), table(spark, root, "entities"))
    return n.groupingSets([[F.col("node_type")], []], "node_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT source, 'docs' || '__' || lower(regexp_replace(regexp_replace(source, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS collection FROM documents WHERE source IS NOT NULL")
def collection_names(spark, root):
    return table(spark, root, "documents").where("source is not null").select("source").distinct().select("source", S.collection_name(F.lit("docs"), F.col("source")).alias("collection"))


@query("SELECT DISTINCT substr(sha256(content), 1, 12) AS text_hash FROM chunks WHERE content IS NOT NULL")
def embedding_log(spark, root):
    c = table(spark, root, "chunks").where("content is not null").select("content", F.array(F.lit(0.0)).alias("v"))
    return S.embedding_log(c, "content", "v").select("text_hash").distinct()


_KIND = "CASE WHEN len(expected_docs) > 1 THEN 'multi' ELSE 'single' END"


@query(f"SELECT query_id, kind FROM (SELECT query_id, {_KIND} AS kind, row_number() OVER (PARTITION BY {_KIND} ORDER BY query_id) AS n FROM (SELECT DISTINCT query_id, expected_docs FROM eval_queries)) WHERE n <= 5")
def eval_quick(spark, root):
    """The first five evaluation items of each kind, for a quick run."""
    from pyspark.sql import Window

    q = table(spark, root, "eval_queries").select("query_id", F.when(F.size("expected_docs") > 1, "multi").otherwise("single").alias("kind")).distinct()
    return q.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("query_id"))).where("n <= 5").drop("n")


@query("SELECT mention_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS spellings FROM (SELECT DISTINCT mention_id, list_filter(list_prepend(name, coalesce(mentions, [])), lambda x: x IS NOT NULL) AS l FROM entities)")
def spellings(spark, root):
    e = table(spark, root, "entities").select("mention_id", F.concat(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>"))).alias("l"))
    return e.select("mention_id", F.array_join(T.first_seen(F.col("l")), "|").alias("spellings")).distinct()


@query("SELECT element_type, level, count(*) AS n FROM (SELECT DISTINCT chunk_id, element_type, coalesce(a.level, 3) AS level FROM chunks LEFT JOIN (SELECT doc_name, max(level) AS level FROM doc_access GROUP BY 1) a USING (doc_name)) GROUP BY GROUPING SETS ((element_type), (level))")
def chunk_histogram(spark, root):
    c = access_levels(table(spark, root, "chunks").select("chunk_id", "element_type", "doc_name").distinct(), table(spark, root, "doc_access")).select("chunk_id", "element_type", "level").distinct()
    return c.groupingSets([[F.col("element_type")], [F.col("level")]], "element_type", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT mention_id, source_doc, source_chunk_id FROM entities WHERE source_doc IS NOT NULL OR source_chunk_id IS NOT NULL)
SELECT mention_id, CASE WHEN (source_doc IS NOT NULL AND source_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_name = r.source_doc AND c.chunk_id = r.source_chunk_id)) OR (source_chunk_id IS NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_name = r.source_doc)) OR (source_doc IS NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = r.source_chunk_id)) THEN 'missing' ELSE 'ok' END AS state FROM r""")
def composite_references(spark, root):
    """Where each mention stands, by document and chunk together; what is null is not asked for."""
    e = table(spark, root, "entities").select("mention_id", "source_doc", "source_chunk_id", F.lit(None).cast("timestamp").alias("at"))
    c = table(spark, root, "chunks").select("doc_name", "chunk_id", "indexed_at")
    return resolve_references(e, "mention_id", ["source_doc", "source_chunk_id"], "at", c, ["doc_name", "chunk_id"], "indexed_at", match="partial").select("mention_id", "state")
