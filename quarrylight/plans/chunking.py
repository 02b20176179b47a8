"""Chunking over the elements, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import chunking as C
from quarrylight.plans.registry import register
from quarrylight.plans.text import STRIP
from quarrylight.session import spread, table

QUERIES, SQL = {}, {}
_S = STRIP.format
_TOK = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


query = register(QUERIES, SQL)


def _elements(spark, root, *more):
    return spread(table(spark, root, "elements").select("element_id", "doc_name", "element_type", "content", "section_path", "pos", "language", "parsed_at", *more))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT ON (element_id) element_id, doc_name, element_type, content, pos, try_cast(metadata['level'] AS int) AS level FROM elements ORDER BY element_id, parsed_at),
h AS (SELECT doc_name, content, pos, greatest(coalesce(level, 1), 1) AS level, row_number() OVER (PARTITION BY doc_name ORDER BY pos) AS i FROM e WHERE element_type = 'heading'),
f AS (SELECT doc_name, i, pos, [content] AS path FROM h WHERE i = 1
 UNION ALL SELECT h.doc_name, h.i, h.pos, list_append(f.path[1:h.level - 1], h.content) FROM f JOIN h ON h.doc_name = f.doc_name AND h.i = f.i + 1)
SELECT e.element_id, array_to_string(coalesce(f.path, []), ' > ') AS path FROM e ASOF LEFT JOIN f ON e.doc_name = f.doc_name AND e.pos >= f.pos""")
def section_path(spark, root):
    return C.section_paths(_elements(spark, root, "metadata")).select("element_id", F.array_join("path", " > ").alias("path"))


_RUNS = f"""e AS (SELECT * FROM (SELECT DISTINCT ON (element_id) element_id, doc_name, element_type, content, section_path, language, pos FROM elements ORDER BY element_id, parsed_at) WHERE length({_S('content')}) > 0),
g AS (SELECT *, lag(section_path) OVER w AS ps, lag(element_type) OVER w AS pt FROM e WINDOW w AS (PARTITION BY doc_name ORDER BY pos)),
r AS (SELECT *, sum(CASE WHEN pt IS NULL OR ps <> section_path OR element_type = 'table' OR pt = 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_name ORDER BY pos) AS run,
  sum(CASE WHEN pt IS NULL OR ps <> section_path THEN 1 ELSE 0 END) OVER (PARTITION BY doc_name ORDER BY pos) AS section FROM g)"""


@query(f"WITH {_RUNS} SELECT element_id, run::bigint AS run FROM r")
def section_runs(spark, root):
    return C.element_runs(_elements(spark, root)).select("element_id", F.col("run").cast("bigint").alias("run"))


def _chunks_sql(max_tokens: int, overlap: int) -> str:
    prefix = "'[' || doc_name || CASE WHEN len(section_path) > 0 THEN ' | ' || array_to_string(section_path, ' > ') ELSE '' END || ']'"
    split = r"list_filter(list_transform(string_split(regexp_replace(" + _S("content") + r", '([.!?؟])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + _S("s") + "), lambda s: length(s) > 0)"
    return f"""WITH RECURSIVE {_RUNS},
l AS (SELECT *, first_value(language) OVER (PARTITION BY doc_name, section ORDER BY pos) AS lang FROM r),
t AS (SELECT doc_name, run, lang, pos, element_id, section_path, {prefix} AS prefix, greatest({max_tokens} - {_TOK.format(prefix)}, 50) AS budget, {split} AS s FROM l WHERE element_type NOT IN ('heading', 'table')),
u AS (SELECT doc_name, run, lang, pos, element_id, section_path, prefix, budget, unnest(s) AS sentence, unnest(range(len(s))) AS k FROM t),
v AS (SELECT * EXCLUDE (sentence), sentence, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS toks FROM u),
w AS (SELECT doc_name, run, lang, pos, element_id, section_path, prefix, budget, k, 0 AS q, sentence FROM v WHERE len(toks) <= budget
 UNION ALL SELECT doc_name, run, lang, pos, element_id, section_path, prefix, budget, k, q, array_to_string(toks[q * budget + 1:(q + 1) * budget], ' ') FROM (SELECT *, unnest(range(0, ((len(toks) + budget - 1) // budget)::bigint)) AS q FROM v WHERE len(toks) > budget)),
x AS (SELECT doc_name, run, lang, section_path, prefix, budget, list({{'s': sentence, 'e': element_id}} ORDER BY pos, k, q) AS m, list({_TOK.format('sentence')} ORDER BY pos, k, q) AS tok FROM w GROUP BY doc_name, run, lang, section_path, prefix, budget),
y AS (SELECT *, list_transform(range(0, len(tok) + 1), lambda i: coalesce(list_sum(tok[1:i]), 0)) AS c FROM x),
z AS (SELECT doc_name, run, budget, c, len(m) AS n, 0::bigint AS chunk_no, 0::bigint AS start,
   list_max(list_filter(range(0, len(c)), lambda f: c[f + 1] <= budget)) AS stop FROM y
 UNION ALL SELECT doc_name, run, budget, c, n, chunk_no + 1, s, greatest(z.stop + 1, list_max(list_filter(range(0, len(c)), lambda f: c[f + 1] <= c[s + 1] + budget)))
   FROM (SELECT *, list_min(list_filter(range(0, stop + 1), lambda b: c[b + 1] >= c[stop + 1] - {overlap})) AS s FROM z WHERE stop < n) z),
made AS (SELECT z.doc_name, z.run, z.chunk_no, 'text' AS element_type, prefix || chr(10) || chr(10) || array_to_string(list_transform(m[start + 1:stop], lambda p: p.s), ' ') AS content, section_path,
   list_transform(m[start + 1:stop], lambda p: p.e) AS ids, lang FROM z JOIN y ON z.doc_name = y.doc_name AND z.run = y.run
 UNION ALL SELECT doc_name, run, 0, 'table', content, section_path, [element_id], lang FROM l WHERE element_type = 'table'),
cut AS (SELECT * REPLACE (CASE WHEN {_TOK.format('content')} > 7500 THEN array_to_string(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')[1:7500], ' ') ELSE content END AS content) FROM made),
o AS (SELECT *, row_number() OVER (ORDER BY doc_name, run, chunk_no) - 1 AS chunk_index FROM cut)
SELECT doc_name, run::bigint AS run, chunk_no, element_type, content, array_to_string(section_path, ' > ') AS section, array_to_string(list_filter(ids, lambda e, i: i = 1 OR e <> ids[i - 1]), ',') AS source_element_ids, lang AS language,
 {_TOK.format('content')}::int AS token_estimate, chunk_index::bigint AS chunk_index, substr(sha256(concat_ws('::', doc_name, element_type, chunk_index::varchar, substr(content, 1, 100))), 1, 16) AS chunk_id FROM o"""


def _chunks(spark, root, max_tokens, overlap):
    c = C.chunks(_elements(spark, root), max_tokens=max_tokens, overlap=overlap)
    return c.select(
        "doc_name", F.col("run").cast("bigint").alias("run"), F.col("chunk_no").cast("bigint").alias("chunk_no"), "element_type", "content", F.array_join("section_path", " > ").alias("section"),
        F.array_join("source_element_ids", ",").alias("source_element_ids"), "language", "token_estimate", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id",
    )


@query(_chunks_sql(512, 50))
def chunk_pack(spark, root):
    return _chunks(spark, root, 512, 50)


@query(_chunks_sql(96, 16))
def chunk_overlap(spark, root):
    return _chunks(spark, root, 96, 16)


@query("""SELECT element_type, count(*) AS n_chunks, min(t) AS min_tokens, max(t) AS max_tokens, round(avg(t), 4) AS avg_tokens, sum(t)::bigint AS sum_tokens, count_if(t > 512) AS oversize, count_if(t > 7500) AS danger,
 round(avg(abs(t - coalesce(token_estimate, t))), 4) AS avg_estimate_error FROM (SELECT DISTINCT chunk_id, element_type, token_estimate, """ + _TOK.format("content") + " AS t FROM chunks WHERE content IS NOT NULL) GROUP BY 1")
def chunk_stats(spark, root):
    c = table(spark, root, "chunks").where("content is not null").select("chunk_id", "element_type", "token_estimate", "content").distinct().withColumn("t", T.token_count(F.col("content")))
    return c.groupBy("element_type").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"), F.round(F.avg("t"), 4).alias("avg_tokens"), F.sum("t").alias("sum_tokens"),
        F.count_if(F.col("t") > 512).alias("oversize"), F.count_if(F.col("t") > 7500).alias("danger"), F.round(F.avg(F.abs(F.col("t") - F.coalesce("token_estimate", "t"))), 4).alias("avg_estimate_error"),
    )


@query("""SELECT DISTINCT c.chunk_id, coalesce(a.level, 3) AS level FROM chunks c LEFT JOIN (SELECT doc_name, max(level) AS level FROM doc_access GROUP BY 1) a USING (doc_name)""")
def chunk_access(spark, root):
    from quarrylight.operators.access import access_levels

    c = table(spark, root, "chunks").select("chunk_id", "doc_name").distinct()
    return access_levels(c, table(spark, root, "doc_access")).select("chunk_id", "level")


@query("SELECT element_type, language, count(*) AS n FROM (SELECT DISTINCT element_id, element_type, language FROM elements) GROUP BY GROUPING SETS ((element_type), (element_type, language), ())")
def element_histogram(spark, root):
    e = table(spark, root, "elements").select("element_id", "element_type", "language").distinct()
    return e.groupingSets([[F.col("element_type")], [F.col("element_type"), F.col("language")], []], "element_type", "language").agg(F.count(F.lit(1)).alias("n"))


def split_rows(spark, root):
    """Tables in lines as pieces of at most 64 tokens; the fold has no short SQL, tests hold it against brute force."""
    t = table(spark, root, "elements").where("element_type = 'table'").select("element_id", "content").distinct()
    return t.select("element_id", F.posexplode(C.split_table_rows(F.col("content"), 64)).alias("piece_no", "piece"))


QUERIES["split_table_rows"] = split_rows
