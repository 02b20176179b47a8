"""Text functions over the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.plans.registry import register
from quarrylight.session import table

QUERIES, SQL = {}, {}


query = register(QUERIES, SQL)


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_S = STRIP.format
ELEMENTS = "(SELECT DISTINCT element_id, doc_name, element_type, content, pos FROM elements)"


def elements(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "elements").select("element_id", "doc_name", "element_type", "content", "pos").distinct()


@query(f"""SELECT element_id, CASE WHEN content IS NULL OR length({_S('content')}) = 0 THEN 'unknown'
 WHEN (length(content) - length(regexp_replace(content, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}]', '', 'g'))) / length(content)::double > 0.3 THEN 'ar' ELSE 'en' END AS detected FROM {ELEMENTS}""")
def lang_detect(spark, root):
    return elements(spark, root).select("element_id", T.detect_script_language(F.col("content")).alias("detected"))


@query(f"""SELECT element_id, substr(sha256(concat_ws('::', doc_name, element_type, pos::varchar, substr(coalesce(content, ''), 1, 100))), 1, 16) AS hashed_id FROM {ELEMENTS}""")
def element_ids(spark, root):
    return elements(spark, root).select("element_id", T.hash_id(16, F.col("doc_name"), F.col("element_type"), F.col("pos"), F.substring("content", 1, 100)).alias("hashed_id"))


@query("""SELECT chunk_id, substr(sha256(concat_ws('::', doc_name, element_type, (row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) - 1)::varchar, substr(content, 1, 100))), 1, 16) AS id_v2,
 substr(sha256(concat_ws('::', doc_name, (row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) - 1)::varchar, substr(content, 1, 50))), 1, 16) AS id_v3 FROM (SELECT DISTINCT chunk_id, doc_name, element_type, content FROM chunks)""")
def chunk_ids(spark, root):
    from quarrylight.operators.scan import numbered

    c = numbered(table(spark, root, "chunks").select("chunk_id", "doc_name", "element_type", "content").distinct(), ["doc_name"], "chunk_id", "chunk_index")
    i = F.col("chunk_index") - 1
    return c.select("chunk_id", T.hash_id(16, F.col("doc_name"), F.col("element_type"), i, F.substring("content", 1, 100)).alias("id_v2"), T.hash_id(16, F.col("doc_name"), i, F.substring("content", 1, 50)).alias("id_v3"))


@query(f"""SELECT DISTINCT mention_id, substr(sha256(concat_ws('::', source_doc, entity_type, {_S('lower(name)')})), 1, 12) AS hashed_id FROM (SELECT DISTINCT mention_id, coalesce(source_doc, '') AS source_doc, coalesce(entity_type, '') AS entity_type, coalesce(name, '') AS name FROM entities)""")
def entity_ids(spark, root):
    e = table(spark, root, "entities").select("mention_id", "source_doc", "entity_type", "name").distinct()
    return e.select("mention_id", T.hash_id(12, F.col("source_doc"), F.col("entity_type"), T.strip(F.lower("name"))).alias("hashed_id"))


@query(f"""SELECT element_id, len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n_tokens FROM {ELEMENTS} WHERE content IS NOT NULL""")
def token_counts(spark, root):
    return elements(spark, root).where(F.col("content").isNotNull()).select("element_id", T.token_count(F.col("content")).alias("n_tokens"))


@query(f"""SELECT element_id, CASE WHEN len(t) > 64 THEN array_to_string(t[1:64], ' ') ELSE content END AS head FROM (SELECT element_id, content, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS t FROM {ELEMENTS} WHERE content IS NOT NULL)""")
def token_truncate(spark, root):
    return elements(spark, root).where(F.col("content").isNotNull()).select("element_id", T.truncate_tokens(F.col("content"), 64).alias("head"))


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(" + _S("content") + r", '([.!?؟])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + _S("s") + "), lambda s: length(s) > 0)"


@query(f"""SELECT element_id, unnest(s) AS sentence, unnest(range(len(s))) AS sent_no FROM (SELECT element_id, {_SPLIT} AS s FROM {ELEMENTS} WHERE element_type <> 'table')""")
def sentence_split(spark, root):
    e = elements(spark, root).where("element_type <> 'table'")
    return e.select("element_id", F.posexplode(T.sentences(F.col("content"))).alias("sent_no", "sentence"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\|+|\|+$', '', 'g'), '^\s+|\s+$', '', 'g')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(" + _CLEAN + r", '\*\*(.*?)\*\*', '\1', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
HEADERS = "(SELECT DISTINCT element_id, unnest(table_data.headers) AS header FROM elements WHERE table_data IS NOT NULL)"


@query(f"""SELECT DISTINCT header, {_CLEAN.format('header')} AS cleaned, concat(upper(substr({_S('header')}, 1, 1)), substr({_S('header')}, 2)) AS cased FROM {HEADERS} WHERE header IS NOT NULL""")
def clean_headers(spark, root):
    h = table(spark, root, "elements").where("table_data is not null").select(F.explode("table_data.headers").alias("header")).where("header is not null").distinct()
    return h.select("header", T.clean_header(F.col("header")).alias("cleaned"), T.sentence_case(F.col("header")).alias("cased"))


def _rows(spark, root):
    t = table(spark, root, "elements").where("table_data is not null").select("element_id", "content", "table_data").distinct()
    everything = F.concat_ws(" ", F.array_join(F.col("table_data.headers"), " "), F.array_join(F.flatten("table_data.rows"), " "))
    arabic = T.detect_script_language(everything) == "ar"
    return t.select("element_id", "content", F.transform("table_data.rows", lambda r: T.row_sentence(F.col("table_data.headers"), r, arabic)).alias("said"))


_ROW_SQL = f"""WITH t AS (SELECT DISTINCT element_id, content, table_data FROM elements WHERE table_data IS NOT NULL),
a AS (SELECT element_id, content, table_data.headers AS h, unnest(table_data."rows") AS r, unnest(range(len(table_data."rows"))) AS row_no,
  array_to_string(table_data.headers, ' ') || ' ' || array_to_string(flatten(table_data."rows"), ' ') AS everything FROM t),
b AS (SELECT *, (length(everything) - length(regexp_replace(everything, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}]', '', 'g'))) / length(everything)::double > 0.3 AS ar,
  list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'i': i, 'h': {_CLEAN.format('h[i]')}, 'v': {_S('r[i]')}}}), lambda p: length(p.h) > 0 AND length(p.v) > 0) AS p FROM a),
c AS (SELECT element_id, content, row_no, CASE WHEN len(h) = 0 OR len(h) <> len(r) OR len(p) = 0 THEN ''
  WHEN ar THEN array_to_string(list_transform(p, lambda x: x.h || ': ' || x.v), ' و ') || ' .'
  ELSE array_to_string(list_transform(p, lambda x: CASE WHEN x.i = 1 THEN x.h || ': ' || x.v ELSE 'has ' || lower(x.h) || ' ' || x.v END), ' and ') || '.' END AS s FROM b),
d AS (SELECT element_id, content, row_no, concat(upper(substr({_S('s')}, 1, 1)), substr({_S('s')}, 2)) AS sentence FROM c)
"""


@query(_ROW_SQL + "SELECT element_id, row_no, sentence FROM d")
def row_to_sentence(spark, root):
    return _rows(spark, root).select("element_id", F.posexplode("said").alias("row_no", "sentence"))


@query(_ROW_SQL + """SELECT t.element_id, coalesce(nullif(array_to_string(list(d.sentence ORDER BY d.row_no) FILTER (d.sentence <> ''), ' '), ''), t.content) AS said
 FROM (SELECT DISTINCT element_id, content FROM t) t LEFT JOIN d ON d.element_id = t.element_id GROUP BY t.element_id, t.content""")
def table_to_sentences(spark, root):
    text = F.array_join(F.filter("said", lambda s: s != ""), " ")
    return _rows(spark, root).select("element_id", F.coalesce(F.nullif(text, F.lit("")), "content").alias("said"))


@query("""SELECT DISTINCT chunk_id, '[' || concat_ws(' | ', doc_name, CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') END) || ']' AS prefix,
 CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE 'root' END AS section FROM chunks""")
def context_prefix(spark, root):
    c = table(spark, root, "chunks").select("chunk_id", "doc_name", "section_path").distinct()
    return c.select("chunk_id", T.context_prefix(F.col("doc_name"), F.col("section_path")).alias("prefix"), T.section_label(F.col("section_path")).alias("section"))


def _case(word: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {then}" for cond, then in rules) + f" ELSE {word} END"


def _stem_index_sql(w: str) -> str:
    rules = [(f"length({w}) <= 3", w)] + [(f"ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3", f"substr({w}, 1, length({w}) - {len(s)})" + (" || 'y'" if s == "ies" else "")) for s in T.SUFFIXES]
    return _case(w, rules)


def _stem_query_sql(w: str) -> str:
    cut = lambda k: f"substr({w}, 1, length({w}) - {k})"
    rules = [(f"ends_with({w}, 'ies') AND length({w}) > 4", cut(3) + " || 'y'"), (f"ends_with({w}, 'ing') AND length({w}) > 5", cut(3))]
    rules += [(f"ends_with({w}, '{s}') AND length({w}) > 5", cut(4)) for s in ("tion", "ment", "ness")]
    rules += [(f"ends_with({w}, '{s}') AND length({w}) > 4", cut(2)) for s in ("ed", "es")] + [(f"ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND length({w}) > 3", cut(1))]
    return _case(w, rules)


_WORDS = r"(SELECT DISTINCT unnest(regexp_extract_all(lower(content), '[a-z]+')) AS word FROM elements)"


def _words(spark, root):
    return table(spark, root, "elements").select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@query(f"SELECT word, {_stem_index_sql('word')} AS indexed, {_stem_query_sql('word')} AS sought FROM {_WORDS}")
def stems(spark, root):
    return _words(spark, root).select("word", T.stem_index(F.col("word")).alias("indexed"), T.stem_query(F.col("word")).alias("sought"))


@query(f"SELECT word, {_stem_index_sql('word')} AS indexed, {_stem_query_sql('word')} AS sought FROM {_WORDS} WHERE {_stem_index_sql('word')} <> {_stem_query_sql('word')}")
def stem_disagreement(spark, root):
    return stems(spark, root).where("indexed <> sought")


NAME = r"regexp_replace(lower(" + _S("name") + r"), '\s+', ' ', 'g')"
STEMS = f"list_sort(list_distinct(list_transform(list_filter(string_split({NAME}, ' '), lambda w: length(w) > 1), lambda w: {_stem_index_sql('w')})))"


@query(f"SELECT DISTINCT name, {STEMS} AS stems FROM entities WHERE name IS NOT NULL")
def name_stems(spark, root):
    return table(spark, root, "entities").where("name is not null").select("name").distinct().select("name", T.name_stems(F.col("name")).alias("stems"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_QUESTION = f"list_distinct(list_filter(regexp_split_to_array(lower({_S('question')}), '\\s+'), lambda w: length(w) > 0 AND NOT list_contains({_STOP}, w)))"


@query(f"SELECT query_id, unnest({_QUESTION}) AS keyword FROM (SELECT DISTINCT query_id, question FROM eval_queries)")
def query_keywords(spark, root):
    q = table(spark, root, "eval_queries").select("query_id", "question").distinct()
    return q.select("query_id", F.explode(T.query_words(F.col("question"))).alias("keyword"))


# What models answer, for functions that read such answers.
SCORES = ("1.5", "8", "10", "8/10", "0.85", "85", "8/100", "", "Score: 7 / 10.", "1", "0", "12/10", "grade 0.5 of 1", "3/1")


@query("SELECT answer, score::double AS score FROM (VALUES " + ", ".join(f"('{a}', {s})" for a, s in zip(SCORES, (1.0, 0.8, 1.0, 0.8, 0.85, 0.0, 0.8, 0.0, 0.7, 1.0, 0.0, 1.0, 0.5, 1.0))) + ") v(answer, score)")
def parse_score(spark, root):
    return spark.createDataFrame([(s,) for s in SCORES], "answer string").select("answer", T.parse_score(F.col("answer")).alias("score"))


ANSWERS = ("see [1] and [12]", "no source", "<b>x</b> & \"y\" [3]", "it's [a]")


@query("""SELECT answer, regexp_replace(replace(replace(replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '\\[(\\d+)\\]', '<a href="#cite-\\1">[\\1]</a>', 'g') AS html,
 regexp_matches(answer, '\\[\\d+\\]') AS cited FROM (VALUES """ + ", ".join("('" + a.replace("'", "''") + "')" for a in ANSWERS) + ") v(answer)")
def linkify(spark, root):
    return spark.createDataFrame([(s,) for s in ANSWERS], "answer string").select("answer", T.link_citations(F.col("answer")).alias("html"), T.has_citation(F.col("answer")).alias("cited"))


RESPONSES = ('{"entities":[{"name":"A","type":"role","value":1}],"relations":[]}', 'Sure:\n```json\n{"entities":[{"name":"B"}]}\n```', 'so {"entities":[{"name":"C","type":null}]} it is', "no json", "")


@query("SELECT * FROM (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, NULL), (4, NULL)) v(i, first_name)")
def json_extract(spark, root):
    r = spark.createDataFrame(list(enumerate(RESPONSES)), "i int, t string")
    got = T.extract_json(F.col("t"), "entities array<struct<name:string,type:string,value:string>>, relations array<struct<source:string,target:string,type:string>>")
    return r.select("i", F.try_element_at(got["entities"], F.lit(1))["name"].alias("first_name"))


@query("SELECT DISTINCT chunk_id, CASE access_level WHEN 1 THEN 'Public' WHEN 2 THEN 'Confidential' WHEN 3 THEN 'Restricted' ELSE 'Unknown' END AS badge FROM chunks")
def access_badges(spark, root):
    return table(spark, root, "chunks").select("chunk_id", T.access_badge(F.col("access_level")).alias("badge")).distinct()


@query("SELECT DISTINCT query_id, chunk_id, CASE WHEN final_score > 0.7 THEN 'high' WHEN final_score > 0.4 THEN 'medium' ELSE 'low' END AS badge, round(final_score, 4) AS final_score FROM retrieval_results")
def confidence_badges(spark, root):
    return table(spark, root, "retrieval_results").select("query_id", "chunk_id", T.confidence_badge(F.col("final_score")).alias("badge"), F.round("final_score", 4).alias("final_score")).distinct()


@query("SELECT DISTINCT source, lower(regexp_replace(regexp_replace(source, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents WHERE source IS NOT NULL")
def collection_slug(spark, root):
    return table(spark, root, "documents").where("source is not null").select("source").distinct().select("source", T.slug(F.col("source")).alias("slug"))
