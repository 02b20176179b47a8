"""What is said to a model of a question's results, and how results of two modes are judged and reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

# What stands where there is nothing to say.
NO_ENTITIES, NO_PATHS, NO_EVIDENCE = "No entity connections found.", "No graph evidence paths available.", "No evidence retrieved."
#: code points of a content that a judge sees, and of all contents and of the answer together
JUDGED_CONTENT, JUDGED_CONTEXT, JUDGED_ANSWER = 500, 6000, 2000


def connected(links: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(chunk_id, n, entity, name): the first entities, by name, that each chunk mentions."""
    pairs = links.join(names.select("entity", F.lower("name").alias("name")), "entity").select("chunk_id", "entity", "name").distinct()
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("name", "entity"))).where(F.col("n") <= most)


def _lines(rows: DataFrame, order: Sequence[str], line: Column, name: str, between: str = "\n") -> DataFrame:
    """(query_id, name): lines of a question in order, joined; a question has few, as its results are bounded."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), between).alias(name))


def entity_blocks(top: DataFrame, matched: DataFrame, names: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, entities): the entities found in the question, then for each result the entities that its chunk mentions."""
    found = _lines(matched.join(names.select("entity", "name"), "entity"), ["name", "entity"], F.col("name"), "found", ", ")
    each = near.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("names"))
    said = F.concat(F.lit("  Chunk "), T.clip(F.col("chunk_id"), 8), F.lit("... connected to: "), F.col("names"))
    lines = _lines(top.join(each, "chunk_id"), ["rank"], said, "lines")
    both = top.select("query_id").distinct().join(found, "query_id", "left").join(lines, "query_id", "left")
    text = F.concat_ws("\n", F.concat(F.lit("Query entities detected: "), F.col("found")), "lines")
    return both.select("query_id", F.when(text == "", NO_ENTITIES).otherwise(text).alias("entities"))


def path_blocks(top: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, paths): the trails from each result's chunk to the entities that it mentions."""
    step = F.concat(F.lit("[chunk]"), F.col("chunk_id"), F.lit(" --mentions_entity--> [entity]"), F.col("entity"))
    each = near.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", step.alias("s")))), lambda x: x["s"]), " → ").alias("trail"))
    lines = _lines(top.join(each, "chunk_id"), ["rank"], F.concat(F.lit("  Path: "), F.col("trail")), "paths")
    return top.select("query_id").distinct().join(lines, "query_id", "left").select("query_id", F.coalesce("paths", F.lit(NO_PATHS)).alias("paths"))


def judged_evidence(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, judged): results as a judge sees them, contents cut."""
    c = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("section_path", T.clip(F.col("content"), JUDGED_CONTENT).alias("content")), "indexed_at").alias("c"))
    section = F.array_join(F.coalesce("c.section_path", F.array().cast("array<string>")), " > ")
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] ("), F.col("doc_name"), F.lit(" | "), section, F.lit(")\n"), F.coalesce("c.content", F.lit("")))
    return _lines(top.join(c, "chunk_id"), ["rank"], line, "judged", "\n\n").withColumn("judged", T.clip(F.col("judged"), JUDGED_CONTEXT))


def prompts(questions: DataFrame, gate: DataFrame, evidence: DataFrame, entities: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, prompt): the question, fenced, with what was found for it."""
    j = questions.select("query_id", "question").join(gate.select("query_id", "confidence", "sufficient"), "query_id").join(evidence, "query_id", "left").join(entities, "query_id", "left").join(paths, "query_id", "left")
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>\n"), c, F.lit(f"\n</{tag}>"))
    head = F.concat(F.lit("<USER_QUERY>"), F.coalesce("question", F.lit("")), F.lit("</USER_QUERY>"))
    state = F.concat(F.lit("Evidence Sufficiency: "), F.when(F.col("sufficient"), "SUFFICIENT").otherwise("INSUFFICIENT"), F.lit("\nConfidence Score: "), F.round(F.col("confidence").cast("decimal(18,4)"), 2).cast("string"))
    blocks = [part("EVIDENCE", F.coalesce("evidence", F.lit(NO_EVIDENCE))), part("ENTITIES", F.coalesce("entities", F.lit(NO_ENTITIES))), part("EVIDENCE_PATHS", F.coalesce("paths", F.lit(NO_PATHS)))]
    return j.select("query_id", F.concat_ws("\n\n", head, state, *blocks).alias("prompt"))


def _content_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.array(*[F.lit(w) for w in T.STOP_WORDS]))


def judge_proxies(answers: DataFrame) -> DataFrame:
    """(query_id, faithfulness, correctness, citation_accuracy, hallucination) without a model: shares of words.

    ``answers``: query_id, answer, judged, expected_answer.  Faithful is what share of the answer's words the evidence has;
    hallucinated is the rest; correct is what share of the expected answer's words the answer has (null if none is
    expected); citations count as exact as the answer is faithful, and 0 if there are none.  These stand in for a model's
    grades, which ``parse_score`` reads.
    """
    a, e, x = (_content_words(c) for c in (F.coalesce(T.clip(F.col("answer"), JUDGED_ANSWER), F.lit("")), F.coalesce("judged", F.lit("")), T.clip(F.col("expected_answer"), JUDGED_ANSWER)))
    w = answers.select("query_id", "answer", a.alias("a"), e.alias("e"), x.alias("x"))
    share = lambda part, whole: F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(whole)).otherwise(0.0)
    faithful = share(F.col("e"), F.col("a"))
    right = F.when(F.size("x") > 0, share(F.col("a"), F.col("x")))
    return w.select("query_id", F.round(faithful, 4).alias("faithfulness"), F.round(right, 4).alias("correctness"), F.when(F.coalesce(T.has_citation(F.col("answer")), F.lit(False)), F.round(faithful, 4)).otherwise(0.0).alias("citation_accuracy"), F.round(1 - faithful, 4).alias("hallucination"))


def mode_report(metrics: DataFrame, names: Sequence[str], by: str) -> DataFrame:
    """Means of each mode, over all and per group: what is not applicable is left out; the share of questions not answered."""
    means = [F.round(F.avg(n), 4).alias(f"avg_{n}") for n in names]
    return metrics.groupingSets([[F.col("mode")], [F.col("mode"), F.col(by)]], "mode", by).agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.avg(F.when(F.col("sufficient"), 0.0).otherwise(1.0)), 4).alias("abstention_rate"))


def mode_delta(report: DataFrame, names: Sequence[str], by: str, base: str = "vector_only", other: str = "hybrid") -> DataFrame:
    """(group, delta of each mean): how much the other mode's means exceed the base's; a missing mean counts 0."""
    per = report.where(F.col(by).isNotNull())
    a, b = per.where(F.col("mode") == base), per.where(F.col("mode") == other)
    a, b = a.select(by, *[F.col(f"avg_{n}").alias(f"a_{n}") for n in names]), b.select(by, *[F.col(f"avg_{n}").alias(f"b_{n}") for n in names])
    return a.join(b, by, "full_outer").select(by, *[F.round(F.coalesce(f"b_{n}", F.lit(0.0)) - F.coalesce(f"a_{n}", F.lit(0.0)), 4).alias(f"{n}_delta") for n in names])


def report_lines(report: DataFrame, names: Sequence[str], by: str) -> DataFrame:
    """(mode, group, line): one line of text per mean that is applicable."""
    label = lambda n: F.lit(n.replace("_", " ").capitalize().ljust(24))
    each = F.array(*[F.struct(F.lit(i).alias("i"), label(n).alias("label"), F.col(f"avg_{n}").alias("v")) for i, n in enumerate(names)])
    rows = report.select("mode", F.coalesce(by, F.lit("all")).alias("group"), F.explode(each).alias("m")).where("m.v is not null")
    return rows.select("mode", "group", F.col("m.i").alias("line_no"), F.concat("m.label", F.round(F.col("m.v").cast("decimal(18,4)"), 3).cast("string")).alias("line"))
