"""Entities and relations from the answers of a model, or by rules without one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

ANSWER = "entities array<struct<name:string,type:string,value:string>>, relations array<struct<source:string,target:string,type:string>>"
# What stands for a type that an answer does not give.
UNKNOWN_ENTITY, UNKNOWN_RELATION = "unknown", "related_to"
#: shares and sums of money, as the rules find them
RULES = (("percentage", r"\d+(?:\.\d+)?%"), ("limit", r"(?:EUR|USD|GBP|EGP) \d[\d,]*(?:\.\d+)?"))


def ask(chunks: DataFrame, prompt: str, provider: Callable[[str], str], attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """(chunk_id, doc_name, response, error): what a provider says to each prompt; after the last failed attempt no response.

    The provider is sent to the workers once; each failure waits twice as long as the one before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said, errors = [], []
            for p in pdf["p"]:
                answer, error = None, None
                for k in range(attempts):
                    try:
                        answer, error = provider(p), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts:
                            time.sleep(wait * 2**k)
                said.append(answer)
                errors.append(error)
            yield pdf[["chunk_id", "doc_name"]].assign(response=said, error=errors)

    return chunks.select("chunk_id", "doc_name", F.col(prompt).alias("p")).mapInPandas(run, "chunk_id string, doc_name string, response string, error string")


def by_rules(content: Column) -> Column:
    """An answer in the form of a model's, with the shares and sums that rules find in a text."""
    def typed(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(0))), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), n.alias("value")))

    return F.to_json(F.struct(F.concat(*[typed(k, p) for k, p in RULES]).alias("entities")))


def parsed(responses: DataFrame) -> DataFrame:
    """(chunk_id, doc_name, ok, entities, relations); ok is false where an answer holds no JSON object."""
    good = T.json_text(F.col("response"))
    a = responses.select("chunk_id", "doc_name", good.isNotNull().alias("ok"), F.from_json(F.coalesce(good, F.lit("{}")), ANSWER).alias("a"))
    return a.select("chunk_id", "doc_name", "ok", "a.entities", "a.relations")


def failed(answers: DataFrame) -> DataFrame:
    return answers.where("not ok").select("chunk_id")


def entities_of(answers: DataFrame) -> DataFrame:
    """(chunk_id, n, entity_id, name, entity_type, value, source_doc, mentions) of named entities, n their place in the answer.

    A type that is null or empty is unknown; a value that is empty, 0 or false is none.
    """
    e = answers.select("chunk_id", "doc_name", F.posexplode("entities").alias("n", "x"))
    name, kind = T.strip(F.col("x.name")), T.strip(F.coalesce(F.nullif("x.type", F.lit("")), F.lit(UNKNOWN_ENTITY)))
    value = F.when(~F.col("x.value").isin("", "0", "false"), F.col("x.value"))
    e = e.select("chunk_id", "n", name.alias("name"), kind.alias("entity_type"), value.alias("value"), F.col("doc_name").alias("source_doc")).where(F.length("name") > 0)
    return e.select("chunk_id", "n", T.hash_id(12, F.col("source_doc"), F.col("entity_type"), T.strip(F.lower("name"))).alias("entity_id"), "name", "entity_type", "value", "source_doc", F.array("name").alias("mentions"))


def relations_of(answers: DataFrame) -> DataFrame:
    """(chunk_id, n, source_id, target_id, relation_type) of relations both of whose ends are entities of the same answer.

    Ends are named exactly; of entities with one name the last counts.
    """
    ids = entities_of(answers).groupBy("chunk_id", "name").agg(F.max_by("entity_id", "n").alias("id"))
    r = answers.select("chunk_id", F.posexplode("relations").alias("n", "x")).where("x is not null")
    kind = T.strip(F.coalesce(F.nullif("x.type", F.lit("")), F.lit(UNKNOWN_RELATION)))
    r = r.select("chunk_id", "n", T.strip(F.col("x.source")).alias("s"), T.strip(F.col("x.target")).alias("t"), kind.alias("relation_type"))
    r = r.join(ids.toDF("chunk_id", "s", "source_id"), ["chunk_id", "s"]).join(ids.toDF("chunk_id", "t", "target_id"), ["chunk_id", "t"])
    return r.select("chunk_id", "n", "source_id", "target_id", "relation_type")
