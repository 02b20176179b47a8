"""Rows of a store: merging by key, uniqueness, export of a bounded part of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.graph import STRUCTURAL


def merged_rows(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows with the new ones in the place of those with the same key; of equal new keys one stays."""
    fresh = new.dropDuplicates(list(keys))
    return stored.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that more than one row has; a store that takes each once has none."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collection_name(collection: Column, model: Column) -> Column:
    return F.concat(collection, F.lit("__"), T.slug(model))


def embedding_log(vectors: DataFrame, content: str, vector: str) -> DataFrame:
    """(text_hash, dim, vector_json): one entry per text and vector, for a log of what was embedded."""
    return vectors.select(F.substring(F.sha2(content, 256), 1, 12).alias("text_hash"), F.size(vector).alias("dim"), F.to_json(vector).alias("vector_json"))


def graph_export(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes of some kinds with labels, the first by id, and the edges between them; edges that hold documents together have no label."""
    label = (
        F.when(F.col("node_type") == "entity", T.clip(F.coalesce("name", "id"), 40)).when(F.col("node_type") == "document", T.clip(F.coalesce("name", "id"), 25))
        .when(F.col("node_type") == "chunk", T.clip(F.coalesce("doc_name", F.lit("?")), 18)).otherwise(T.clip(F.coalesce("name", "id"), 30))
    )
    kept = nodes.where(F.col("node_type").isin(*kinds)).orderBy("id").limit(most).select("id", "node_type", label.alias("label"))
    ends = kept.select("id")
    inner = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    held = F.col("relation_type").isin(*STRUCTURAL)
    return kept, inner.select("src", "dst", F.when(held, "").otherwise(F.col("relation_type")).alias("label"), F.when(held, 1).otherwise(2).alias("width"))
