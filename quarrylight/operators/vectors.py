"""Vector search: exact in blocks, and by an index of lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

#: vectors that are held as one matrix
ROWS = 2048


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector has no length, null where their sizes differ or one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def _packed(df: DataFrame, id_: str, vector: str, name: str, rows: int) -> DataFrame:
    """Rows (name, ids, vectors) of at most about ``rows`` vectors each: blocks of a hash of the id, never one large group."""
    n = max(1, df.count() // rows)
    one = df.select(F.col(id_).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)
    return one.groupBy(block).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vs"))


def top_k(queries: DataFrame, rows: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", block: int = ROWS) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows of each query, the query itself left out.

    Blocks of queries meet blocks of rows as matrices; of each meeting only k rows per query go on.  Scores are rounded
    to six places; ties go to the smaller id.  Vectors without length score 0; null ids and vectors take no part; a
    repeated id counts once.
    """
    q, r = _packed(queries, id_, vector, "q", block), _packed(rows, id_, vector, "r", block)
    kind = queries.schema[id_].dataType.simpleString()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                a, b = np.array([*t.q_vs], float).reshape(len(t.q_ids), -1), np.array([*t.r_vs], float).reshape(len(t.r_ids), -1)
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
                s = np.round(a @ b.T, 6) + 0.0
                ids = np.asarray(t.r_ids)
                s[np.asarray(t.q_ids)[:, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(s):
                    near = np.lexsort((ids, -row))[:k] if len(row) <= 4 * k else (c := np.flatnonzero(row >= np.partition(row, -k)[-k]))[np.lexsort((ids[c], -row[c]))[:k]]
                    near = near[row[near] > -np.inf]
                    yield pd.DataFrame({"query_id": [t.q_ids[i]] * len(near), "id": ids[near], "score": row[near]})

    found = q.crossJoin(r).mapInPandas(meet, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def all_scores(queries: DataFrame, rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", block: int = ROWS) -> DataFrame:
    """(query_id, id, score) of every row for each query, the query itself left out; blocks and rules as in ``top_k``."""
    q, r = _packed(queries, id_, vector, "q", block), _packed(rows, id_, vector, "r", block)
    kind = queries.schema[id_].dataType.simpleString()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                a, b = np.array([*t.q_vs], float).reshape(len(t.q_ids), -1), np.array([*t.r_vs], float).reshape(len(t.r_ids), -1)
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
                s = np.round(a @ b.T, 6) + 0.0
                ids = np.asarray(t.r_ids)
                for i, row in enumerate(s):
                    other = ids != t.q_ids[i]
                    yield pd.DataFrame({"query_id": [t.q_ids[i]] * int(other.sum()), "id": ids[other], "score": row[other]})

    return q.crossJoin(r).mapInPandas(meet, f"query_id {kind}, id {kind}, score double")


def fit_lists(rows: DataFrame, lists: int, vector: str = "embedding", sample: int = 20_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of a list index by k-means on at most ``sample`` rows, drawn by a hash of the vector."""
    got = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(sample).select(vector).collect()
    x = np.array([r[0] for r in got], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def approximate_top_k(queries: DataFrame, rows: DataFrame, k: int, lists: int = 16, probes: int = 12, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As ``top_k``, over the ``probes`` lists nearest to each query only; every row is in one list."""
    centres = fit_lists(rows, lists, vector)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def nearest(n: int):
        @F.pandas_udf("array<int>")
        def of(v: pd.Series) -> pd.Series:
            x = np.array([*v], float)
            return pd.Series(list(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

        return of

    clean = lambda d: d.select(F.col(id_).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    indexed = clean(rows).withColumn("list", nearest(1)("v")[0])
    # lists are cut into parts, so that no part is larger than a block whatever the list's size
    parts = max(1, rows.count() // (lists * ROWS) + 1)
    packed = indexed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("list", "part").agg(F.collect_list("id").alias("r_ids"), F.collect_list("v").alias("r_vs"))
    asked = clean(queries).withColumn("list", F.explode(nearest(probes)("v"))).groupBy("list", F.pmod(F.xxhash64("id"), F.lit(max(1, parts))).alias("q_part")).agg(F.collect_list("id").alias("q_ids"), F.collect_list("v").alias("q_vs"))
    kind = queries.schema[id_].dataType.simpleString()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                s = np.round(np.array([*t.q_vs], float) @ np.array([*t.r_vs], float).T, 6)
                ids = np.asarray(t.r_ids)
                for i, row in enumerate(s):
                    near = np.lexsort((ids, -row))[: k + 1]
                    near = near[ids[near] != t.q_ids[i]][:k]
                    yield pd.DataFrame({"query_id": [t.q_ids[i]] * len(near), "id": ids[near], "score": row[near]})

    found = asked.join(packed, "list").mapInPandas(meet, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hashed_features(df: DataFrame, key: str, content: str, dim: int = 64) -> DataFrame:
    """(key, bucket, weight): the non-zero entries of a unit vector of hashed token counts, rounded to six places."""
    token = df.select(key, F.explode(T.tokens(F.lower(content))).alias("t"))
    n = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("bigint")
    counts = token.groupBy(key, (n % dim).cast("int").alias("bucket")).agg(F.sum(F.when((n / dim).cast("bigint") % 2 == 0, 1).otherwise(-1)).alias("w")).where("w <> 0")
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def hashed_vectors(df: DataFrame, key: str, content: str, dim: int = 64) -> DataFrame:
    """(key, embedding): vectors of hashed token counts, not brought to unit length; texts without tokens have no row."""
    token = df.select(key, F.explode(T.tokens(F.lower(content))).alias("t"))
    n = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("bigint")
    counts = token.groupBy(key, (n % dim).cast("int").alias("b")).agg(F.sum(F.when((n / dim).cast("bigint") % 2 == 0, 1).otherwise(-1)).cast("double").alias("w"))
    m = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def semantic_breaks(sentences: DataFrame, keys: Sequence[str], order: str, content: str, quantile: float = 0.95) -> DataFrame:
    """(keys, order, distance, is_break): breaks where a sentence is further from the one before than the quantile of its group."""
    s = sentences.select(*keys, order, T.tokens(F.lower(content)).alias("t"))
    # counts of words as a map; the cosine needs only the words both have
    s = s.withColumn("next", F.col(order) + 1)
    bag = lambda t: F.map_from_entries(F.transform(F.array_distinct(t), lambda w: F.struct(w, F.size(F.filter(t, lambda x: x == w)))))
    s = s.withColumn("bag", bag(F.col("t"))).withColumn("norm", F.sqrt(F.aggregate(F.map_values("bag"), F.lit(0), lambda a, v: a + v * v).cast("double")))
    prev = s.select(*keys, F.col("next").alias(order), F.col("bag").alias("pbag"), F.col("norm").alias("pnorm"))
    dot = F.aggregate(F.map_entries("bag"), F.lit(0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at("pbag", e["key"]), F.lit(0)))
    d = s.join(prev, [*keys, order]).select(*keys, order, F.round(1 - dot / (F.col("norm") * F.col("pnorm")), 6).alias("distance"))
    limit = d.groupBy(*keys).agg(F.percentile("distance", quantile).alias("limit"))
    return d.join(limit, list(keys)).select(*keys, order, "distance", (F.col("distance") > F.round("limit", 6)).alias("is_break"))
