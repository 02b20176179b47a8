"""Similarity joins of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T


def similar_sets(sets: DataFrame, id_: str, items: str, threshold: float) -> DataFrame:
    """(a, b, score): the pairs of different sets, a < b, whose Jaccard score reaches the threshold.

    Prefix filter: two such sets share one of their rarest items, of which only the first size - ceil(threshold * size)
    + 1 of each set need to be joined; the rest is compared once per pair.  Null and empty sets are like nothing; equal
    sets should be made one before, as they would all be paired; repeated ids and items count once.
    """
    n = sets.select(F.col(id_).alias("a"), F.array_distinct(F.array_compact(items)).alias("s")).where("a is not null and size(s) > 0").groupBy("a").agg(F.min("s").alias("s"))
    each = n.select("a", "s", F.explode("s").alias("x"))
    rarity = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(rarity, "x").groupBy("a", "s").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("o"))
    keep = F.size("s") - F.ceil(F.size("s") * threshold) + 1
    prefix = ranked.select("a", "s", F.explode(F.transform(F.slice("o", F.lit(1), keep.cast("int")), lambda y: y["x"])).alias("x"))
    left, right = prefix.toDF("a", "s_a", "x"), prefix.toDF("b", "s_b", "x")
    size_ok = (F.size("s_a") >= F.size("s_b") * threshold) & (F.size("s_b") >= F.size("s_a") * threshold)
    return left.join(right, "x").where((F.col("a") < F.col("b")) & size_ok).select("a", "b", T.jaccard(F.col("s_a"), F.col("s_b")).alias("score")).where(F.col("score") >= threshold).distinct()
