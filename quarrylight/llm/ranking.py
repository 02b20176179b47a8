"""One ranking from several scores on unlike scales.

Method: per query and score, the empirical percentile with averaged ties,
rank / (n + 1) over the rows that have the score, is mapped through the inverse
normal distribution; a row's rank is by the weighted mean of what it has.

Defined results
* a null or NaN score says nothing: the mean is over the other scores;
* a score that is equal for all rows of a query says nothing, for any of them;
* a row of which no score says anything comes last, ties by item;
* equal means (to nine decimals): more scores first, then the smaller item;
* repeated (query, item) rows count once, each score by its greatest value;
* rows without query or item have no place in a ranking and are left out;
* infinite scores are the largest or smallest and rank so;
* empty input: no row.  Other columns are not looked at.

Scale: the scores of a query stand side by side, so that one partitioning by query serves all windows.  A query with
more than ``hot_rows`` rows never becomes one task: its values are counted, cut by the leading bits of an
order-preserving image of the double into buckets, ranked inside buckets, and shifted by the buckets' running totals;
its final ranks are numbered by ranges, or, with ``top_k``, among the best of each part.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.scan import numbered

# P. J. Acklam's published rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x: str, terms: tuple[float, ...], tail: str = "") -> str:
    out = repr(terms[0])
    for t in terms[1:]:
        out = f"({out} * {x} + {t!r})"
    return f"({out} * {x} + 1.0)" if tail else out


def inverse_normal_sql(p: str) -> str:
    """The inverse normal distribution of the expression p as SQL that Spark and others read alike."""
    q, r, low, high = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return (
        f"CASE WHEN {p} < {_LOW} THEN {_poly(low, _C)} / {_poly(low, _D, '1')} "
        f"WHEN {p} > {1 - _LOW} THEN -({_poly(high, _C)} / {_poly(high, _D, '1')}) "
        f"ELSE {_poly(r, _A)} * {q} / {_poly(r, _B, '1')} END"
    )


def _ordered_bits(x: Column) -> Column:
    """A bigint that orders as the double does (both zeros are one value)."""
    scaled = F.when(x == 0, F.lit(0.0)).otherwise(x)
    exponent = F.floor(F.log2(F.abs(scaled)))
    mantissa = F.abs(scaled) / F.pow(F.lit(2.0), exponent) - 1.0
    image = (exponent + 1100) * F.lit(65536.0) + F.floor(mantissa * 65536.0) + 1
    return F.when(scaled == 0, F.lit(0)).when(F.abs(scaled) == float("inf"), F.signum(scaled) * F.lit(2.0**40)).otherwise(F.signum(scaled) * image).cast("bigint")


def hot_scores(long: DataFrame) -> DataFrame:
    """(q, item, kind, score) -> the same with z, the normal score, null where the score is constant in its query.

    Values are counted and cut into buckets; nothing of a query is in one task but its buckets' totals.
    """
    group = Window.partitionBy("q", "kind")
    sizes = long.groupBy("q", "kind").agg(F.count(F.lit(1)).alias("n"))
    counts = long.groupBy("q", "kind", "score").agg(F.count(F.lit(1)).alias("ties")).withColumn("bucket", _ordered_bits(F.col("score")))
    before = counts.groupBy("q", "kind", "bucket").agg(F.sum("ties").alias("total"))
    before = before.select("q", "kind", "bucket", (F.sum("total").over(group.orderBy("bucket")) - F.col("total")).alias("shift"))
    inside = F.sum("ties").over(Window.partitionBy("q", "kind", "bucket").orderBy("score"))
    values = counts.withColumn("upto", inside).join(before, ["q", "kind", "bucket"]).join(sizes, ["q", "kind"])
    first = F.col("shift") + F.col("upto") - F.col("ties") + 1
    p = "((first + (ties - 1) / 2.0D) / (n + 1.0D))"
    values = values.withColumn("first", first).select("q", "kind", "score", F.when(F.col("ties") < F.col("n"), F.expr(inverse_normal_sql(p))).alias("z"))
    # a value that many rows share is joined from a table of single values, which adaptive execution splits or broadcasts
    return long.join(values, ["q", "kind", "score"]).select("q", "item", "kind", "z")


def joint_ranking(df: DataFrame, query: str, item: str, weights: Mapping[str, float], top_k: int | None = None, hot_rows: int = 1_000_000) -> DataFrame:
    """(query, item, joint_score, n_scores, joint_rank); only ranks up to top_k where it is given."""
    kinds = list(weights)
    names = [f"s{i}" for i in range(len(kinds))]
    number = lambda c: F.col(c).cast("double")
    clean = {c: F.when(~F.isnan(number(c)), F.when(number(c) == 0, F.lit(0.0)).otherwise(number(c))) for c in kinds}
    base = (
        df.select(F.col(query).alias("q"), F.col(item).alias("item"), *[clean[c].alias(n) for n, c in zip(names, kinds)])
        .where(F.col("q").isNotNull() & F.col("item").isNotNull())
        .groupBy("q", "item")
        .agg(*[F.max(n).alias(n) for n in names])
    )
    hot = base.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("q")
    listed = [float(w) for w in weights.values()]

    # other queries: all scores side by side, one partitioning by query for every window
    cold, whole, zs = base.join(hot, "q", "left_anti"), Window.partitionBy("q"), []
    for i, n in enumerate(names):
        by = whole.orderBy(F.col(n).asc_nulls_last())
        cold = cold.withColumns({f"f{i}": F.rank().over(by), f"t{i}": F.count(F.lit(1)).over(by.rangeBetween(0, 0)), f"n{i}": F.count(n).over(whole)})
        p = f"((f{i} + (t{i} - 1) / 2.0D) / (n{i} + 1.0D))"
        zs.append(F.when(F.col(n).isNotNull() & (F.col(f"t{i}") < F.col(f"n{i}")), F.expr(inverse_normal_sql(p))))
    cold = cold.select("q", "item", *[z.alias(f"z{i}") for i, z in enumerate(zs)])
    has = [F.col(f"z{i}").isNotNull() for i in range(len(kinds))]
    total = reduce(add, [F.when(h, w).otherwise(0.0) for h, w in zip(has, listed)])
    score = reduce(add, [F.when(h, F.col(f"z{i}") * w).otherwise(0.0) for i, (h, w) in enumerate(zip(has, listed))])
    order = (F.col("mean").desc_nulls_last(), F.col("n_scores").desc(), F.col("item"))
    numbered_ = F.row_number().over(whole.orderBy(*order))
    cold = cold.select("q", "item", F.round(F.when(total > 0, score / total), 9).alias("mean"), reduce(add, [h.cast("int") for h in has]).alias("n_scores")).withColumn("joint_rank", numbered_)

    big = base.join(hot, "q", "left_semi")
    scores = F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(n).alias("score")) for i, n in enumerate(names)]), lambda s: s["score"].isNotNull())
    long = big.select("q", "item", F.explode(scores).alias("s")).select("q", "item", "s.kind", "s.score")
    weight = F.element_at(F.array(*[F.lit(w) for w in listed]), F.col("kind") + 1)
    means = hot_scores(long).where(F.col("z").isNotNull()).groupBy("q", "item").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).cast("int").alias("n_scores"))
    # rows of which no score says anything are joined back, so that they come last
    big = big.select("q", "item").join(means, ["q", "item"], "left").withColumn("mean", F.round("mean", 9)).withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
    if top_k is None:
        # ranks by ranges of the order, so that no query is one task
        places = F.struct(F.col("mean").isNull().alias("a"), (-F.col("mean")).alias("b"), (-F.col("n_scores")).alias("c"), F.col("item").alias("d"))
        big = numbered(big.withColumn("_o", places), ["q"], "_o", "joint_rank").withColumn("joint_rank", F.col("joint_rank").cast("int")).select("q", "item", "mean", "n_scores", "joint_rank")
    else:
        # the best of each part are taken before anything of a query comes together
        big = big.withColumn("joint_rank", numbered_)
    ranked = cold.unionByName(big)
    if top_k is not None:
        ranked = cold.where(F.col("joint_rank") <= top_k).unionByName(big.where(F.col("joint_rank") <= top_k))
    return ranked.select(F.col("q").alias(query), F.col("item").alias(item), F.col("mean").alias("joint_score"), "n_scores", "joint_rank")
