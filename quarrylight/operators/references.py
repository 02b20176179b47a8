"""References to records that do not exist, over composite keys with partial nulls.

A reference is a tuple of columns.  Its null mask says which of them are null.
References are grouped by mask, and each group is anti-joined to the target on
the columns that are not null in it.  ``match`` declares what a partly null
reference means, as in SQL:

* ``simple``: a reference with any null refers to nothing and is never an orphan;
* ``partial``: the non-null columns alone must be found in some target row;
* ``full``: a reference is either null throughout (no reference) or whole; a
  partly null one is an orphan.

Defined results
* a reference that is null in every column: no reference, in every mode;
* empty target: every reference is ``missing``; empty references: no row;
* repeated references with the same row key: one row (grouped before any join);
* repeated target rows: the earliest arrival counts, and the earliest deletion;
* a null time on either side: neither ``late`` nor ``deleted`` can be shown, the
  reference counts as met if the key exists;
* other columns of either side are not looked at, so clashing names do not matter;
* hot keys: targets are reduced to one row per key before the join (partial
  aggregation on the map side), and references are spread over ``salt`` parts
  against which the few target rows of hot keys alone are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: white space of any script, as Java's \s has only that of ASCII
_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def normal_key(col: Column, prefix: str = "entity::") -> Column:
    """A key without surrounding white space, prefix and letter case."""
    bare = F.lower(F.regexp_replace(col, rf"^{_SPACE}+|{_SPACE}+$", ""))
    return F.regexp_replace(bare, rf"^{prefix}{_SPACE}*", "") if prefix else bare


def resolve_references(
    refs: DataFrame,
    row_key: str,
    ref_cols: Sequence[str],
    ref_time: str,
    targets: DataFrame,
    target_cols: Sequence[str],
    arrived: str,
    deleted: str | None = None,
    match: str = "simple",
    salt: int = 16,
    hot_rows: int = 100_000,
) -> DataFrame:
    """(row_key, ref_time, state) of every reference; state is missing, deleted, late or ok.

    Key columns must be normalised by the caller (``normal_key``).  A key that more than ``hot_rows`` references
    share is spread over ``salt`` parts; this changes how work is divided, never the result.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match must be simple, partial or full, not {match!r}")
    if len(ref_cols) != len(target_cols) or not ref_cols:
        raise ValueError("as many reference columns as target columns are needed")
    n = len(ref_cols)
    keys = [f"_k{i}" for i in range(n)]
    r = (
        refs.select(F.col(row_key).alias("_row"), F.col(ref_time).alias("_at"), *[F.col(c).alias(k) for c, k in zip(ref_cols, keys)])
        .where(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys]))
        .groupBy("_row", *keys)
        .agg(F.min("_at").alias("_at"))
    )
    t = targets.select(*[F.col(c).alias(k) for c, k in zip(target_cols, keys)], F.col(arrived).alias("_arrived"), (F.col(deleted) if deleted else F.lit(None).cast("timestamp")).alias("_deleted"))
    out: list[DataFrame] = []
    for mask in product((True, False), repeat=n):
        present = [k for k, here in zip(keys, mask) if here]
        if not present:
            continue
        group = r
        for k, here in zip(keys, mask):
            group = group.where(F.col(k).isNotNull() if here else F.col(k).isNull())
        if len(present) < n:
            if match == "simple":
                out.append(group.select("_row", "_at", F.lit("ok").alias("state")))
                continue
            if match == "full":
                out.append(group.select("_row", "_at", F.lit("missing").alias("state")))
                continue
        one = t.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in present])).groupBy(*present).agg(F.min("_arrived").alias("_arrived"), F.min("_deleted").alias("_deleted"), F.lit(True).alias("_there"))
        hot = group.groupBy(*present).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*present, F.lit(True).alias("_hot"))
        group = group.join(hot, present, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(salt))).otherwise(F.lit(0)).cast("int")).drop("_hot")
        one = one.join(hot, present, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
        on = [*present, "_salt"]
        missing = group.join(one, on, "left_anti").select("_row", "_at", F.lit("missing").alias("state"))
        found = group.join(one, on, "inner").select(
            "_row",
            "_at",
            F.when(F.col("_deleted") <= F.col("_at"), "deleted").when(F.col("_arrived") > F.col("_at"), "late").otherwise("ok").alias("state"),
        )
        out += [missing, found]
    return reduce(DataFrame.unionAll, out).select(F.col("_row").alias(row_key), F.col("_at").alias(ref_time), "state")


def orphan_report(found: DataFrame, by: Sequence[str] = ("ref_table", "ref_field", "period", "state")) -> DataFrame:
    """Number of orphan references per table, field, period and state; partial counts are made before the shuffle."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
