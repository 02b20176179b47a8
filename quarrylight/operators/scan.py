"""Running values within groups of any size.

A window over one large group is one task.  These operators cut each group into ordered blocks, compute within blocks,
carry block results forward over the few block rows, and join them back; a group is as many tasks as it has blocks.
Blocks come from ranges of the order column; rows with a null order come first.
Equal order values are told apart by the tie columns.  Empty input gives no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import cut

#: order values per block
BLOCK = 65_536


def with_block(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """Adds the block of each row: by value ranges for whole numbers, for other types by ranges that the rows fill evenly."""
    if df.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn("_block", F.coalesce(F.floor(F.col(order) / size), F.lit(-(1 << 40))))
    return df.repartitionByRange(*keys, order, *ties).withColumn("_block", F.spark_partition_id())


def scan(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, Column]], size: int = BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """Adds running values, all in one pass: {name: (kind, value)}.

    Kinds: 'sum' and 'min' over the rows up to each row, itself included; 'last', the last value that is not null up to
    each row, itself included; 'before', the same without the row itself.  The input is read twice, so what leads to it
    is written to the checkpoint folder first: give it narrow rows, and join texts to the result.
    """
    d = cut(with_block(df, keys, order, ties, size).withColumns({f"_v_{n}": v for n, (_, v) in values.items()}))
    by = F.struct(order, *ties)
    fold = {"sum": lambda n: F.sum(f"_v_{n}"), "min": lambda n: F.min(f"_v_{n}")}
    parts = d.groupBy(*keys, "_block").agg(*[(fold[k](n) if k in fold else F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), by))).alias(f"_b_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": lambda n: F.sum(f"_b_{n}"), "min": lambda n: F.min(f"_b_{n}")}
    before = parts.select(*keys, "_block", *[(carry[k](n) if k in carry else F.last(f"_b_{n}", ignorenulls=True)).over(earlier).alias(f"_c_{n}") for n, (k, _) in values.items()])
    here = Window.partitionBy(*keys, "_block").orderBy(order, *ties)
    upto, past = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    inside = {}
    for n, (k, _) in values.items():
        v, c = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        if k == "sum":
            inside[n] = F.sum(v).over(upto) + F.coalesce(c, F.lit(0))
        elif k == "min":
            inside[n] = F.least(F.min(v).over(upto), c)
        else:
            inside[n] = F.coalesce(F.last(v, ignorenulls=True).over(upto if k == "last" else past), c)
    joined = d.join(before, [*keys, "_block"])
    return joined.withColumns(inside).drop("_block", *[f"_{x}_{n}" for n in values for x in "vc"])


def offsets(groups: DataFrame, name: str, size: str) -> DataFrame:
    """(name, offset) of each group, one row each: how many rows the groups before it have, in the order of names.

    Groups are cut into ranges of names, one task each; the driver sees the total of each range.  Null names come first.
    """
    g = cut(groups.select(name, F.col(size).cast("bigint").alias("_n")).repartitionByRange(name).sortWithinPartitions(name).withColumn("_part", F.spark_partition_id()))
    totals = sorted((r["_part"], r["t"]) for r in g.groupBy("_part").agg(F.sum("_n").alias("t")).collect())
    shift, sums = 0, []
    for part, total in totals:
        sums += [F.lit(part), F.lit(shift).cast("bigint")]
        shift += total
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
    base = F.create_map(*sums)[F.col("_part")] if sums else F.lit(0).cast("bigint")
    return g.select(name, (F.coalesce(upto, F.lit(0)) + base).alias("offset"))


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, size: int = BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 within each group, in the order of one column."""
    return scan(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, size, ties)
