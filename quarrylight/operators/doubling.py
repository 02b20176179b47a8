"""Greedy chains through a successor table, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import cut


def reach(succ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, piece_no): every i that is reached from 0 by following i -> j in the successor table (keys, i, j).

    The table is squared each round, so that k rounds follow 2^k steps of all groups at once; each round is written to
    the checkpoint folder.  A group without a row for 0 yields nothing; an i has one successor at most.
    """
    step = succ.select(*keys, "i", "j")
    reached = step.where("i = 0").select(*keys, "i", F.lit(0).alias("piece_no"))
    hop = 1
    while True:
        on = reached.join(step, [*keys, "i"]).select(*keys, F.col("j").alias("i"), (F.col("piece_no") + hop).alias("piece_no"))
        reached = cut(reached.unionAll(on))
        second = step.select(*keys, F.col("i").alias("j"), F.col("j").alias("k"))
        step = cut(step.join(second, [*keys, "j"]).select(*keys, "i", F.col("k").alias("j")))
        if step.isEmpty():
            return reached
        hop *= 2
