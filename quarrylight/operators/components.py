"""Connected components over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the smallest node that can be reached.

    Nodes hop to the least neighbour's label and, each round, to their label's label (pointer jumping), so that rounds
    grow with the logarithm of the longest path.  Each round's labels are written to the checkpoint folder; nothing but
    one count of changed labels comes to the driver.  Null ends and loops are ignored; empty edges give no row; ties
    cannot occur, as labels are node ids.  Raises if ``max_rounds`` do not suffice.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = cut(both.where("x <> y").unionAll(both.where("x <> y").select("y", "x")).distinct())
    labels = cut(edges.select(F.explode(F.array(F.col(a), F.col(b))).alias("node")).where("node is not null").distinct().join(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")), "node", "left").select("node", F.least("node", F.coalesce("m", "node")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = hop.join(labels.select(F.col("node").alias("label"), F.col("label").alias("beyond")), "label", "left")
        nxt = cut(jump.select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels = nxt.select("node", "label")
        if nxt.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
