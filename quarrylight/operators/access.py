"""Access levels of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: level of a document that nothing is said of, the strictest
UNMAPPED = 3


def access_levels(rows: DataFrame, access: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Rows with ``level``: of several levels of a document the strictest, of none the strictest of all."""
    levels = access.where(F.col("doc_name").isNotNull()).groupBy("doc_name").agg(F.max("level").alias("level")).withColumnRenamed("doc_name", doc)
    return rows.drop("level").join(levels, doc, "left").withColumn("level", F.coalesce("level", F.lit(UNMAPPED)))


def allowed(rows: DataFrame, access: DataFrame, user_level: int | None, doc: str = "doc_name") -> DataFrame:
    """The rows of documents that a user may see; no level means no restriction."""
    got = access_levels(rows, access, doc)
    return got if user_level is None else got.where(F.col("level") <= user_level)
