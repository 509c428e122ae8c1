"""Problem 1: one group identifier for records linked by scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import boruvka


def group_pairs(spark: SparkSession, pairs: DataFrame, left: str, right: str, weight: str, floor: float) -> DataFrame:
    """(unique_id, group_id) for every non-null id on either side of any pair.

    Two ids are linked if a row with both, in either order, weighs ``floor`` or more; null and NaN weights
    link nothing, nor does an id paired with itself or with null.  An id without links is its own group.
    Groups follow links through any number of others and are named by their smallest id.
    """
    strong = pairs.filter(~F.isnan(weight) & (F.col(weight) >= floor))
    groups = boruvka(spark, strong.select(F.col(left).alias("u"), F.col(right).alias("v")))
    ids = pairs.select(F.explode(F.array(left, right)).alias("id")).filter("id is not null").distinct()
    return ids.join(groups, "id", "left").select(F.col("id").alias("unique_id"), F.coalesce("group_id", "id").alias("group_id"))
