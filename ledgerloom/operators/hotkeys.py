"""Per-key results where a few keys hold most of the rows.

``key_middle`` finds, for each key, the value at a rank among the key's distinct values.  It never sorts
or gathers the values of a key: it counts them in histograms over prefixes of their bytes, keeps the one bucket
that holds the rank, and refines that bucket until the rank is resolved.  Histograms are grouped by
(key, bucket) with partial counts on the map side, so a key with a third of all rows costs each task
only its share; and a round adds WIDTH bytes to a prefix, so a key has at most 256 ** WIDTH buckets and as
many again of values that end there, however many values it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.spool import Spool


#: Bytes by which a round refines a bucket.
WIDTH = 2


def common_bytes(a: Column, b: Column) -> Column:
    """Bytes that two different binary values have in common at their start."""
    x, y = F.hex(a), F.hex(b)
    spots = F.filter(F.sequence(F.lit(1), F.least(F.length(x), F.length(y))), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    short = F.least(F.length(x), F.length(y))
    return F.floor(F.when(short < 1, F.lit(0)).when(F.size(spots) > 0, spots[0] - 1).otherwise(short) / 2).cast("int")


def key_middle(spark: SparkSession, df: DataFrame, key: str, value: str, width: int = WIDTH) -> DataFrame:
    """(key, n_rows, n_values, middle): rows, distinct non-null values, and the lower middle value of each key.

    ``middle`` is the value at position (n_values + 1) / 2, rounded down, of the distinct non-null values
    in byte order, and null where a key has none.  Rows with a null key give no result; an empty string is
    a key like any other.  Ties cannot arise, since only distinct values are ranked.  An empty table gives
    no rows.  ``width`` is the number of bytes by which a round refines a bucket.
    """
    spool = Spool(spark, "key_middle")
    pairs = spool.save(
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k"), F.col(value).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    totals = spool.save(
        pairs.groupBy("k").agg(
            F.sum("n").alias("n_rows"),
            F.count("v").alias("n_values"),
        )
    )
    ranks = totals.filter("n_values > 0").select("k", ((F.col("n_values") + 1) / 2).cast("long").alias("rank"))
    # The first look needs no join: every value counts, and buckets are the first few bytes.
    looked = pairs.filter(F.col("v").isNotNull()).select("k", F.col("v").cast("binary").alias("v"))
    looked = looked.select("k", "v", F.substring("v", 1, width).alias("b"))
    found: list[DataFrame] = []
    previous: list[DataFrame] = []
    while True:
        hist = looked.groupBy("k", "b").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        run = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        chosen = spool.save(
            hist.withColumn("upto", F.sum("c").over(run))
            .join(ranks, "k")
            .filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
            .select("k", "c", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi")
        )
        # The first and the last value of a bucket are known without a further look.
        edge = (F.col("rank") == 1) | (F.col("rank") == F.col("c"))
        found.append(chosen.filter(edge).select("k", F.when(F.col("rank") == 1, F.col("lo")).otherwise(F.col("hi")).cast("string").alias("middle")))
        # A bucket is refined beyond what all its values share.
        left = chosen.filter(~edge).select(
            "k", "rank", "lo", "hi", (common_bytes(F.col("lo"), F.col("hi")) + width).alias("cut")
        )
        if left.isEmpty():
            break
        looked = spool.save(
            looked.join(left, "k")
            .filter(F.col("v").between(F.col("lo"), F.col("hi")))
            .select("k", "v", F.substring(F.col("v"), F.lit(1), F.col("cut")).alias("b"))
        )
        ranks = left.select("k", "rank")
        spool.drop(*previous)
        previous = [looked]
    middle = found[0]
    for more in found[1:]:
        middle = middle.unionByName(more)
    return totals.join(middle, "k", "left").select(F.col("k").alias(key), "n_rows", "n_values", "middle")
