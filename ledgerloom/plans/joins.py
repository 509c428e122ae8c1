"""Join shapes that Catalyst does not rewrite by itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_pair(df: DataFrame, left: str, right: str) -> DataFrame:
    """``df`` with the smaller of two keys in ``left``: lookups in either order become one equi-join."""
    return df.withColumns({left: F.least(left, right), right: F.greatest(left, right)})


def disjunctive_self_join(df: DataFrame, key: str, blocks: list[str], carry: list[str] | None = None) -> DataFrame:
    """Pairs (key_l, key_r, rule) of rows that agree in any block column, each once, by the first rule that yields it.

    A join on ``a OR b`` would be a Cartesian product; this is a union of equi-joins, each leaving out what an
    earlier one found.  Null blocks match nothing.  ``carry`` columns come along from both sides.
    """
    carry = carry or []
    side = lambda s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys([key, *blocks, *carry])])
    parts = []
    for i, b in enumerate(blocks):
        left, right = side("l"), side("r")
        earlier = [F.coalesce(F.col(f"{e}_l") == F.col(f"{e}_r"), F.lit(False)) for e in blocks[:i]]
        on = [F.col(f"{b}_l") == F.col(f"{b}_r"), F.col(f"{key}_l") < F.col(f"{key}_r"), *[~e for e in earlier]]
        kept = [f"{c}_{s}" for c in dict.fromkeys([key, *carry]) for s in ("l", "r")]
        parts.append(left.join(right, reduce(Column.__and__, on)).select(*kept, F.lit(b).alias("rule")))
    return reduce(DataFrame.unionByName, parts)


def anti_pairs(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs of ``df`` that ``other`` holds in neither order."""
    seen = canonical_pair(other.select(left, right), left, right).distinct()
    return canonical_pair(df, left, right).join(seen, [left, right], "left_anti")


def udf_on_distinct(df: DataFrame, columns: list[str], function: Callable[..., Column], name: str, where: Column | None = None) -> DataFrame:
    """``df`` with ``function`` of the columns, run once for each distinct combination that ``where`` admits."""
    wanted = df.filter(where) if where is not None else df
    # Strings are small and their comparison is not: spread them by number, which AQE leaves as it is.
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = wanted.select(*columns).distinct().repartition(tasks).withColumn(name, function(*[F.col(c) for c in columns]))
    values = values.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], name)
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)])
    return df.join(values, on, "left").drop(*[f"_k{i}" for i in range(len(columns))])


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, once its key is known to be unique; else an error that names an offender."""
    twice = df.groupBy(*keys).count().filter("count > 1").orderBy(*keys).take(1)
    if twice:
        raise ValueError(f"key {keys} is not unique, e.g. {twice[0].asDict()}")
    return df


def block_sizes(df: DataFrame, block: str) -> DataFrame:
    """One row (rows, blocks, pairs, largest): what a block column would cost, without joining."""
    sizes = df.filter(F.col(block).isNotNull()).groupBy(block).agg(F.count("*").alias("c"))
    return sizes.agg(
        F.sum("c").alias("n_rows"),
        F.count("*").alias("n_blocks"),
        F.coalesce(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")), F.lit(0)).alias("n_pairs"),
        F.max("c").alias("largest"),
    )
