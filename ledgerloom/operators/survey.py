"""Sampling by ordered digests, grouped splits, blind queues, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import rank_digest


def stratum_sizes(cases: DataFrame, stratum: str, vocabulary: list[str]) -> DataFrame:
    """Every stratum of the vocabulary with its cases, those without any included."""
    spark = cases.sparkSession
    known = spark.createDataFrame([(v,) for v in vocabulary], f"{stratum} string")
    return F.broadcast(known).join(cases.groupBy(stratum).agg(F.count("*").alias("pop_h")), stratum, "left").na.fill(0, ["pop_h"])


def stratified_draw(cases: DataFrame, key: str, stratum: str, wanted: dict[str, int], purpose: str, exclude: DataFrame | None = None) -> DataFrame:
    """A fixed number of cases of each stratum in the order of their digests, with sizes and inclusion probability.

    ``exclude`` holds keys out of the pool while they still count in the population.  A stratum with fewer
    cases than wanted is an error.  Only the cases drawn are ordered over the whole: a stratum's digests are
    first cut at the ``n``-th smallest of each partition.
    """
    sizes = cases.groupBy(stratum).agg(F.count("*").alias("pop_h"))
    pool = cases.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else cases
    pools = pool.groupBy(stratum).agg(F.count("*").alias("pool_h"))
    quota = F.create_map(*[x for s, n in sorted(wanted.items()) for x in (F.lit(s), F.lit(n))])
    short = [r[stratum] for r in pools.filter(F.col("pool_h") < quota[F.col(stratum)]).collect()]
    if short:
        raise ValueError(f"strata with too few cases: {short}")
    ranked = pool.withColumn("digest", rank_digest(purpose, F.col(key)))
    # A first cut without ordering a whole stratum in one task: ranks within salted parts bound the final rank.
    part = Window.partitionBy(stratum, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("digest", key)
    near = ranked.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= quota[F.col(stratum)]).drop("_r")
    drawn = near.withColumn("draw_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("digest", key)).cast("long"))
    drawn = drawn.filter(F.col("draw_rank") <= quota[F.col(stratum)]).join(sizes, stratum).join(pools, stratum)
    return drawn.select(key, F.col(stratum), "pop_h", "pool_h", quota[F.col(stratum)].cast("long").alias("n_h"), (quota[F.col(stratum)] / F.col("pool_h")).alias("inclusion_probability"), "draw_rank")


def allocate(population: dict[str, int], total: int, floor: int = 0) -> dict[str, int]:
    """Cases of each cell: equal shares, capped by the population, the rest redistributed, each at least ``floor``.

    Runs on the driver over the few cells of a design.  What cannot be placed is an error.
    """
    if total > sum(population.values()):
        raise ValueError("more cases wanted than there are")
    out = dict.fromkeys(sorted(population), 0)
    left = total
    while left:
        free = [c for c in out if out[c] < population[c]]
        share, extra = divmod(left, len(free))
        for i, c in enumerate(free):
            step = min(share + (i < extra), population[c] - out[c])
            out[c] += step
            left -= step
    for c in out:
        need = min(floor, population[c]) - out[c]
        while need > 0:
            donor = max(out, key=lambda d: (out[d] - floor, d))
            if out[donor] <= floor:
                raise ValueError(f"no cell can give {c} its {floor}")
            out[donor] -= 1
            out[c] += 1
            need -= 1
    return out


def grouped_quota_split(groups: DataFrame, group: str, shares: dict[str, float], purpose: str, forced: DataFrame | None = None) -> DataFrame:
    """(group, split): groups in the order of their digests fill the splits to their quotas.

    Quotas are the shares of the number of groups, rounded half to even; the last split takes what remains.
    ``forced`` groups are the first split's and count in its quota.  The position of a group is counted through
    a histogram of digest prefixes, so no task orders all groups.
    """
    names = list(shares)
    distinct = groups.select(group).filter(F.col(group).isNotNull()).distinct()
    total = distinct.count()
    fixed = forced.select(group).distinct() if forced is not None else None
    held = fixed.join(distinct, group, "left_semi") if fixed is not None else None
    n_held = held.count() if held is not None else 0
    free = distinct.join(held, group, "left_anti") if held is not None else distinct
    ranked = free.withColumn("digest", rank_digest(purpose, F.col(group))).withColumn("cell", F.substring("digest", 1, 3))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = ranked.groupBy("cell").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    placed = ranked.join(F.broadcast(cells.select("cell", "start")), "cell").withColumn("pos", F.col("start") + F.row_number().over(Window.partitionBy("cell").orderBy("digest", group)))
    upto, split = -n_held, F.lit(names[-1])
    bounds = []
    for s in names[:-1]:
        upto += round(shares[s] * total)
        bounds.append((s, upto))
    for s, bound in reversed(bounds):
        split = F.when(F.col("pos") <= bound, s).otherwise(split)
    out = placed.select(group, split.alias("split"))
    return out.unionByName(held.select(group, F.lit(names[0]).alias("split"))) if held is not None else out


def split_audit(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """For each key column how many of its values stand in more than one split."""
    parts = [rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.countDistinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("leaks"), F.count("*").alias("n_values")).withColumn("key", F.lit(k)) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blind_queue(cases: DataFrame, key: str, purpose: str, chunk: int, repeat_share: float) -> DataFrame:
    """(queue_id, position, chunk, is_repeat, key): cases in seeded order with hidden repeats of some.

    The share of repeats is rounded half up.  The queue is a bounded round of labelling, not the corpus.
    """
    order = Window.orderBy("digest", key)
    base = cases.select(key).distinct().withColumn("digest", rank_digest(purpose, F.col(key)))
    n = base.count()
    repeats = int(repeat_share * n + 0.5)
    again = base.withColumn("digest", rank_digest(f"{purpose}:repeat", F.col(key))).orderBy("digest", key).limit(repeats)
    again = again.select(key, rank_digest(f"{purpose}:again", F.col(key)).alias("digest"), F.lit(True).alias("is_repeat"))
    queue = base.withColumn("is_repeat", F.lit(False)).unionByName(again)
    position = F.row_number().over(order)
    return queue.withColumn("position", position).select(
        F.substring("digest", 1, 16).alias("queue_id"), "position", F.floor((F.col("position") - 1) / chunk).alias("chunk"), "is_repeat", key
    )


def agreement(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """The confusion of two passes over the same cases: (label_1, label_2, n)."""
    a = first.select(key, F.col(label).alias("label_1"))
    b = second.select(key, F.col(label).alias("label_2"))
    return a.join(b, key).groupBy("label_1", "label_2").agg(F.count("*").alias("n"))


def kappa(confusion: DataFrame) -> DataFrame:
    """One row (n, observed, expected, kappa) of a confusion."""
    total = confusion.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label_1") == F.col("label_2"), F.col("n")).otherwise(0)).alias("same"))
    rows = confusion.groupBy(F.col("label_1").alias("l")).agg(F.sum("n").alias("r"))
    columns = confusion.groupBy(F.col("label_2").alias("l")).agg(F.sum("n").alias("c"))
    expected = rows.join(columns, "l").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("e"))
    out = total.crossJoin(F.broadcast(expected)).select(F.col("t").alias("n"), (F.col("same") / F.col("t")).alias("observed"), (F.col("e") / (F.col("t") * F.col("t"))).alias("expected"))
    return out.withColumn("kappa", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))
