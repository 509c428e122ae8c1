"""Clusters of scored pairs: components, merge levels, coherent clusters, best links, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import coherent
from ledgerloom.plans.spool import Spool


def jump(spool: Spool, point: DataFrame) -> DataFrame:
    """The pointers (id, to) of a forest moved on to their roots by doubling; ``point`` is a spooled table and is dropped."""
    while True:
        onward = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = spool.save(point.join(onward, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        spool.drop(point)
        point = jumped
        if point.filter("moved").isEmpty():
            return point


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, cluster) for every id on an edge (u, v): the smallest id reachable.

    Rounds of contraction: each node points to the smallest of its neighbours and itself, pointers jump until
    they reach a local minimum, and edges between the minima make the graph of the next round, with half the
    nodes or fewer.  Minima are taken on the map side first, so a hub costs no task more than its share.
    """
    spool = Spool(spark, "contract")

    def undirected(df: DataFrame) -> DataFrame:
        return df.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    live, maps = spool.save(undirected(edges)), []
    while live.spool_rows:
        ends = live.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("to"))
        starts = live.select(F.col("u").alias("id"), F.col("u").alias("to")).distinct()
        point = spool.save(ends.unionByName(starts).groupBy("id").agg(F.min("to").alias("to")))
        point = jump(spool, point)
        maps.append(point)
        u = point.select(F.col("id").alias("u"), F.col("to").alias("x"))
        v = point.select(F.col("id").alias("v"), F.col("to").alias("y"))
        contracted = spool.save(undirected(live.join(u, "u").join(v, "v").select(F.col("x").alias("u"), F.col("y").alias("v"))))
        spool.drop(live)
        live = contracted
    if not maps:
        return live.select(F.col("u").alias("id"), F.col("v").alias("cluster"))
    out = maps[-1].select("id", F.col("to").alias("cluster"))
    for point in reversed(maps[:-1]):
        top = out.select(F.col("id").alias("to"), "cluster")
        out = point.join(top, "to", "left").select("id", F.coalesce("cluster", "to").alias("cluster"))
    return out


def clusters_at(spark: SparkSession, pairs: DataFrame, floor: float) -> DataFrame:
    """(id, cluster) at a weight of ``floor`` or more; NaN and null link nothing, an unlinked id stands alone."""
    strong = pairs.filter(~F.isnan("w") & (F.col("w") >= floor))
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).filter("id is not null").distinct()
    return ids.join(components(spark, strong), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row: clusters, median and 95th percentile of sizes, largest, its share in percent, whether under the bar of 1 %."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("clusters"), F.median("n").alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("largest"), F.sum("n").alias("ids"))
    share = F.round(100 * F.col("largest") / F.col("ids"), 4)
    return out.withColumn("largest_pct", share).withColumn("within_bar", share <= 1.0)


def best_links(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v, w) that are the single best of at least one of their ends; ties by the ends."""
    sides = pairs.select(F.explode(F.array("u", "v")).alias("node"), "u", "v", "w")
    order = Window.partitionBy("node").orderBy(F.desc("w"), "u", "v")
    return sides.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("u", "v", "w").distinct()


def merge_levels(spark: SparkSession, pairs: DataFrame, floor: float) -> DataFrame:
    """(u, v, level): the merges of single linkage at ``floor`` or more, as a maximum spanning forest.

    The level at which any two ids first share a cluster is the least level on the path between them, so the
    n - 1 merges hold all pairs' levels without writing the pairs.  Each round every component takes its
    heaviest outgoing pair, ties by the ids, and the components that this joins become one.
    """
    spool = Spool(spark, "forest")
    strong = pairs.filter(~F.isnan("w") & (F.col("w") >= floor) & (F.col("u") != F.col("v")))
    edge = strong.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))
    live = spool.save(edge.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct((-F.col("w")).alias("m"), "u", "v").alias("e")))
    forest = edge.select("u", "v", F.col("w").alias("level")).limit(0)
    while live.spool_rows:
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o"), "e"), F.struct(F.col("b").alias("c"), F.col("a").alias("o"), "e"))).alias("x")).select("x.*")
        best = spool.save(ends.groupBy("c").agg(F.min(F.struct("e", "o")).alias("x")).select("c", "x.e", "x.o"))
        forest = forest.unionByName(best.select("e").distinct().select("e.u", "e.v", (-F.col("e.m")).alias("level")))
        back = best.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        # Two components that chose the same pair are the root of their tree, under the smaller name.
        point = spool.save(best.join(back, "o").select(F.col("c").alias("id"), F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("to")))
        point = jump(spool, point)
        turned = live.join(point.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(point.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        contracted = spool.save(turned.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e")))
        spool.drop(live, point)
        live = contracted
    return forest


def coherent_clusters(spark: SparkSession, pairs: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(id, cluster) where two clusters merge only if every cross pair of their names coheres.

    Pairs (u, v, w) of weight ``floor`` or more count from the heaviest on, ties by the ids; NaN and null link
    nothing.  ``names`` is (id, name_clean), an id once; an absent name is empty.  Names cohere as in
    ``functions.similarity.coherent``.  The cluster is named by its smallest id.

    Two clusters that do not cohere never will, since members only come in; so every round drops such pairs and
    merges all clusters that are each other's heaviest partner, which gives what merging one pair at a time
    does.  Members meet only across clusters that are about to merge.
    """
    spool = Spool(spark, "coherent")
    strong = pairs.filter(~F.isnan("w") & (F.col("w") >= floor) & (F.col("u") != F.col("v")))
    edge = strong.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("w").alias("w"))
    live = spool.save(edge.select("a", "b", F.struct((-F.col("w")).alias("m"), F.col("a").alias("u"), F.col("b").alias("v")).alias("e"), F.lit(True).alias("fresh")))
    ids = live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    home = spool.save(ids.join(names.select("id", F.coalesce("name_clean", F.lit("")).alias("name")), "id", "left").select("id", F.col("id").alias("cluster"), F.coalesce("name", F.lit("")).alias("name")))
    while live.spool_rows:
        left = home.select(F.col("cluster").alias("a"), F.col("name").alias("x")).distinct()
        right = home.select(F.col("cluster").alias("b"), F.col("name").alias("y")).distinct()
        apart = live.filter("fresh").select("a", "b").join(left, "a").join(right, "b").filter(~coherent(F.col("x"), F.col("y"))).select("a", "b").distinct()
        fitting = spool.save(live.join(apart, ["a", "b"], "left_anti").select("a", "b", "e"))
        ends = fitting.select(F.explode(F.array(F.struct(F.col("a").alias("c"), "e"), F.struct(F.col("b").alias("c"), "e"))).alias("x")).select("x.*")
        best = ends.groupBy("c").agg(F.min("e").alias("e"))
        mutual = best.groupBy("e").agg(F.min("c").alias("new"), F.max("c").alias("old")).filter("new <> old")
        merged = spool.save(mutual.select("old", "new"))
        moved = spool.save(home.join(merged, home["cluster"] == merged["old"], "left").select("id", F.coalesce("new", "cluster").alias("cluster"), "name"))
        a = merged.select(F.col("old").alias("a"), F.col("new").alias("ta"))
        b = merged.select(F.col("old").alias("b"), F.col("new").alias("tb"))
        grown = merged.select(F.col("new").alias("g"))
        turned = fitting.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "e").filter("x <> y")
        turned = turned.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e"))
        turned = turned.join(grown.withColumnRenamed("g", "a").withColumn("ga", F.lit(True)), "a", "left").join(grown.withColumnRenamed("g", "b").withColumn("gb", F.lit(True)), "b", "left")
        following = spool.save(turned.select("a", "b", "e", F.coalesce("ga", "gb", F.lit(False)).alias("fresh")))
        spool.drop(live, fitting, home)
        live, home = following, moved
    return home.select("id", "cluster")


def membership_churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ids in both clusterings and how many of them changed the set of companions among those ids."""
    both = before.select("id", F.col("cluster").alias("c0")).join(after.select("id", F.col("cluster").alias("c1")), "id")
    n0 = both.groupBy("c0").agg(F.count("*").alias("n0"))
    n1 = both.groupBy("c1").agg(F.count("*").alias("n1"))
    n01 = both.groupBy("c0", "c1").agg(F.count("*").alias("n01"))
    joined = n01.join(n0, "c0").join(n1, "c1")
    return joined.agg(F.sum("n01").alias("ids"), F.coalesce(F.sum(F.when((F.col("n01") < F.col("n0")) | (F.col("n01") < F.col("n1")), F.col("n01"))), F.lit(0)).alias("changed"))
