"""Groups of linked records: Boruvka hooking, and alternating large-star small-star.

Neither gathers a group: each round is a handful of aggregations with map-side partials and equi-joins,
whose state is written to the shared checkpoint folder.  A hub with a third of all edges is one key of a
join on one side only, which AQE splits; its neighbours are reduced to a minimum before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.spool import Spool


def _undirected(edges: DataFrame) -> DataFrame:
    """(u, v) with u < v, each once; loops and edges with a null end are left out."""
    return (
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: (c, o)."""
    return edges.select(
        F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o")))).alias("e")
    ).select("e.*")


def boruvka(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, group_id) for every id on an edge (u, v); group_id is the smallest id of the group.

    Every component selects its smallest outgoing edge, edges being ordered by (smaller end, larger end).
    Selected edges form trees with one mutual pair each, whose smaller end is the root, and the root is
    the smallest id of its tree.  Trees collapse by pointer doubling, edges are relabelled and
    deduplicated, until none remain.  Components at least halve in each round.

    Nulls, loops, repeated edges and either order of the ends are allowed; no edges give no rows.
    """
    spool = Spool(spark, "boruvka")
    live = spool.save(_undirected(edges))
    levels: list[DataFrame] = []
    while live.spool_rows:
        seen = _both_ways(live).select("c", F.struct(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).alias("e"))
        picked = spool.save(
            seen.groupBy("c").agg(F.min("e").alias("e")).select("c", F.when(F.col("e.a") == F.col("c"), F.col("e.b")).otherwise(F.col("e.a")).alias("p"))
        )
        ahead = picked.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # The smaller end of a mutual choice is the root of its tree.
        tree = spool.save(
            picked.join(ahead, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        )
        spool.drop(picked)
        while True:
            ahead = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            after = spool.save(tree.join(ahead, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            done = after.filter("moved").isEmpty()
            spool.drop(tree)
            tree = after
            if done:
                break
        levels.append(tree)
        left = live.join(tree.select(F.col("c").alias("u"), F.col("p").alias("pu")), "u").join(tree.select(F.col("c").alias("v"), F.col("p").alias("pv")), "v")
        following = spool.save(_undirected(left.select(F.col("pu").alias("u"), F.col("pv").alias("v"))))
        spool.drop(live)
        live = following
    if not levels:
        return live.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # Compose the maps from the last, smallest one backwards.
    total = levels[-1].select(F.col("c").alias("p"), F.col("p").alias("top"))
    for level in reversed(levels[:-1]):
        total = level.join(total, "p", "left").select(F.col("c").alias("p"), F.coalesce("top", "p").alias("top"))
    return total.select(F.col("p").alias("id"), F.col("top").alias("group_id"))


def star_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (u, v), by alternating large-star and small-star.

    Large-star links a node's larger neighbours to the least node it knows; small-star links its smaller
    neighbours and itself to it.  Both are a minimum per node joined back to the edges, so no neighbour
    list is ever built.  It ends when a large-star and a small-star together change nothing.
    """
    spool = Spool(spark, "stars")
    live = spool.save(_undirected(edges))
    if not live.spool_rows:
        return live.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        around = _both_ways(live)
        least = around.groupBy("c").agg(F.least(F.min("o"), F.first("c")).alias("m"))
        large = spool.save(_undirected(around.filter("o > c").join(least, "c").select(F.col("o").alias("u"), F.col("m").alias("v"))))
        # In (u, v) with u < v, v has the smaller neighbours u.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        below = large.join(least, "v").select("u", "m").union(least.select(F.col("v").alias("u"), "m"))
        small = spool.save(_undirected(below.select("u", F.col("m").alias("v"))))
        same = small.spool_rows == live.spool_rows and small.count() == live.count() and live.exceptAll(small).isEmpty()
        spool.drop(live, large)
        live = small
        if same:
            break
    roots = live.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return live.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots)
