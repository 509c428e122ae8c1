"""Problem 4: train, validation and test such that related records stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import star_components
from ledgerloom.llm.sample import unit
from ledgerloom.plans.spool import Spool

#: A component with at least this share of all rows is placed by itself, so at most its inverse are.
HEAVY = 0.001
#: Cells of the histogram over the hash interval; it is refined once within the cells that hold a cut.
CELLS = 4096


def _cuts(rows: DataFrame, targets: list[float]) -> list[float]:
    """Points of the unit interval below which ``targets`` rows lie, as nearly as components allow."""

    def counts(part: DataFrame, low: float, width: float) -> dict[int, int]:
        cell = F.least(F.floor((F.col("h") - low) / width * CELLS), F.lit(CELLS - 1)).alias("cell")
        return {r["cell"]: r["n"] for r in part.groupBy(cell).agg(F.sum("n").alias("n")).collect()}

    def walk(found: dict[int, int], before: float, target: float) -> tuple[int, float]:
        for cell in range(CELLS):
            if before + found.get(cell, 0) >= target:
                return cell, before
            before += found.get(cell, 0)
        return CELLS, before

    coarse, cuts = counts(rows, 0.0, 1.0), []
    for target in targets:
        cell, before = walk(coarse, 0.0, target)
        if cell == CELLS:
            cuts.append(1.0)
            continue
        low, width = cell / CELLS, 1.0 / CELLS
        inside = rows.filter((F.col("h") >= low) & (F.col("h") < low + width))
        fine = counts(inside, low, width)
        at, before = walk(fine, before, target)
        over = before + fine.get(at, 0) - target
        cuts.append(low + width * (at + (over < target - before)) / CELLS)
    return cuts


def grouped_split(
    spark: SparkSession, df: DataFrame, record: Column, entity: Column, shares: dict[str, float], salt: str, recorded: DataFrame | None = None
) -> DataFrame:
    """``df`` with ``component`` and ``split``; rows that share a record or entity key fall on one side.

    Components go through any number of shared keys.  A null key relates to nothing; a row with neither key
    is a component of its own, together with rows equal to it in every column.  The component identifier is
    hashed into ranges of the unit interval; components with a thousandth of the rows or more (at most a
    thousand of them) are first placed, largest first, where most rows are missing, and the ranges of the
    rest are cut so that the rows come out in ``shares`` to within one small component.
    """
    spool = Spool(spark, "splits")
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    r, e = F.concat(F.lit("r"), record), F.concat(F.lit("e"), entity)
    # A record key whose rows name one entity is that entity's; only the others link entities.
    own = F.coalesce(e, r, F.concat(F.lit("x"), F.sha2(every, 256)))
    keyed = df.withColumns({"_r": r, "_own": own})
    least = spool.save(
        keyed.filter("_r is not null").groupBy("_r").agg(F.min("_own").alias("_first"), F.max("_own").alias("_last"))
    )
    several = least.filter("_first <> _last")
    links = keyed.join(several, "_r").select(F.col("_own").alias("u"), F.col("_first").alias("v"))
    roots = spool.save(star_components(spark, links).select(F.col("id").alias("_own"), F.col("component").alias("_top")))
    placed = spool.save(keyed.join(roots, "_own", "left").withColumn("component", F.coalesce("_top", "_own")).drop("_r", "_own", "_top"))
    sizes = spool.save(placed.groupBy("component").agg(F.count("*").alias("n")).withColumn("h", unit(F.col("component"), salt)))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    missing = {s: share * total for s, share in shares.items()}
    kept = None
    if recorded is not None:
        known = recorded.filter("record is not null").select(F.concat(F.lit("r"), "record").alias("_r"), F.col("split").alias("_kept"))
        home = keyed.select("_r", "_own").distinct().join(known, "_r").join(roots, "_own", "left").select(F.coalesce("_top", "_own").alias("component"), "_r", "_kept").distinct()
        votes = home.groupBy("component", "_kept").agg(F.count("*").alias("v"))
        kept = spool.save(votes.groupBy("component").agg(F.min(F.struct((-F.col("v")).alias("v"), "_kept")).alias("m")).select("component", "m._kept"))
        for row in sizes.join(kept, "component").groupBy("_kept").agg(F.sum("n").alias("n")).collect():
            missing[row["_kept"]] -= row["n"]
        sizes = spool.save(sizes.join(kept, "component", "left_anti"))
    fixed: list[tuple[str, str]] = []
    for row in sizes.filter(F.col("n") >= max(HEAVY * total, 2)).orderBy(F.desc("n"), "component").collect():
        side = max(missing, key=lambda s: (missing[s], s))
        missing[side] -= row["n"]
        fixed.append((row["component"], side))
    names = list(shares)
    rest = sizes.filter(F.col("n") < max(HEAVY * total, 2))
    room, targets = {s: max(0.0, missing[s]) for s in names}, []
    for s in names[:-1]:
        targets.append((targets[-1] if targets else 0.0) + room[s])
    cuts = _cuts(rest, targets) if total else [0.0] * len(targets)
    ranged = F.lit(names[-1])
    for s, cut in reversed(list(zip(names, cuts))):
        ranged = F.when(unit(F.col("component"), salt) < cut, s).otherwise(ranged)
    by_hand = spark.createDataFrame(fixed, "component string, _side string")
    out = placed.join(F.broadcast(by_hand), "component", "left")
    if kept is None:
        return out.withColumn("split", F.coalesce("_side", ranged)).drop("_side")
    return out.join(kept, "component", "left").withColumn("split", F.coalesce("_kept", "_side", ranged)).drop("_side", "_kept")
