"""Places on a grid: centroids of ZIP codes, a cascade of placements, binning, blur and relief."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import zip5


def attach_centroids(rows: DataFrame, zipcode: str, places: DataFrame) -> DataFrame:
    """The rows with lat and lon of their ZIP; rows without a known ZIP stay, with nulls. ``places`` is (zip, lat, lon)."""
    return rows.withColumn("zip", zip5(F.col(zipcode))).join(places, "zip", "left")


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (south, west, north, east)."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def placement_cascade(rows: DataFrame, key: str, zipcode: str, city: str, state: str, places: DataFrame) -> DataFrame:
    """(key, lat, lon, how): by ZIP, else by the mean of the city's placed rows, else by a ZIP of the state chosen by digest, else dropped.

    ``places`` is (zip, lat, lon, state).  A state's pool is ordered, so the choice depends on the key alone.
    """
    by_zip = attach_centroids(rows, zipcode, places.select("zip", "lat", "lon"))
    town = F.upper(F.trim(F.col(city)))
    centres = by_zip.filter("lat is not null").groupBy(town.alias("town")).agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    ordered = Window.partitionBy("state").orderBy("zip")
    pool = places.select(F.col("state").alias("p_state"), F.row_number().over(ordered).alias("slot"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    sizes = places.groupBy(F.col("state").alias("s_state")).agg(F.count("*").alias("slots"))
    placed = by_zip.withColumn("town", town).join(centres, "town", "left").join(sizes, F.col(state) == F.col("s_state"), "left")
    slot = F.pmod(F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long"), F.col("slots")) + 1
    placed = placed.withColumn("want", slot).join(pool, (F.col("s_state") == F.col("p_state")) & (F.col("want") == F.col("slot")), "left")
    how = F.when(F.col("lat").isNotNull(), "zip").when(F.col("c_lat").isNotNull(), "city").when(F.col("p_lat").isNotNull(), "state")
    return placed.select(key, F.coalesce("lat", "c_lat", "p_lat").alias("lat"), F.coalesce("lon", "c_lon", "p_lon").alias("lon"), how.alias("how")).filter("how is not null")


def grid(points: DataFrame, box: tuple[float, float, float, float], ny: int, nx: int, weight: str | None = None) -> DataFrame:
    """(iy, ix, value): points summed into cells, halves to even; those outside are left out."""
    iy = F.bround((F.col("lat") - box[0]) / (box[2] - box[0]) * (ny - 1)).cast("int")
    ix = F.bround((F.col("lon") - box[1]) / (box[3] - box[1]) * (nx - 1)).cast("int")
    cells = points.select(iy.alias("iy"), ix.alias("ix"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    return cells.filter(F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1)).groupBy("iy", "ix").agg(F.sum("w").alias("value"))


def blur(cells: DataFrame, ny: int, nx: int, sigma: float) -> DataFrame:
    """A separable Gaussian blur of a sparse grid; what falls over an edge stays in the edge's cells."""
    reach = max(1, int(3 * sigma + 0.5))
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k / sum(raw)).alias("k")) for d, k in zip(range(-reach, reach + 1), raw)])
    for axis, other, size in (("iy", "ix", ny), ("ix", "iy", nx)):
        spread = cells.withColumn("step", F.explode(kernel))
        moved = F.least(F.greatest(F.col(axis) + F.col("step.d"), F.lit(0)), F.lit(size - 1))
        cells = spread.select(moved.alias(axis), other, (F.col("value") * F.col("step.k")).alias("value")).groupBy(axis, other).agg(F.sum("value").alias("value"))
    return cells.select("iy", "ix", "value")


def box_smooth(cells: DataFrame, ny: int, nx: int, passes: int) -> DataFrame:
    """A sparse grid whose cells are half themselves and an eighth of each of four neighbours, ``passes`` times; an edge is its own neighbour."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in ((0, 0, 0.5), (1, 0, 0.125), (-1, 0, 0.125), (0, 1, 0.125), (0, -1, 0.125))])
    for _ in range(passes):
        moved = cells.withColumn("s", F.explode(steps)).withColumns({"ty": F.col("iy") + F.col("s.dy"), "tx": F.col("ix") + F.col("s.dx")})
        # What would leave the grid stays where it is: the cell beyond the edge is the edge cell's own double.
        out = ~(F.col("ty").between(0, ny - 1) & F.col("tx").between(0, nx - 1))
        moved = moved.withColumns({"ty": F.when(out, F.col("iy")).otherwise(F.col("ty")), "tx": F.when(out, F.col("ix")).otherwise(F.col("tx"))})
        cells = moved.groupBy(F.col("ty").alias("iy"), F.col("tx").alias("ix")).agg(F.sum(F.col("value") * F.col("s.w")).alias("value"))
    return cells


def relief(cells: DataFrame, height: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(iy, ix, value, shade): cube roots scaled to their maximum, and a hillshade from neighbours' differences."""
    scaled = cells.withColumn("z", F.cbrt("value")).withColumn("z", F.col("z") / F.max("z").over(Window.partitionBy()) * height)
    rows, columns = Window.partitionBy("ix").orderBy("iy"), Window.partitionBy("iy").orderBy("ix")

    def slope(axis: str, w) -> Column:
        after = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead("z").over(w))
        before = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag("z").over(w))
        return (F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))) / 2

    sloped = scaled.withColumns({"dy": slope("iy", rows), "dx": slope("ix", columns)})
    steep = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    aspect = F.atan2("dy", -F.col("dx"))
    sun, up = math.radians((360 - azimuth + 90) % 360), math.radians(altitude)
    shade = F.sin(F.lit(up)) * F.cos(steep) + F.cos(F.lit(up)) * F.sin(steep) * F.cos(F.lit(sun) - aspect)
    return sloped.select("iy", "ix", "value", F.greatest(shade, F.lit(0.0)).alias("shade"))
