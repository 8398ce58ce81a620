"""Map markers at every zoom level: points are counted once in the finest cells, every coarser level adds up the cells below it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: The deepest level at which markers are clustered, and the latitude at which the square map ends.
DEEPEST, EDGE = 14, 85.05112878


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the point's tile in the square Mercator map of 2^zoom tiles a side; what lies beyond an edge belongs to the last tile."""
    side = 1 << zoom
    kept = F.greatest(F.least(lat, F.lit(EDGE)), F.lit(-EDGE))
    s = F.sin(F.radians(kept))
    x = F.floor((F.pmod(lng + 180, F.lit(360.0)) / 360) * side)
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * side)
    within = lambda c: F.greatest(F.least(c, F.lit(side - 1)), F.lit(0)).cast("int")
    return within(x), within(y)


def quadkey(x: Column, y: Column, zoom: Column, deepest: int = DEEPEST) -> Column:
    """The tile's name: a digit from 0 to 3 for each level, so that a tile's name starts with that of the tile above it."""
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1))
    digits = [F.when(zoom > i, (bit(x, i) + 2 * bit(y, i)).cast("string")) for i in range(deepest - 1, -1, -1)]
    return F.concat_ws("", *digits)


def clusters(points: DataFrame, deepest: int = DEEPEST, key: str = "id") -> DataFrame:
    """(zoom, x, y, n, lat, lng, south, north, west, east, key): the marker of each tile that holds points, from level `deepest` up to 0.

    The marker stands at the mean of its points in millionths of a degree, which do not depend on the order of rows; the box is what a map zooms
    into; the key is that of a marker's only point. Points without coordinates are left out. Only the first sum reads the points; each
    further level reads the one below it, which has fewer rows than the level it came from.
    """
    micro = lambda c: F.floor(F.col(c) * 1_000_000 + 0.5).cast("long")
    x, y = tile(F.col("lat"), F.col("lng"), deepest)
    rows = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(x.alias("x"), y.alias("y"), micro("lat").alias("_lat"), micro("lng").alias("_lng"), F.col(key).alias("_key"))
    sums = {"n": F.count("*"), "lat_sum": F.sum("_lat"), "lng_sum": F.sum("_lng"), "south": F.min("_lat"), "north": F.max("_lat"), "west": F.min("_lng"), "east": F.max("_lng"), "one": F.min("_key")}
    level = materialise(rows.groupBy("x", "y").agg(*[v.alias(k) for k, v in sums.items()]), "tiles")
    levels = [level.withColumn("zoom", F.lit(deepest))]
    up = {"n": F.sum("n"), "lat_sum": F.sum("lat_sum"), "lng_sum": F.sum("lng_sum"), "south": F.min("south"), "north": F.max("north"), "west": F.min("west"), "east": F.max("east"), "one": F.min("one")}
    for zoom in range(deepest - 1, -1, -1):
        level = level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(*[v.alias(k) for k, v in up.items()])
        if zoom % 4 == 0:
            level = materialise(level, "tiles")  # so that levels are not computed from the finest one again and again
        levels.append(level.withColumn("zoom", F.lit(zoom)))
    every = levels[0]
    for rows in levels[1:]:
        every = every.unionByName(rows)
    degrees = lambda c: F.col(c) / 1_000_000
    mean = lambda c: F.floor(F.col(c) / F.col("n") + 0.5) / 1_000_000
    return every.select(
        "zoom", "x", "y", "n", mean("lat_sum").alias("lat"), mean("lng_sum").alias("lng"), *[degrees(c).alias(c) for c in ("south", "north", "west", "east")], F.when(F.col("n") == 1, F.col("one")).alias(key)
    )


def parts(markers: DataFrame) -> DataFrame:
    """markers with `parts`: into how many markers each falls apart one level deeper; null at the deepest level."""
    below = markers.where("zoom > 0").groupBy((F.col("zoom") - 1).alias("_z"), F.shiftright("x", 1).alias("_x"), F.shiftright("y", 1).alias("_y")).agg(F.count("*").alias("parts"))
    return markers.join(below, (F.col("zoom") == F.col("_z")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_z", "_x", "_y")
