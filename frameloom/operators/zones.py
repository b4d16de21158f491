"""The first zone that holds a point, by a grid.

Each camera's ground is cut into square cells, small enough for its zones and few enough for their number. A cell within a
zone is marked so, and a cell that an edge crosses keeps the zone's polygon; so a point is looked up by its cell, and only
the zones whose edge is near are tested exactly. What a point costs hardly depends on the number of zones. A cell's zones
are in the order of the list and end with the first that holds all of it, as no later one counts there.

Zones are settings: up to `most` cells in all are broadcast and points not shuffled; more are joined by a shuffle. Inactive
zones and polygons of fewer than three corners hold nothing; a point without finite coordinates or camera has no zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.geometry import in_polygon

#: Cells for each zone of a camera on average, about, and how far off a coordinate may be and still count as on an edge.
CELLS, EDGE = 64, 1e-6


def crosses(polygon: Column, x0: Column, y0: Column, size: Column) -> Column:
    """Whether an edge of a polygon meets a square, with room for rounding: their boxes overlap, and the square's corners
    are not all on one side of the edge's line."""
    n = F.size(polygon)
    left, top, right, bottom = x0 - EDGE, y0 - EDGE, x0 + size + EDGE, y0 + size + EDGE

    def meets(i: Column) -> Column:
        a, b = polygon[F.when(i == 0, n - 1).otherwise(i - 1)], polygon[i]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        boxes = (F.greatest(a["x"], b["x"]) >= left) & (F.least(a["x"], b["x"]) <= right) & (F.greatest(a["y"], b["y"]) >= top) & (F.least(a["y"], b["y"]) <= bottom)
        sides = [dx * (y - a["y"]) - dy * (x - a["x"]) for x in (left, right) for y in (top, bottom)]
        return boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(F.sequence(F.lit(0), n - 1), meets)


def grids(zones: DataFrame) -> DataFrame:
    """camera_id, gx, gy and cell: where each camera's grid begins and how wide its cells are."""
    wide, high = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    sums = zones.groupBy("camera_id").agg(F.min("left").alias("gx"), F.min("top").alias("gy"), F.avg(F.greatest(wide, high)).alias("extent"), F.sum(wide * high).alias("area"), F.count("*").alias("n"))
    # zones of mean size have some cells across, and all together no more than so many a zone
    cell = F.greatest(F.col("extent") / 4, F.sqrt(F.col("area") / (F.col("n") * CELLS)), F.lit(EDGE * 1000))
    return sums.select("camera_id", "gx", "gy", cell.alias("cell"))


def celled(zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cameras' grids, and their cells (camera_id, ix, iy) that a zone reaches, each with its list of zones: zone_id,
    and the polygon if a point has to be tested."""
    corner = lambda f, name: f(F.transform("polygon", lambda p: p[name]))
    active = zones.where(F.col("is_active") & (F.size("polygon") >= 3)).select(
        "camera_id", "zone_ord", "zone_id", "polygon", (corner(F.array_min, "x") - EDGE).alias("left"), (corner(F.array_min, "y") - EDGE).alias("top"), (corner(F.array_max, "x") + EDGE).alias("right"), (corner(F.array_max, "y") + EDGE).alias("bottom")
    )
    grid = grids(active)
    at = lambda c, origin: F.floor((F.col(c) - F.col(origin)) / F.col("cell"))
    laid = active.join(grid, "camera_id")
    laid = laid.withColumn("ix", F.explode(F.sequence(at("left", "gx"), at("right", "gx")))).withColumn("iy", F.explode(F.sequence(at("top", "gy"), at("bottom", "gy"))))
    x0, y0 = F.col("gx") + F.col("ix") * F.col("cell"), F.col("gy") + F.col("iy") * F.col("cell")
    border = F.coalesce(crosses(F.col("polygon"), x0, y0, F.col("cell")), F.lit(True))
    laid = laid.withColumn("border", border).where(F.col("border") | in_polygon(x0 + F.col("cell") / 2, y0 + F.col("cell") / 2, F.col("polygon")))
    entry = F.struct("zone_ord", "zone_id", F.when(F.col("border"), F.col("polygon")).alias("polygon"))
    lists = laid.groupBy("camera_id", "ix", "iy").agg(F.sort_array(F.collect_list(entry)).alias("zones"))
    whole = F.array_position(F.transform("zones", lambda z: z["polygon"].isNull()), True)
    return grid, lists.select("camera_id", "ix", "iy", F.when(whole > 0, F.slice("zones", F.lit(1), whole.cast("int"))).otherwise(F.col("zones")).alias("zones"))


def classify(points: DataFrame, zones: DataFrame, most: int = 50_000) -> DataFrame:
    """points (camera_id, x, y, ...) with zone_id; zones: camera_id, zone_ord, zone_id, polygon, is_active."""
    grid, cells = celled(zones)
    few = cells.count() <= most
    small = lambda df: F.broadcast(df) if few else df
    finite = (F.abs("x") < 1e15) & (F.abs("y") < 1e15)
    place = lambda c, origin: F.when(finite, F.floor((F.col(c) - F.col(origin)) / F.col("cell")))
    placed = points.join(small(grid), "camera_id", "left").withColumns({"_ix": place("x", "gx"), "_iy": place("y", "gy")}).drop("gx", "gy", "cell")
    keyed = cells.withColumnsRenamed({"ix": "_ix", "iy": "_iy", "zones": "_zones"})
    joined = placed.join(small(keyed), ["camera_id", "_ix", "_iy"], "left")
    held = F.filter("_zones", lambda z: z["polygon"].isNull() | in_polygon(F.col("x"), F.col("y"), z["polygon"]))
    return joined.withColumn("zone_id", F.get(held, F.lit(0))["zone_id"]).drop("_zones", "_ix", "_iy")
