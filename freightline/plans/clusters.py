"""Clusters of points within a distance of each other, anywhere on the sphere (GN8)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightline.session import discard, stored

from ..functions.geo import haversine_km

RADIUS_KM = 6371.0
#: Point pairs that two parts may have to be tested directly; larger products are divided first.
DIRECT = 256


def _bands(eps_km: float) -> tuple[float, int]:
    """Height of a band in degrees, and the number of bands: chords of two sides of a cell stay within eps."""
    side = math.degrees(2 * math.sin(min(eps_km / (2 * RADIUS_KM), math.pi / 2)) / math.sqrt(2.0))
    return min(side, 180.0), max(1, math.ceil(180.0 / min(side, 180.0)))


def _around(cy: Column, side: float) -> Column:
    """Whole number of cells in band ``cy``, so that none is wider than a side where the band is widest."""
    low, high = cy * side - 90.0, (cy + 1) * side - 90.0
    nearest = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.greatest(F.lit(1), F.ceil(360.0 * F.cos(F.radians(nearest)) / side)).cast("bigint")


def _neighbours(cells: DataFrame, eps_km: float, side: float, bands: int) -> DataFrame:
    """(a, b): pairs of filled cells (cell, ...) that can hold points within eps of each other, each once."""
    r = eps_km / RADIUS_KM
    reach = math.ceil(math.degrees(r) / side)
    cy, cx = F.col("cell.cy"), F.col("cell.cx")
    farthest = F.radians(F.least(F.lit(90.0), F.greatest(F.abs(cy * side - 90.0), F.abs((cy + 1) * side - 90.0))))
    lon = F.when(farthest + r < math.pi / 2 - 1e-9, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(r, math.pi / 2)) / F.cos(farthest)))) + 1e-9).otherwise(180.0)
    rows = cells.select("cell", (360.0 / _around(cy, side)).alias("w"), lon.alias("lon"),
                        F.explode(F.sequence(F.greatest(cy - reach, F.lit(0)), F.least(cy + reach, F.lit(bands - 1)))).alias("by"))
    n = _around(F.col("by"), side)
    first, last = F.floor((cx * F.col("w") - F.col("lon")) * n / 360.0), F.floor(((cx + 1) * F.col("w") + F.col("lon")) * n / 360.0)
    found = F.when(F.col("w") + 2 * F.col("lon") >= 360.0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(first, last), lambda x: F.pmod(x, n))))
    rows = rows.select(F.col("cell").alias("a"), "by", F.explode(found).alias("bx"))
    rows = rows.select("a", F.struct(F.col("by").alias("cy"), F.col("bx").alias("cx")).alias("b")).filter(F.col("b") > F.col("a"))
    return rows.join(cells.select(F.col("cell").alias("b")), "b").select("a", "b")


def _part(level: int, side: float) -> Column:
    """The part of its cell that a point lies in: the cell halved ``level`` times in both directions."""
    w = 360.0 / _around(F.col("cell.cy"), side)
    down = F.floor((F.col("lat") + 90.0 - F.col("cell.cy") * side) / side * 2 ** level)
    across = F.floor((F.col("lon") - F.col("cell.cx") * w) / w * 2 ** level)
    return F.struct(down.alias("y"), across.alias("x"))


def _parts(points: DataFrame, level: int, side: float) -> DataFrame:
    """(cell, part, n, box, one): points of each part, the box around them and one of them."""
    return points.withColumn("part", _part(level, side)).groupBy("cell", "part").agg(
        F.count("*").alias("n"), F.struct(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"),
                                          F.max("lon").alias("e")).alias("box"), F.min(F.struct("lat", "lon")).alias("one"))


def _may_reach(a: str, b: str, eps_km: float) -> Column:
    """False only if no point of box ``a`` is within eps of one of box ``b``."""
    box = lambda x, c: F.col(f"{x}.{c}")
    lat = F.greatest(F.lit(0.0), box(b, "s") - box(a, "n"), box(a, "s") - box(b, "n"))
    gap = F.greatest(F.lit(0.0), box(b, "w") - box(a, "e"), box(a, "w") - box(b, "e"))
    back = F.greatest(F.lit(0.0), 360.0 - (F.greatest(box(a, "e"), box(b, "e")) - F.least(box(a, "w"), box(b, "w"))))
    low = lambda x: F.cos(F.radians(F.greatest(F.abs(box(x, "s")), F.abs(box(x, "n")))))
    h = F.sin(F.radians(lat) / 2) ** 2 + low(a) * low(b) * F.sin(F.radians(F.least(gap, back)) / 2) ** 2
    return h <= math.sin(min(eps_km / (2 * RADIUS_KM), math.pi / 2)) ** 2 * (1 + 1e-9) + 1e-15


def _near(a: str, b: str, eps_km: float) -> Column:
    return haversine_km(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon")) <= eps_km


def _linked_cells(points: DataFrame, pairs: DataFrame, eps_km: float, side: float, direct: int) -> DataFrame:
    """The pairs (a, b) of cells that hold points (cell, lat, lon; distinct) within eps of each other.

    Parts of two cells that cannot reach each other go; one pair of points within eps ends the search for the
    cells; small products of parts are tested directly; all others are halved, so that only parts along the
    border of reach are looked at again."""
    found, level = [], 0
    root = F.struct(F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("x"))
    open_ = stored(pairs.select("a", "b", root.alias("pa"), root.alias("pb")), "cell-pairs")
    while not open_.isEmpty():
        parts = stored(_parts(points, level, side), "cell-parts")
        side_of = lambda x: parts.select(F.col("cell").alias(x), F.col("part").alias(f"p{x}"), F.col("n").alias(f"n{x}"),
                                         F.col("box").alias(f"box_{x}"), F.col("one").alias(f"one_{x}"))
        both = open_.join(side_of("a"), ["a", "pa"]).join(side_of("b"), ["b", "pb"]).filter(_may_reach("box_a", "box_b", eps_km))
        both = stored(both.withColumn("near", _near("one_a", "one_b", eps_km)), "cell-pairs")
        links = both.filter("near").select("a", "b").distinct()
        rest = both.filter("NOT near").join(links, ["a", "b"], "left_anti")
        small = rest.filter(F.col("na") * F.col("nb") <= direct).select("a", "b", "pa", "pb")
        placed = points.withColumn("part", _part(level, side))
        one = placed.select(F.col("cell").alias("a"), F.col("part").alias("pa"), F.struct("lat", "lon").alias("u"))
        two = placed.select(F.col("cell").alias("b"), F.col("part").alias("pb"), F.struct("lat", "lon").alias("v"))
        tested = small.join(one, ["a", "pa"]).join(two, ["b", "pb"]).filter(_near("u", "v", eps_km)).select("a", "b")
        links = stored(links.unionByName(tested).distinct(), "cell-links")
        found.append(links)
        inner = placed.withColumn("sub", _part(level + 1, side)).select("cell", "part", "sub").distinct()
        down = rest.filter(F.col("na") * F.col("nb") > direct).join(links, ["a", "b"], "left_anti").select("a", "b", "pa", "pb")
        down = down.join(inner.select(F.col("cell").alias("a"), F.col("part").alias("pa"), F.col("sub").alias("sa")), ["a", "pa"])
        down = down.join(inner.select(F.col("cell").alias("b"), F.col("part").alias("pb"), F.col("sub").alias("sb")), ["b", "pb"])
        deeper = stored(down.select("a", "b", F.col("sa").alias("pa"), F.col("sb").alias("pb")), "cell-pairs")
        discard(open_, parts, both)
        open_, level = deeper, level + 1
    discard(open_)
    out = found[0] if found else pairs.limit(0)
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def eps_clusters(points: DataFrame, id_col: str, lat: str, lon: str, eps_km: float, direct: int = DIRECT) -> DataFrame:
    """GN8: DBSCAN with ``min_samples=1`` and the haversine metric: clusters are the connected components of
    the graph "within eps_km".  Output: ``id, cluster``, the cluster named by its smallest id.

    Points lie in cells of latitude bands, each with a whole number of cells, so that any two points of a cell
    are within eps, at the antimeridian and the poles too.  A cell is one node of the graph, and a dense cell
    costs no pair work; whether two cells link is found by dividing them (:func:`_linked_cells`).  Points
    without coordinates are left out."""
    from .network import connected_components
    side, bands = _bands(eps_km)
    p = points.select(F.col(id_col).alias("pid"), F.col(lat).cast("double").alias("lat"),
                      F.pmod(F.col(lon).cast("double") + 180.0, F.lit(360.0)).alias("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")
    cy = F.least(F.floor((F.col("lat") + 90.0) / side), F.lit(bands - 1)).cast("bigint")
    n = _around(F.col("cy"), side)
    p = p.withColumn("cy", cy).withColumn("cx", F.least(F.floor(F.col("lon") * n / 360.0), n - 1).cast("bigint"))
    p = p.select("pid", "lat", "lon", F.struct("cy", "cx").alias("cell"))
    cells = stored(p.groupBy("cell").agg(F.min("pid").alias("name")), "cells")
    places = stored(p.select("cell", "lat", "lon").distinct(), "cell-points")
    links = _linked_cells(places, _neighbours(cells, eps_km, side, bands), eps_km, side, direct)
    edges = links.join(cells.select(F.col("cell").alias("a"), F.col("name").alias("src")), "a").join(
        cells.select(F.col("cell").alias("b"), F.col("name").alias("dst")), "b").select("src", "dst")
    comp = connected_components(cells.select(F.col("name").alias("node_id")), edges)
    out = p.join(cells, "cell").join(comp.withColumnRenamed("node_id", "name"), "name")
    return out.select(F.col("pid").alias(id_col), F.col("component").alias("cluster"))
