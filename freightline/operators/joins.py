"""Joins Spark has no single operator for: as-of, nearest neighbour, radius,
lookup with default, positional zip, and grant-based semi/anti filters.

Design notes (scale):

* As-of join: rows are bucketed by ``floor(t / tolerance)``; each right row is
  copied into its own and the following bucket, so one window partition
  ``(key, bucket)`` holds at most two tolerance spans of one key.  A hot key
  is therefore split by time instead of landing in one task.
* Spatial joins use integer grid cells as equi-join keys.  Only candidate
  pairs in neighbouring cells are formed; distance filters do the rest.
  Nearest-neighbour search starts at a fine cell and doubles it only for the
  query points not yet resolved, so most points are settled on the first
  level.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightline.session import ensure_checkpoint_dir
from ..functions.geo import EARTH_RADIUS_KM, haversine_km, planar_distance

KM_PER_DEG = 2 * math.pi * EARTH_RADIUS_KM / 360.0


def _micros(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              tolerance_seconds: float, right_cols: Sequence[str], right_order: Sequence[str] = ()) -> DataFrame:
    """Backward as-of left join: for each left row the latest right row of the
    same ``by`` key with ``right_ts <= left_ts`` and within the tolerance;
    unmatched left rows keep nulls.  Exact matches count (right sorts first);
    among right rows with equal time the last by ``right_order`` wins."""
    tol = int(tolerance_seconds * 1_000_000)
    lcols = [c for c in left.columns]
    rpay = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in right_cols])
    lside = left.select(*[F.col(k) for k in by], _micros(left_ts).alias("_t"),
                        F.floor(_micros(left_ts) / tol).alias("_b"), F.lit(1).alias("_side"),
                        F.struct(*[F.col(c) for c in lcols]).alias("_l"))
    rsel = right.select(*[F.col(k) for k in by], _micros(right_ts).alias("_t"),
                        *[F.col(c) for c in right_order], rpay.alias("_r"))
    rside = (rsel.withColumn("_b", F.explode(F.array(F.floor(F.col("_t") / tol), F.floor(F.col("_t") / tol) + 1)))
                 .withColumn("_side", F.lit(0)))
    ordering = [F.col(c) for c in right_order]
    for c in right_order:
        lside = lside.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    u = lside.unionByName(rside, allowMissingColumns=True)
    w = (Window.partitionBy(*by, "_b").orderBy(F.col("_t"), F.col("_side"), *ordering)
         .rowsBetween(Window.unboundedPreceding, 0))
    m = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    ok = (F.col("_t") - _micros(F.col("_m._rts"))) <= tol
    m = m.withColumn("_m", F.when(ok, F.col("_m")))
    return m.select(*[F.col(f"_l.{c}").alias(c) for c in lcols],
                    *[F.col(f"_m.{c}").alias(c) for c in right_cols],
                    F.col("_m._rts").alias(f"matched_{right_ts}"))


def _cell_cols(lat: Column, lon: Column, cell: float):
    """Grid cell of a point; a whole number of longitude cells, each at least ``cell`` degrees wide,
    wraps at the antimeridian."""
    ncx = max(1, int(360.0 // cell))
    return (F.floor((lat + 90.0) / cell).cast("bigint"),
            F.pmod(F.floor((lon + 180.0) / 360.0 * ncx).cast("bigint"), F.lit(ncx).cast("bigint")))


def _neighbour_cells(cy: Column, cx: Column, cell: float) -> Column:
    ncx = max(1, int(360.0 // cell))
    cells = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            cells.append(F.struct((cy + dy).alias("cy"), F.pmod(cx + dx, F.lit(ncx)).alias("cx")))
    return F.array_distinct(F.array(*cells))


def nearest_neighbor(queries: DataFrame, candidates: DataFrame, q_id: str, q_lat: str, q_lon: str,
                     c_id: str, c_lat: str, c_lon: str, metric: str = "haversine",
                     start_cell_deg: float | None = None,
                     growth: float = 4.0) -> DataFrame:
    """Exact nearest candidate per query point: ``(q_id, c_id, distance)``.

    Level k uses cells of ``start_cell_deg * growth**k`` degrees; by default
    the first cell is the mean spacing of the candidates (sqrt(sphere area /
    count)), so a cell holds about one candidate whatever the data size.  A query is
    settled when its best candidate in the 3x3 neighbourhood is closer than
    the guaranteed search radius of that level; the rest move to the next
    level.  That radius comes from the query's own latitude: a candidate outside
    the neighbourhood is at least one cell away in latitude, or lies beyond the
    meridian one cell to the east or west, whose distance is
    asin(cos(lat) * sin(cell)).  So a query near a pole widens its own search
    only.  At 360-degree cells every candidate is a neighbour, so the loop
    always ends.  Ties: smallest candidate id."""
    ensure_checkpoint_dir(queries.sparkSession)
    dist_fn = haversine_km if metric == "haversine" else planar_distance
    if start_cell_deg is None:
        n_cand = candidates.count()
        start_cell_deg = min(360.0, max(1e-4, math.sqrt(360.0 * 180.0 / max(n_cand, 1))))
    q = queries.select(F.col(q_id).alias("_qid"), F.col(q_lat).alias("_qlat"), F.col(q_lon).alias("_qlon"))
    c = candidates.select(F.col(c_id).alias("_cid"), F.col(c_lat).alias("_clat"), F.col(c_lon).alias("_clon"))
    results = []
    cell = start_cell_deg
    pending = q
    while True:
        final = cell >= 360.0
        radius = F.lit(cell)
        if metric == "haversine":
            beyond = F.asin(F.cos(F.radians(F.col("_qlat"))) * math.sin(math.radians(min(cell, 90.0))))
            radius = F.least(F.lit(cell * KM_PER_DEG), F.lit(EARTH_RADIUS_KM) * beyond) - 1e-9
        cy, cx = _cell_cols(F.col("_qlat"), F.col("_qlon"), cell)
        qx = pending.select("*", F.explode(_neighbour_cells(cy, cx, cell)).alias("_cell"))
        ccy, ccx = _cell_cols(F.col("_clat"), F.col("_clon"), cell)
        cc = c.select("*", F.struct(ccy.alias("cy"), ccx.alias("cx")).alias("_cell"))
        pairs = qx.join(cc, "_cell").withColumn("_d", dist_fn("_qlat", "_qlon", "_clat", "_clon"))
        best = pairs.groupBy("_qid").agg(F.min_by(F.struct("_d", "_cid"), F.struct("_d", "_cid")).alias("_b"))
        # every pending query with its best candidate so far (none when no
        # candidate is near), settled or not: one job, checkpointed to the
        # shared folder so neither the output nor the next level recomputes it
        lab = pending.join(best, "_qid", "left").withColumn(
            "_ok", F.lit(final) | F.coalesce(F.col("_b._d") <= radius, F.lit(False))).checkpoint(eager=True)
        results.append(lab.filter("_ok").select("_qid", F.col("_b._cid").alias("_cid"), F.col("_b._d").alias("_d"))
                          .filter(F.col("_cid").isNotNull()))
        if final:
            break
        pending = lab.filter(~F.col("_ok")).select("_qid", "_qlat", "_qlon")
        if pending.isEmpty():
            break
        cell = min(cell * growth, 360.0)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.col("_qid").alias(q_id), F.col("_cid").alias(c_id), F.col("_d").alias("distance"))


def _band_cells(cy: Column, side: float) -> Column:
    """Longitude cells of a latitude band, about as wide as the band is high at its poles-most edge,
    so that 360 degrees are always a whole number of cells."""
    edge = F.greatest(F.abs(cy * side - 90.0), F.abs((cy + 1) * side - 90.0))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / side), F.lit(1)).cast("bigint")


def radius_join(points: DataFrame, centres: DataFrame, p_lat: str, p_lon: str, c_lat: str, c_lon: str,
                radius_km: float) -> DataFrame:
    """All (point, centre) pairs within ``radius_km`` (haversine), anywhere on the sphere.

    Latitude bands are as high as the radius; each band has its own whole number of longitude cells.
    A centre is copied into every cell that its circle's bounding box touches (computed from the
    centre's own latitude; all cells of a band if the circle holds a pole), a point keeps one cell.
    The equi-join on the cell forms only nearby candidates and the exact distance finishes it."""
    side = min(radius_km / KM_PER_DEG, 180.0)
    reach = radius_km / KM_PER_DEG
    last = int(math.floor(180.0 / side))

    def column_of(lon: Column, n: Column) -> Column:
        return F.floor((lon + 180.0) / 360.0 * n).cast("bigint")

    pcy = F.floor((F.col(p_lat) + 90.0) / side).cast("bigint")
    pn = _band_cells(pcy, side)
    p = points.withColumn("_cell", F.struct(pcy.alias("cy"), F.pmod(column_of(F.col(p_lon), pn), pn).alias("cx")))

    lat, lon = F.col(c_lat), F.col(c_lon)
    ratio = F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(lat))
    width = F.when((F.abs(lat) + reach >= 90.0) | (ratio >= 1.0), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + 1e-9)
    row = F.floor((lat + 90.0) / side).cast("bigint")
    c = centres.withColumn("_w", width).withColumn("_cy", F.explode(F.sequence(
        F.greatest(row - 1, F.lit(0)), F.least(row + 1, F.lit(last)))))
    n = _band_cells(F.col("_cy"), side)
    low, high = column_of(lon - F.col("_w"), n), column_of(lon + F.col("_w"), n)
    columns = F.when(high - low + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.sequence(low, high))
    cells = F.transform(columns, lambda x: F.struct(F.col("_cy").alias("cy"), F.pmod(x, n).alias("cx")))
    c = c.withColumn("_cell", F.explode(F.array_distinct(cells))).drop("_w", "_cy")
    j = p.join(c, "_cell").filter(F.abs(F.col(p_lat) - F.col(c_lat)) <= reach + 1e-9)  # cheap box test before trig
    return j.withColumn("distance_km", haversine_km(p_lat, p_lon, c_lat, c_lon)).filter(
        F.col("distance_km") <= radius_km).drop("_cell")


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], value: str, default=None,
           out: str | None = None) -> DataFrame:
    """Left join to a lookup table of any size with a default for missing keys (JN10); Spark broadcasts
    it only when its size allows."""
    t = table.select(*on, F.col(value).alias("_v"))
    j = df.join(t, list(on), "left")
    v = F.coalesce(F.col("_v"), F.lit(default)) if default is not None else F.col("_v")
    return j.withColumn(out or value, v).drop("_v")


def zip_lists(df: DataFrame, arrays: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Positional zip of parallel arrays into rows with their position (JN11)."""
    z = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(*keep, F.posexplode(z).alias("pos", "_z")).select(*keep, "pos", *[F.col(f"_z.{n}").alias(n) for n in arrays])


def split_by_grants(events: DataFrame, grants: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted (``left_semi``) and rejected (``left_anti``) events against a grants table (JN12)."""
    return events.join(grants, list(on), "left_semi"), events.join(grants, list(on), "left_anti")
