"""Great-circle distance, geohash, grid cells and GeoJSON point parsing as columns."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in km used by the reference's distance helpers.
EARTH_RADIUS_KM = 6371.0
# The geohash base-32 alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km; ``a`` is clamped to 1 against rounding (a null
    input stays null: ``least`` would skip it)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same formula as SQL text (valid in Spark SQL and DuckDB)."""
    a = (f"(pow(sin(radians({lat2}-{lat1})/2),2)"
         f" + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2))")
    return f"(2*{EARTH_RADIUS_KM}*asin(sqrt(CASE WHEN {a} > 1.0 THEN 1.0 ELSE {a} END)))"


def planar_distance(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees (the reference's conflict-risk metric)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def geohash(lat, lon, precision: int = 9) -> Column:
    """Geohash text built from bit interleaving, entirely in JVM expressions.

    Longitude takes the even bit positions, latitude the odd ones, five bits
    per character.  Values exactly on a cell boundary go to the upper half.
    """
    if not 1 <= precision <= 12:
        raise ValueError("geohash precision must be in 1..12")
    lat, lon = _c(lat), _c(lon)
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    lon_idx = F.least(F.floor((lon + 180.0) / 360.0 * F.lit(float(1 << nlon))), F.lit((1 << nlon) - 1))
    lat_idx = F.least(F.floor((lat + 90.0) / 180.0 * F.lit(float(1 << nlat))), F.lit((1 << nlat) - 1))
    parts = []
    for k in range(precision):
        v = None
        for j in range(5):
            g = 5 * k + j
            if g % 2 == 0:
                bit = F.shiftright(lon_idx, nlon - 1 - g // 2).bitwiseAND(1)
            else:
                bit = F.shiftright(lat_idx, nlat - 1 - g // 2).bitwiseAND(1)
            term = F.shiftleft(bit, 4 - j)
            v = term if v is None else v + term
        parts.append(F.substring(F.lit(GEOHASH_ALPHABET), (v + 1).cast("int"), 1))
    return F.concat(*parts)


def geohash_sql(lat: str, lon: str, precision: int = 9) -> str:
    """The same bit interleaving as :func:`geohash`, as SQL text (DuckDB)."""
    bits = 5 * precision
    nlon, nlat = (bits + 1) // 2, bits // 2
    lon_idx = f"least(CAST(floor(({lon} + 180.0) / 360.0 * {float(1 << nlon)}) AS BIGINT), {(1 << nlon) - 1})"
    lat_idx = f"least(CAST(floor(({lat} + 90.0) / 180.0 * {float(1 << nlat)}) AS BIGINT), {(1 << nlat) - 1})"
    chars = []
    for k in range(precision):
        terms = []
        for j in range(5):
            g = 5 * k + j
            idx, n = (lon_idx, nlon) if g % 2 == 0 else (lat_idx, nlat)
            terms.append(f"(((({idx}) >> {n - 1 - g // 2}) & 1) << {4 - j})")
        chars.append(f"substr('{GEOHASH_ALPHABET}', CAST({' + '.join(terms)} AS INTEGER) + 1, 1)")
    return "(" + " || ".join(chars) + ")"


def grid_cell(lat, lon, cell_deg: float) -> Column:
    """Integer grid cell of a point as ``struct<cy, cx>`` (equal-angle cells)."""
    lat, lon = _c(lat), _c(lon)
    return F.struct(F.floor(lat / cell_deg).alias("cy"), F.floor(lon / cell_deg).alias("cx"))


def cell_size_for_radius(radius_km: float, max_abs_lat: float = 85.0) -> float:
    """Cell width in degrees so that any point within ``radius_km`` lies in the 3x3
    neighbourhood, padded by cos(lat) at the highest latitude in the data."""
    km_per_deg = 2 * math.pi * EARTH_RADIUS_KM / 360.0
    shrink = max(math.cos(math.radians(min(max_abs_lat, 89.0))), 1e-3)
    return radius_km / (km_per_deg * shrink)


GEOJSON_POINT_SCHEMA = "type STRING, coordinates ARRAY<DOUBLE>"


def parse_geojson_point(text) -> Column:
    """GeoJSON text -> struct<lat, lon, error>; non-points and bad text give an error."""
    g = F.from_json(_c(text), GEOJSON_POINT_SCHEMA)
    ok = (g["type"] == "Point") & (F.size(g["coordinates"]) >= 2)
    return F.struct(
        F.when(ok, g["coordinates"][1]).alias("lat"),
        F.when(ok, g["coordinates"][0]).alias("lon"),
        F.when(g.isNull() | g["type"].isNull(), F.lit("Invalid GeoJSON"))
         .when(~ok, F.lit("Only Point geometry is supported")).alias("error"),
    )
