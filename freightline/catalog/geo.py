"""Geo and scalar-function queries (FN8-FN13, FN15-FN17, GN8, GN9, GN12, SRC10)."""
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..functions.numeric import round_half_up
from ..operators.cleaning import title_from_snake
from ..operators.quality import valid_coordinates
from ..plans import network as nw
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register
from .joins import _CUST_PTS_SQL, customer_points

R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"


@register("fn8_haversine_leg_distance", view_sql("places") + "," + _CUST_PTS_SQL + f"""
SELECT c.c_custkey, {R.format(geo.haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon'))} AS km_to_nation_centre
FROM cpts c JOIN customer cu ON c.c_custkey = cu.c_custkey JOIN places p ON cu.c_nationkey = p.place_id""")
def q_fn8(spark, sf):
    c = customer_points(spark, sf)
    cu = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("place_id"))
    p = F.broadcast(view(spark, sf, "places").select("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon")))
    j = c.join(cu, "c_custkey").join(p, "place_id")
    return j.select("c_custkey", round_half_up(geo.haversine_km("lat", "lon", "plat", "plon"), 4).alias("km_to_nation_centre"))


@register("fn9_geohash", view_sql("places") + "," + _CUST_PTS_SQL + f"""
SELECT c_custkey, {geo.geohash_sql('lat', 'lon', 9)} AS geohash9, {geo.geohash_sql('lat', 'lon', 5)} AS geohash5 FROM cpts""")
def q_fn9(spark, sf):
    c = customer_points(spark, sf)
    return c.select("c_custkey", geo.geohash("lat", "lon", 9).alias("geohash9"), geo.geohash("lat", "lon", 5).alias("geohash5"))


@register("fn10_gn12_geojson_points", view_sql("places") + "," + _CUST_PTS_SQL + f"""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {R.format('lat')} END AS lat,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {R.format('lon')} END AS lon,
  CASE WHEN c_custkey % 10 = 0 THEN 'Only Point geometry is supported' END AS error,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 END AS valid FROM cpts""")
def q_fn10(spark, sf):
    """GeoJSON text built per customer (every tenth is a LineString), parsed
    back to (lat, lon) with a reject reason, then checked as a point (GN12)."""
    c = customer_points(spark, sf)
    pt = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat"), F.array("lon", "lat")).alias("coordinates")))
    g = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, line).otherwise(pt).alias("geojson"))
    p = g.select("c_custkey", geo.parse_geojson_point("geojson").alias("p"))
    return p.select("c_custkey", round_half_up("p.lat", 4).alias("lat"), round_half_up("p.lon", 4).alias("lon"),
                    F.col("p.error").alias("error"),
                    F.when(F.col("p.error").isNull(), valid_coordinates("p.lat", "p.lon")).alias("valid"))


@register("fn11_request_dedup", view_sql("legs") + """
SELECT origin_nation, dest_nation, vehicle_type, CAST(count(*) AS BIGINT) AS n_requests FROM legs GROUP BY 1, 2, 3""")
def q_fn11(spark, sf):
    """Identical routing requests share one key (xxhash64 of the sorted
    parameters) and are counted once per key."""
    lg = view(spark, sf, "legs").select("origin_nation", "dest_nation", "vehicle_type")
    k = lg.withColumn("request_key", tx.request_key(["origin_nation", "dest_nation", "vehicle_type"]))
    g = k.groupBy("request_key").agg(F.first("origin_nation").alias("origin_nation"), F.first("dest_nation").alias("dest_nation"),
                                     F.first("vehicle_type").alias("vehicle_type"), F.count(F.lit(1)).alias("n_requests"))
    return g.drop("request_key")


RECORD_HASH_SQL = """sha256('{"seq":' || seq || ',"shipment_id":' || shipment_id || ',"status":"' || status || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","value":' || CAST(value AS VARCHAR) || '}')"""


@register("fn12_record_hash", view_sql("ledger") + "SELECT seq, " + RECORD_HASH_SQL + " AS record_hash FROM ledger")
def q_fn12(spark, sf):
    lg = view(spark, sf, "ledger")
    return lg.select("seq", tx.record_hash(["shipment_id", "seq", "status", "value", "ts"]).alias("record_hash"))


@register("fn13_protect_recover_roundtrip", "SELECT c_custkey, c_name AS recovered FROM customer")
def q_fn13(spark, sf):
    """Encrypt a sensitive column (AES-GCM, random IV) and decrypt it again.
    The key is a per-job random value; only the round trip is observable."""
    import os
    key = F.lit(os.urandom(16))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    enc = c.withColumn("protected", tx.protect("c_name", key))
    return enc.select("c_custkey", tx.recover("protected", key).alias("recovered"))


@register("fn15_interaction_term", view_sql("shipments") + f"""
SELECT order_key, line_no, {R.format('value / quantity * weight')} AS price_x_weight FROM shipments""")
def q_fn15(spark, sf):
    sh = view(spark, sf, "shipments")
    return sh.select("order_key", "line_no", round_half_up((F.col("value") / F.col("quantity")) * F.col("weight"), 4).alias("price_x_weight"))


_KINDS = ["cold_storage", "cross_dock", "bonded_warehouse", "distribution_centre"]


@register("fn16_src12_title_case_labels", """
SELECT s_suppkey, array_to_string(list_transform(string_split(['cold_storage', 'cross_dock', 'bonded_warehouse', 'distribution_centre'][s_suppkey % 4 + 1], '_'),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, coalesce(CAST(NULLIF(s_suppkey % 3, 0) AS DOUBLE) * 50000.0, 100000.0) AS capacity_sqft FROM supplier""")
def q_fn16(spark, sf):
    """Warehouse marker rows: type label title-cased from snake case, with a
    default capacity where missing (SRC12)."""
    s = table(spark, sf, "supplier")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    cap = F.coalesce(F.nullif(F.col("s_suppkey") % 3, F.lit(0)).cast("double") * 50000.0, F.lit(100000.0))
    return s.select("s_suppkey", title_from_snake(kind).alias("label"), cap.alias("capacity_sqft"))


@register("fn17_rounding_half_up", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(round(CAST(CAST(l_extendedprice * l_discount AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS disc_amount,
  CAST(round(CAST(CAST(l_quantity * 0.125 AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS q_eighths FROM lineitem""")
def q_fn17(spark, sf):
    """Rounding follows Spark: half-up on the shortest decimal text of the
    double (2.675 -> 2.68, 0.125 -> 0.13), which the oracle reproduces by
    rounding the double's text form as a DECIMAL."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                     F.round(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("disc_amount"),
                     F.round(F.col("l_quantity") * 0.125, 2).alias("q_eighths"))


_CLUSTER_SQL = view_sql("places") + "," + _CUST_PTS_SQL + ",\n" + """e AS (SELECT a.c_custkey AS src, b.c_custkey AS dst FROM cpts a JOIN cpts b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) <= 0.5 WHERE {HAV} <= 50.0),
l0 AS (SELECT c_custkey AS node, c_custkey AS label FROM cpts),
l1 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l0 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l0 n ON n.node = e.src GROUP BY l.node, l.label),
l2 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l1 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l1 n ON n.node = e.src GROUP BY l.node, l.label),
l3 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l2 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l2 n ON n.node = e.src GROUP BY l.node, l.label),
l4 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l3 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l3 n ON n.node = e.src GROUP BY l.node, l.label),
l5 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l4 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l4 n ON n.node = e.src GROUP BY l.node, l.label),
l6 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l5 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l5 n ON n.node = e.src GROUP BY l.node, l.label),
l7 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l6 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l6 n ON n.node = e.src GROUP BY l.node, l.label),
l8 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l7 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l7 n ON n.node = e.src GROUP BY l.node, l.label),
l9 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l8 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l8 n ON n.node = e.src GROUP BY l.node, l.label),
l10 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l9 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l9 n ON n.node = e.src GROUP BY l.node, l.label),
l11 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l10 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l10 n ON n.node = e.src GROUP BY l.node, l.label),
l12 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l11 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l11 n ON n.node = e.src GROUP BY l.node, l.label),
l13 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l12 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l12 n ON n.node = e.src GROUP BY l.node, l.label),
l14 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l13 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l13 n ON n.node = e.src GROUP BY l.node, l.label),
l15 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l14 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l14 n ON n.node = e.src GROUP BY l.node, l.label),
l16 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l15 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l15 n ON n.node = e.src GROUP BY l.node, l.label),
l17 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l16 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l16 n ON n.node = e.src GROUP BY l.node, l.label),
l18 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l17 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l17 n ON n.node = e.src GROUP BY l.node, l.label),
l19 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l18 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l18 n ON n.node = e.src GROUP BY l.node, l.label),
l20 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l19 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l19 n ON n.node = e.src GROUP BY l.node, l.label),
l21 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l20 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l20 n ON n.node = e.src GROUP BY l.node, l.label),
l22 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l21 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l21 n ON n.node = e.src GROUP BY l.node, l.label),
l23 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l22 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l22 n ON n.node = e.src GROUP BY l.node, l.label),
l24 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l23 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l23 n ON n.node = e.src GROUP BY l.node, l.label),
l25 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l24 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l24 n ON n.node = e.src GROUP BY l.node, l.label),
l26 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l25 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l25 n ON n.node = e.src GROUP BY l.node, l.label),
l27 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l26 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l26 n ON n.node = e.src GROUP BY l.node, l.label),
l28 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l27 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l27 n ON n.node = e.src GROUP BY l.node, l.label),
l29 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l28 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l28 n ON n.node = e.src GROUP BY l.node, l.label),
l30 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l29 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l29 n ON n.node = e.src GROUP BY l.node, l.label),
l31 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l30 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l30 n ON n.node = e.src GROUP BY l.node, l.label),
l32 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l31 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l31 n ON n.node = e.src GROUP BY l.node, l.label),
l33 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l32 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l32 n ON n.node = e.src GROUP BY l.node, l.label),
l34 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l33 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l33 n ON n.node = e.src GROUP BY l.node, l.label),
l35 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l34 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l34 n ON n.node = e.src GROUP BY l.node, l.label),
l36 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l35 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l35 n ON n.node = e.src GROUP BY l.node, l.label),
l37 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l36 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l36 n ON n.node = e.src GROUP BY l.node, l.label),
l38 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l37 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l37 n ON n.node = e.src GROUP BY l.node, l.label),
l39 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l38 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l38 n ON n.node = e.src GROUP BY l.node, l.label),
l40 AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l39 l LEFT JOIN e ON e.dst = l.node LEFT JOIN l39 n ON n.node = e.src GROUP BY l.node, l.label)""".replace(
    "{HAV}", geo.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")) + """
SELECT node AS c_custkey, label AS cluster FROM l40"""


@register("gn8_delivery_clusters_eps50km", _CLUSTER_SQL)
def q_gn8(spark, sf):
    """DBSCAN (min_samples=1, haversine, eps 50 km) over all customer points."""
    c = customer_points(spark, sf)
    return nw.eps_clusters(c, "c_custkey", "lat", "lon", 50.0)


@register("gn9_cluster_geometric_medians")
def q_gn9(spark, sf):
    c = customer_points(spark, sf)
    cl = nw.eps_clusters(c, "c_custkey", "lat", "lon", 50.0)
    return nw.geometric_medians(c.join(cl, "c_custkey"), "cluster")
