"""Map layers and exports (SRC9-SRC12): Spark writes the features as JSON lines to the shared scratch
folder, reads them back and returns their fields, so the round trip is what the SQL checks."""
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..plans import carbon as cb
from ..session import scratch_path
from ..sources import files as fs
from ..sources.views import places, view, view_sql
from . import register
from .carbon import _SPEC_SQL, leg_emissions
from .joins import _CUST_PTS_SQL, _SUPP_PTS_SQL, customer_points, supplier_points

R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"


def _round_trip(spark, features, name, schema):
    """Write a ``feature`` column as gzipped text lines and read it back with a schema."""
    path = scratch_path(spark, name)
    features.select("feature").write.mode("overwrite").text(path, compression="gzip")
    return spark.read.schema(schema).json(path)


@register("src9_emissions_export_json", _SPEC_SQL + f"""
SELECT CAST(ship_date AS TIMESTAMP) AS "timestamp", {R.format('distance_km')} AS distance, {R.format('co2_kg')} AS emissions,
  vehicle_type AS vehicle FROM em WHERE co2_kg IS NOT NULL""")
def q_src9_json(spark, sf):
    e = leg_emissions(spark, sf).filter(F.col("error").isNull()).select(
        F.col("ship_date").cast("timestamp").alias("timestamp"), F.col("distance_km").alias("distance"),
        F.col("co2_kg").alias("emissions"), F.col("vehicle_type").alias("vehicle"))
    path = scratch_path(spark, "emissions-json")
    fs.export_emissions(e, path, "json")
    back = spark.read.schema("timestamp TIMESTAMP, distance DOUBLE, emissions DOUBLE, vehicle STRING").json(path)
    return back.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), round_half_up("distance", 4).alias("distance"),
                       round_half_up("emissions", 4).alias("emissions"), "vehicle")


@register("src9_emission_errors", view_sql("legs") + """,
v AS (SELECT order_key, line_no, CASE WHEN segment = 'BUILDING' THEN 'bicycle' ELSE vehicle_type END AS vehicle FROM legs)
SELECT order_key, line_no, vehicle, CASE vehicle WHEN 'electric_truck' THEN 'Electric vehicles require fuel_efficiency specification'
  ELSE 'Unknown vehicle type ' || vehicle END AS error FROM v WHERE vehicle IN ('bicycle', 'electric_truck')""")
def q_src9_errors(spark, sf):
    """Legs that get no figure and why: unknown vehicles, electric trucks without a specification."""
    lg = view(spark, sf, "legs").withColumn("vehicle", F.when(F.col("segment") == "BUILDING", "bicycle").otherwise(F.col("vehicle_type")))
    r = cb.co2("distance_km", "vehicle", "load_kg", "empty_return", F.col("region"))
    return lg.select("order_key", "line_no", "vehicle", r["error"].alias("error")).filter("error IS NOT NULL")


@register("src10_temporal_shipment_features", view_sql("shipments", "places") + """
SELECT 'Shipment ID: ' || CAST(order_key AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) || '<br>Status: ' || return_flag AS popup,
  strftime(CAST(ship_date AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS "time",
  CASE return_flag WHEN 'N' THEN '#0066cc' WHEN 'A' THEN '#00cc00' ELSE '#ff0000' END AS color,
  round(p.lon, 4) AS lon, round(p.lat, 4) AS lat FROM shipments JOIN places p ON dest_nation = p.place_id""")
def q_src10_shipments(spark, sf):
    """One timed point per shipment line at its destination; colour by status, red where there is none."""
    p = F.broadcast(places(spark, sf).select(F.col("place_id").alias("dest_nation"), "lat", "lon"))
    popup = F.concat(F.lit("Shipment ID: "), F.concat_ws("-", "order_key", "line_no"), F.lit("<br>Status: "), F.col("return_flag"))
    x = view(spark, sf, "shipments").join(p, "dest_nation").select(
        "lat", "lon", F.col("ship_date").cast("timestamp").alias("at"), popup.alias("popup"),
        F.when(F.col("return_flag") == "N", "#0066cc").when(F.col("return_flag") == "A", "#00cc00").alias("status_color"))
    back = _round_trip(spark, fs.point_features(x, "lat", "lon", "at", "popup", "status_color"), "shipment-features",
                       "geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<time: STRING, color: STRING, popup: STRING>")
    at = F.col("geometry.coordinates")
    return back.select("properties.*", F.round(at[0], 4).alias("lon"), F.round(at[1], 4).alias("lat"))


@register("src11_optimized_route_features", view_sql("legs") + f""",
x AS (SELECT order_key, line_no, o.lon AS from_lon, o.lat AS from_lat, d.lon AS to_lon, d.lat AS to_lat, distance_km, NOT empty_return AS optimized
      FROM legs JOIN places o ON origin_nation = o.place_id JOIN places d ON dest_nation = d.place_id)
SELECT order_key, CAST(line_no AS BIGINT) AS line_no, round(from_lon, 4) AS from_lon, round(from_lat, 4) AS from_lat, round(to_lon, 4) AS to_lon, round(to_lat, 4) AS to_lat,
  {R.format('distance_km')} AS distance_km, {R.format('distance_km / 80.0')} AS eta_hours,
  {R.format('distance_km / 1.60934 / 6.5 * 3.5 + distance_km / 80.0 * 25.0')} AS cost, {R.format('distance_km * 150.0 / 1000.0')} AS carbon_footprint,
  optimized, CASE WHEN optimized THEN '#00cc00' ELSE '#ff3300' END AS color, CASE WHEN NOT optimized THEN '5' END AS dash_array FROM x""")
def q_src11_routes(spark, sf):
    """One line per leg between its two places, with distance, hours, cost and CO2; legs that come back
    empty are not optimised."""
    pl = places(spark, sf)
    ends = [F.broadcast(pl.select(F.col("place_id").alias(key), F.array("lon", "lat").alias(name)))
            for key, name in (("origin_nation", "a"), ("dest_nation", "b"))]
    cost = cb.transport_cost("distance_km", F.lit("truck"), F.lit(0.0), F.lit(25.0))["total"]
    x = view(spark, sf, "legs").join(ends[0], "origin_nation").join(ends[1], "dest_nation").select(
        "order_key", "line_no", F.array("a", "b").alias("coords"), "distance_km", (F.col("distance_km") / 80.0).alias("eta_hours"),
        cost.alias("cost"), cb.route_impact(F.col("distance_km") * 1000.0, F.lit("truck"))["co2_kg"].alias("carbon_footprint"),
        (~F.col("empty_return")).alias("optimized"))
    f = fs.optimized_route_feature(x, "coords", "optimized", ["order_key", "line_no", "distance_km", "eta_hours", "cost", "carbon_footprint"])
    back = _round_trip(spark, f, "route-features", "geometry STRUCT<coordinates: ARRAY<ARRAY<DOUBLE>>>, properties STRUCT<order_key: BIGINT, "
                       "line_no: BIGINT, distance_km: DOUBLE, eta_hours: DOUBLE, cost: DOUBLE, carbon_footprint: DOUBLE, optimized: BOOLEAN, "
                       "style: STRUCT<color: STRING, dash_array: STRING>>")
    at = F.col("geometry.coordinates")
    p = F.col("properties")
    return back.select(p["order_key"].alias("order_key"), p["line_no"].alias("line_no"), F.round(at[0][0], 4).alias("from_lon"),
                       F.round(at[0][1], 4).alias("from_lat"), F.round(at[1][0], 4).alias("to_lon"), F.round(at[1][1], 4).alias("to_lat"),
                       *(round_half_up(p[c], 4).alias(c) for c in ("distance_km", "eta_hours", "cost", "carbon_footprint")),
                       p["optimized"].alias("optimized"), p["style"]["color"].alias("color"), p["style"]["dash_array"].alias("dash_array"))


@register("src12_marker_rows", view_sql("places") + "," + _SUPP_PTS_SQL + """,
k AS (SELECT s_suppkey, lat, lon, ['cold_storage', 'hazardous', 'fulfillment', 'cross_dock'][s_suppkey % 4 + 1] AS kind,
        ['thunderstorm', 'heavy rain', 'dense fog'][s_suppkey % 3 + 1] AS conditions FROM spts)
SELECT s_suppkey, 'warehouse' AS layer, CASE kind WHEN 'cold_storage' THEN 'snowflake' WHEN 'hazardous' THEN 'radiation' WHEN 'fulfillment' THEN 'box-open' ELSE 'warehouse' END AS icon,
  CASE kind WHEN 'cold_storage' THEN 'blue' WHEN 'hazardous' THEN 'orange' WHEN 'fulfillment' THEN 'green' ELSE 'gray' END AS color,
  CASE kind WHEN 'cold_storage' THEN 'Cold Storage' WHEN 'hazardous' THEN 'Hazardous' WHEN 'fulfillment' THEN 'Fulfillment' ELSE 'Cross Dock' END AS popup,
  round(lat, 4) AS lat, round(lon, 4) AS lon FROM k
UNION ALL SELECT s_suppkey, 'weather', 'cloud-showers-heavy', 'lightgray', 'Weather Alert: ' || CASE conditions WHEN 'thunderstorm' THEN 'Thunderstorm' WHEN 'heavy rain' THEN 'Heavy Rain' ELSE 'Dense Fog' END,
  round(lat, 4), round(lon, 4) FROM k""")
def q_src12_markers(spark, sf):
    """Warehouse markers by type and the weather reports at the same sites."""
    def pick(values):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("s_suppkey") % len(values) + 1).cast("int"))
    x = supplier_points(spark, sf).withColumns({"kind": pick(["cold_storage", "hazardous", "fulfillment", "cross_dock"]),
                                                "conditions": pick(["thunderstorm", "heavy rain", "dense fog"])})
    layers = {"warehouse": fs.warehouse_marker("kind") | {"popup": F.initcap(F.translate("kind", "_", " "))},
              "weather": fs.weather_marker("conditions")}
    rows = F.array(*(F.struct(F.lit(n).alias("layer"), *(v[c].alias(c) for c in ("icon", "color", "popup"))) for n, v in layers.items()))
    return x.withColumn("m", F.explode(rows)).select("s_suppkey", "m.*", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@register("src12_risk_zone_features", view_sql("places") + "," + _CUST_PTS_SQL + """
SELECT 'zone-' || CAST(c_custkey AS VARCHAR) AS name, CAST(c_custkey % 5 AS BIGINT) AS risk_level,
  ['Flood', 'Earthquake', 'Political', 'Strike'][c_custkey % 4 + 1] || ' Risk Zone' AS layer,
  ['#0066cc', '#ff0000', '#ff9900', NULL][c_custkey % 4 + 1] AS fill_color, 5 AS corners,
  round(lon - 0.25, 4) AS west, round(lat + 0.25, 4) AS north FROM cpts""")
def q_src12_zones(spark, sf):
    """A square zone around every customer site, styled by its risk type."""
    kinds = F.array(*map(F.lit, ["flood", "earthquake", "political", "strike"]))
    corner = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    z = customer_points(spark, sf).select(
        F.concat(F.lit("zone-"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_custkey") % 5).alias("risk_level"),
        F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("risk_type"),
        F.array(*(corner(x, y) for x, y in ((-0.25, -0.25), (0.25, -0.25), (0.25, 0.25), (-0.25, 0.25), (-0.25, -0.25)))).alias("ring"))
    back = _round_trip(spark, fs.risk_zone_feature(z, "ring", "risk_type"), "risk-zones", "geometry STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, "
                       "properties STRUCT<name: STRING, risk_level: BIGINT, layer: STRING, fillColor: STRING>")
    p, ring = F.col("properties"), F.col("geometry.coordinates")[0]
    return back.select(p["name"].alias("name"), p["risk_level"].alias("risk_level"), p["layer"].alias("layer"), p["fillColor"].alias("fill_color"),
                       F.size(ring).alias("corners"), F.round(ring[3][0], 4).alias("west"), F.round(ring[3][1], 4).alias("north"))
