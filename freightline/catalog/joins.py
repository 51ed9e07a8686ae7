"""Join queries (JN rows)."""
from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..functions.numeric import round_half_up
from ..operators import joins as jn
from ..sources.tables import table
from ..sources.views import places, view, view_sql
from . import register
from .demand import _DAILY_SQL, daily_demand

# --------------------------------------------------------------- point sets

_CUST_PTS_SQL = """
cpts AS (SELECT c.c_custkey, p.lat + ((c.c_custkey % 97) - 48) / 100.0 AS lat,
                p.lon + ((c.c_custkey * 7 % 89) - 44) / 100.0 AS lon
         FROM customer c JOIN places p ON c.c_nationkey = p.place_id)"""
_SUPP_PTS_SQL = """
spts AS (SELECT s.s_suppkey, s.s_acctbal, p.lat + ((s.s_suppkey % 53) - 26) / 50.0 AS lat,
                p.lon + ((s.s_suppkey * 3 % 61) - 30) / 50.0 AS lon
         FROM supplier s JOIN places p ON s.s_nationkey = p.place_id)"""


def customer_points(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    p = F.broadcast(places(spark, sf))
    j = c.join(p, c.c_nationkey == p.place_id)
    return j.select("c_custkey", (F.col("lat") + ((F.col("c_custkey") % 97) - 48) / 100.0).alias("lat"),
                    (F.col("lon") + ((F.col("c_custkey") * 7 % 89) - 44) / 100.0).alias("lon"))


def supplier_points(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    p = F.broadcast(places(spark, sf))
    j = s.join(p, s.s_nationkey == p.place_id)
    return j.select("s_suppkey", "s_acctbal", (F.col("lat") + ((F.col("s_suppkey") % 53) - 26) / 50.0).alias("lat"),
                    (F.col("lon") + ((F.col("s_suppkey") * 3 % 61) - 30) / 50.0).alias("lon"))


# ------------------------------------------------------------------ queries

_WEATHER_SQL = """,
weather AS (SELECT CAST(o_orderdate AS DATE) AS ds, CAST(count(*) AS BIGINT) AS n_orders,
                   sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100.0 AS avg_price FROM orders GROUP BY 1)
"""


def _weather(spark, sf):
    o = table(spark, sf, "orders")
    # exact mean: integer cents summed, one division (order-independent)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.groupBy(F.to_date("o_orderdate").alias("ds")).agg(
        F.count(F.lit(1)).alias("n_orders"), (F.sum(cents) / F.count(F.lit(1)) / 100.0).alias("avg_price"))


@register("jn1_left_join_on_date", _DAILY_SQL + _WEATHER_SQL + """
SELECT d.series_id, d.ds, round(d.y, 4) AS y, w.n_orders, CAST(round(CAST(w.avg_price AS DECIMAL(38,8)), 4) AS DOUBLE) AS avg_price
FROM daily d LEFT JOIN weather w ON d.ds = w.ds""")
def q_jn1(spark, sf):
    j = daily_demand(spark, sf).join(_weather(spark, sf), "ds", "left")
    return j.select("series_id", "ds", F.round("y", 4).alias("y"), "n_orders", round_half_up("avg_price", 4).alias("avg_price"))


@register("jn2_left_join_year_month", _DAILY_SQL + """,
econ AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
                avg(o_totalprice) AS gdp FROM orders GROUP BY 1, 2)
SELECT d.series_id, d.ds, round(e.gdp, 4) AS gdp FROM daily d
LEFT JOIN econ e ON year(d.ds) = e.year AND month(d.ds) = e.month""")
def q_jn2(spark, sf):
    o = table(spark, sf, "orders")
    econ = o.groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month")) \
            .agg(F.avg("o_totalprice").alias("gdp"))
    d = daily_demand(spark, sf).withColumns({"year": F.year("ds").cast("bigint"), "month": F.month("ds").cast("bigint")})
    return d.join(econ, ["year", "month"], "left").select("series_id", "ds", F.round("gdp", 4).alias("gdp"))


def naive_forecast(spark, sf, shift_days: int, name: str):
    d = daily_demand(spark, sf)
    return d.select("series_id", F.date_add("ds", shift_days).alias("ds"), F.col("y").alias(name))


@register("jn3_inner_join_truth_forecast", _DAILY_SQL + """
SELECT series_id, ds, round(max(y), 4) AS y, round(max(yhat), 4) AS yhat FROM (
  SELECT series_id, ds, y, NULL AS yhat FROM daily UNION ALL SELECT series_id, ds + 7, NULL, y FROM daily)
GROUP BY 1, 2 HAVING count(y) > 0 AND count(yhat) > 0""")
def q_jn3(spark, sf):
    t = daily_demand(spark, sf)
    f = naive_forecast(spark, sf, 7, "yhat")
    return t.join(f, ["series_id", "ds"]).select("series_id", "ds", F.round("y", 4).alias("y"), F.round("yhat", 4).alias("yhat"))


@register("jn4_full_outer_forecasts_ensemble", _DAILY_SQL + """,
fab AS (SELECT series_id, ds, max(f7) AS f7, max(f14) AS f14 FROM (
  SELECT series_id, ds + 7 AS ds, y AS f7, NULL AS f14 FROM daily UNION ALL SELECT series_id, ds + 14, NULL, y FROM daily) GROUP BY 1, 2)
SELECT series_id, ds, round(f7, 4) AS f7, round(f14, 4) AS f14,
  round((coalesce(f7, 0) + coalesce(f14, 0)) / ((f7 IS NOT NULL)::INT + (f14 IS NOT NULL)::INT), 4) AS ensemble FROM fab""")
def q_jn4(spark, sf):
    from ..plans.forecast import ensemble_mean
    a = naive_forecast(spark, sf, 7, "f7")
    b = naive_forecast(spark, sf, 14, "f14")
    j = a.join(b, ["series_id", "ds"], "full")
    j = j.withColumn("ensemble", ensemble_mean(["f7", "f14"]))
    return j.select("series_id", "ds", *[F.round(c, 4).alias(c) for c in ("f7", "f14", "ensemble")])


@register("jn5_asof_join_damage", view_sql("damage") + """
SELECT p.event_id, p.user_id AS zip_code, p.ts, round(CASE WHEN p.ts - d.day <= INTERVAL 3 DAY THEN d.daily_damage END, 4) AS daily_damage,
  CASE WHEN p.ts - d.day <= INTERVAL 3 DAY THEN d.day END AS matched_day
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN damage d ON p.user_id = d.zip_code AND p.ts >= d.day""")
def q_jn5(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type") == "purchase") \
        .select("event_id", F.col("user_id").alias("zip_code"), "ts")
    dmg = view(spark, sf, "damage").withColumn("day", F.col("day").cast("timestamp_ntz"))
    r = jn.asof_join(ev, dmg, ["zip_code"], "ts", "day", 3 * 86400, ["daily_damage"])
    return r.select("event_id", "zip_code", "ts", F.round("daily_damage", 4).alias("daily_damage"),
                    F.col("matched_day").cast("timestamp_ntz").alias("matched_day"))


@register("jn6_nearest_conflict_planar", view_sql("places") + "," + _CUST_PTS_SQL + "," + _SUPP_PTS_SQL + """,
conf AS (SELECT * FROM spts WHERE s_acctbal < 0),
pairs AS (SELECT c.c_custkey, f.s_suppkey, sqrt(pow(f.lat - c.lat, 2) + pow(f.lon - c.lon, 2)) AS d FROM cpts c, conf f)
SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 4) AS distance FROM pairs GROUP BY 1""")
def q_jn6(spark, sf):
    conf = supplier_points(spark, sf).filter(F.col("s_acctbal") < 0)
    r = jn.nearest_neighbor(customer_points(spark, sf), conf, "c_custkey", "lat", "lon", "s_suppkey", "lat", "lon",
                            metric="planar")
    return r.select("c_custkey", "s_suppkey", F.round("distance", 4).alias("distance"))


@register("jn7_distance_matrix_observed_pairs", view_sql("legs") + """
SELECT DISTINCT origin_nation, dest_nation, round(distance_km, 4) AS distance_km FROM legs""")
def q_jn7(spark, sf):
    """Distance matrix entries for the (origin, destination) pairs that occur
    in shipments: an equi-join of observed pairs with the place table."""
    sh = view(spark, sf, "shipments").select("origin_nation", "dest_nation").distinct()
    p = places(spark, sf)
    o = F.broadcast(p.select(F.col("place_id").alias("origin_nation"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")))
    d = F.broadcast(p.select(F.col("place_id").alias("dest_nation"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")))
    from ..functions.geo import haversine_km
    j = sh.join(o, "origin_nation").join(d, "dest_nation")
    return j.select("origin_nation", "dest_nation", F.round(haversine_km("a_lat", "a_lon", "b_lat", "b_lon"), 4).alias("distance_km"))


@register("jn8_radius_join_customers_near_places", view_sql("places") + "," + _CUST_PTS_SQL + f"""
SELECT c.c_custkey, p.place_id, round({haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')}, 4) AS distance_km
FROM cpts c, places p WHERE {haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')} <= 300""")
def q_jn8(spark, sf):
    pts = customer_points(spark, sf)
    ctr = places(spark, sf).select("place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    r = jn.radius_join(pts, ctr, "lat", "lon", "p_lat", "p_lon", 300.0)
    return r.select("c_custkey", "place_id", F.round("distance_km", 4).alias("distance_km"))


@register("jn9_nearest_node", view_sql("places") + "," + _SUPP_PTS_SQL + f""",
pairs AS (SELECT s.s_suppkey, p.place_id, {haversine_sql('s.lat', 's.lon', 'p.lat', 'p.lon')} AS d FROM spts s, places p)
SELECT s_suppkey, arg_min(place_id, (d, place_id)) AS place_id, round(min(d), 4) AS distance_km FROM pairs GROUP BY 1""")
def q_jn9(spark, sf):
    r = jn.nearest_neighbor(supplier_points(spark, sf), places(spark, sf), "s_suppkey", "lat", "lon",
                            "place_id", "lat", "lon", metric="haversine")
    return r.select("s_suppkey", "place_id", F.round("distance", 4).alias("distance_km"))


@register("jn11_positional_zip", view_sql("legs") + """
SELECT order_key, CAST(row_number() OVER (PARTITION BY order_key ORDER BY line_no, distance_km, load_kg, vehicle_type) - 1 AS BIGINT) AS pos,
       round(distance_km, 4) AS distance_km, vehicle_type, round(load_kg, 4) AS load_kg FROM legs""")
def q_jn11(spark, sf):
    lg = view(spark, sf, "legs")
    srt = F.array_sort(F.collect_list(F.struct("line_no", "distance_km", "load_kg", "vehicle_type")))
    per = lg.groupBy("order_key").agg(srt.alias("s"))
    per = per.select("order_key", F.col("s.distance_km").alias("dists"), F.col("s.vehicle_type").alias("vehicles"),
                     F.col("s.load_kg").alias("loads"))
    z = jn.zip_lists(per, {"distance_km": "dists", "vehicle_type": "vehicles", "load_kg": "loads"}, ["order_key"])
    return z.select("order_key", F.col("pos").cast("bigint").alias("pos"), F.round("distance_km", 4).alias("distance_km"),
                    "vehicle_type", F.round("load_kg", 4).alias("load_kg"))


_GRANTS_SQL = "grants AS (SELECT DISTINCT user_id AS actor FROM events WHERE event_type = 'signup' AND value > 250)"


@register("jn12_semi_join_accepted_events", f"WITH {_GRANTS_SQL} " + """
SELECT event_id, user_id AS actor, event_type FROM events e WHERE EXISTS (SELECT 1 FROM grants g WHERE g.actor = e.user_id)""")
def q_jn12a(spark, sf):
    return _split_events(spark, sf)[0]


@register("jn12_anti_join_rejected_events", f"WITH {_GRANTS_SQL} " + """
SELECT event_id, user_id AS actor, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM grants g WHERE g.actor = e.user_id)""")
def q_jn12b(spark, sf):
    return _split_events(spark, sf)[1]


def _split_events(spark, sf):
    ev = table(spark, sf, "events")
    grants = ev.filter((F.col("event_type") == "signup") & (F.col("value") > 250)).select(F.col("user_id").alias("actor")).distinct()
    e = ev.select("event_id", F.col("user_id").alias("actor"), "event_type")
    return jn.split_by_grants(e, grants, ["actor"])
