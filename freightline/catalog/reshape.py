"""Aggregation, reshaping, ordering and set queries (AG, TK, ST rows)."""
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, haversine_sql
from ..functions.numeric import round_half_up
from ..operators import aggregates as ag
from ..operators import ordering as od
from ..operators.quality import duplicate_keys
from ..sources.tables import table
from ..sources.views import places, view, view_sql
from . import register
from .demand import _DAILY_SQL, daily_demand
from .joins import _CUST_PTS_SQL, _SUPP_PTS_SQL, customer_points, supplier_points

R4 = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"


@register("ag2_group_by_key_and_day", view_sql("damage") + "SELECT zip_code, day, round(daily_damage, 4) AS daily_damage FROM damage")
def q_ag2(spark, sf):
    d = view(spark, sf, "damage")
    return d.select("zip_code", F.col("day").cast("timestamp_ntz").alias("day"), F.round("daily_damage", 4).alias("daily_damage"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("ag3_pivot_long_to_wide", """
WITH longf AS (SELECT CAST(ts AS DATE) AS ds, event_type AS datatype, sum(value) AS value FROM events GROUP BY 1, 2)
SELECT ds, """ + ", ".join(f"round(max(CASE WHEN datatype = '{t}' THEN value END), 4) AS {t}" for t in _TYPES) + """
FROM longf GROUP BY ds""")
def q_ag3(spark, sf):
    ev = table(spark, sf, "events")
    longf = ev.groupBy(F.to_date("ts").alias("ds"), F.col("event_type").alias("datatype")).agg(F.sum("value").alias("value"))
    # a duplicate (ds, datatype) would make the pivot ambiguous: the reference raises; we fail the job
    dups = duplicate_keys(longf, ["ds", "datatype"])
    if not dups.isEmpty():
        raise ValueError("Index contains duplicate entries, cannot reshape")
    wide = ag.pivot_exact(longf, ["ds"], "datatype", "value", _TYPES)
    return wide.select("ds", *[F.round(t, 4).alias(t) for t in _TYPES])


_FLAGS = ["A", "N", "R"]


@register("ag4_pivot_mean", view_sql("shipments") + """
SELECT origin_nation AS country, CAST(year(ship_date) AS BIGINT) AS year, """ +
          ", ".join(R4.format(f"avg(CASE WHEN return_flag = '{f}' THEN value END)") + f" AS {f}" for f in _FLAGS) + """
FROM shipments GROUP BY 1, 2""")
def q_ag4(spark, sf):
    sh = view(spark, sf, "shipments").select(F.col("origin_nation").alias("country"),
                                             F.year("ship_date").cast("bigint").alias("year"), "return_flag", "value")
    w = ag.pivot_mean(sh, ["country", "year"], "return_flag", "value", _FLAGS)
    return w.select("country", "year", *[round_half_up(f, 4).alias(f) for f in _FLAGS])


@register("ag5_relative_frequency_percent", view_sql("shipments") + """
SELECT segment, CAST(count(*) AS BIGINT) AS n, """ + R4.format("count(*) * 100.0 / (SELECT count(*) FROM shipments)") + """ AS pct
FROM shipments GROUP BY 1""")
def q_ag5(spark, sf):
    sh = view(spark, sf, "shipments").select("segment")
    r = ag.relative_frequency(sh, "segment").orderBy(F.col("pct").desc())
    return r.select("segment", "n", round_half_up("pct", 4).alias("pct"))


@register("ag12_route_distance_consecutive", view_sql("places") + "," + _SUPP_PTS_SQL + f""",
pts AS (SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.lat, s.lon FROM lineitem l JOIN spts s ON l.l_suppkey = s.s_suppkey),
seg AS (SELECT l_orderkey, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lat, lon FROM pts
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, lat, lon))
SELECT l_orderkey AS order_key, round(coalesce(sum({haversine_sql('plat', 'plon', 'lat', 'lon')}), 0), 4) AS route_km
FROM seg GROUP BY 1""")
def q_ag12(spark, sf):
    """Route through the suppliers of an order's lines, in line order: sum of
    consecutive great-circle legs; fewer than two points gives 0."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    sp = supplier_points(spark, sf).select("s_suppkey", "lat", "lon")
    j = li.join(sp, li.l_suppkey == sp.s_suppkey)
    pts = j.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "lat", "lon"))).alias("p"))
    legs = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))),
                      lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]))
    total = F.when(F.size("p") < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x))
    return pts.select("order_key", F.round(total, 4).alias("route_km"))


@register("ag13_cargo_weight", """
SELECT l.l_orderkey AS order_key, round(sum(p.p_size * l.l_quantity), 4) AS cargo_kg
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def q_ag13(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    items = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.collect_list(F.struct(F.col("p_size").cast("double").alias("weight"), F.col("l_quantity").alias("quantity"))).alias("items"))
    w = F.aggregate("items", F.lit(0.0), lambda a, i: a + i["weight"] * i["quantity"])
    return items.select("order_key", F.round(w, 4).alias("cargo_kg"))


@register("ag15_alert_summary_per_day", view_sql("damage") + """
SELECT CAST(day AS DATE) AS ds, CAST(count(*) AS BIGINT) AS n_high_risk,
       array_to_string(list_sort(list(CAST(zip_code AS VARCHAR))), ',') AS locations
FROM damage WHERE daily_damage > 300 GROUP BY 1""")
def q_ag15(spark, sf):
    d = view(spark, sf, "damage").filter(F.col("daily_damage") > 300)
    g = d.groupBy(F.to_date("day").alias("ds")).agg(F.count(F.lit(1)).alias("n_high_risk"),
                                                    F.array_sort(F.collect_list(F.col("zip_code").cast("string"))).alias("l"))
    return g.select("ds", "n_high_risk", F.array_join("l", ",").alias("locations"))


@register("ag18_centroid_per_nation", view_sql("places") + "," + _CUST_PTS_SQL + """
SELECT c.c_nationkey AS nation, """ + R4.format("avg(p.lat)") + " AS lat, " + R4.format("avg(p.lon)") + """ AS lon
FROM cpts p JOIN customer c ON p.c_custkey = c.c_custkey GROUP BY 1""")
def q_ag18(spark, sf):
    pts = customer_points(spark, sf)
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    g = pts.join(c, "c_custkey").groupBy("nation").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return g.select("nation", round_half_up("lat", 4).alias("lat"), round_half_up("lon", 4).alias("lon"))


@register("ag19_value_per_region", view_sql("shipments") + """
SELECT n.n_regionkey AS region_key, round(sum(s.value), 2) AS total_value
FROM shipments s JOIN nation n ON s.dest_nation = n.n_nationkey GROUP BY 1""")
def q_ag19(spark, sf):
    sh = view(spark, sf, "shipments").select("dest_nation", "value")
    n = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("dest_nation"),
                                                      F.col("n_regionkey").alias("region_key")))
    return sh.join(n, "dest_nation").groupBy("region_key").agg(F.round(F.sum("value"), 2).alias("total_value"))


@register("ag20_distinct_ids", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def q_ag20(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@register("tk3_top3_days_per_series", _DAILY_SQL + """
SELECT series_id, ds, round(y, 4) AS y, rank FROM (
  SELECT series_id, ds, y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY y DESC, ds) AS INTEGER) AS rank FROM daily)
WHERE rank <= 3""")
def q_tk3(spark, sf):
    d = daily_demand(spark, sf)
    r = od.top_k_per_group(d, ["series_id"], [F.col("y").desc(), F.col("ds")], 3)
    return r.select("series_id", "ds", F.round("y", 4).alias("y"), "rank")


@register("tk4_alternatives_after_best", _DAILY_SQL + """
SELECT series_id, ds, round(y, 4) AS y, rank FROM (
  SELECT series_id, ds, y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY y DESC, ds) AS INTEGER) AS rank FROM daily)
WHERE rank BETWEEN 2 AND 4""")
def q_tk4(spark, sf):
    d = daily_demand(spark, sf)
    r = od.top_k_per_group(d, ["series_id"], [F.col("y").desc(), F.col("ds")], 3, start=2)
    return r.select("series_id", "ds", F.round("y", 4).alias("y"), "rank")


@register("tk5_paging", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 50 OFFSET 100""")
def q_tk5(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                                             "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return od.page(li, [F.col(c) for c in li.columns], page_no=3, page_size=50)


@register("tk6_latest_1000_calculations", """
SELECT event_id, ts, value FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 30 DAY
ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def q_tk6(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    return od.latest_n(od.newer_than(ev, "ts", "2024-01-31", 30), "ts", 1000, ["event_id"])


@register("st1_union_locations", view_sql("places") + "," + _CUST_PTS_SQL + "," + _SUPP_PTS_SQL + """
SELECT 'customer' AS kind, c_custkey AS id, round(lat, 4) AS lat, round(lon, 4) AS lon, NULL::DOUBLE AS acctbal FROM cpts
UNION ALL SELECT 'supplier', s_suppkey, round(lat, 4), round(lon, 4), s_acctbal FROM spts""")
def q_st1(spark, sf):
    c = customer_points(spark, sf).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), "lat", "lon")
    s = supplier_points(spark, sf).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), "lat", "lon",
                                          F.col("s_acctbal").alias("acctbal"))
    u = od.union_all([c, s])
    return u.select("kind", "id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "acctbal")
