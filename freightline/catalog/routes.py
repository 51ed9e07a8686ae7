"""Route reply, section, cost and schedule queries (GN14-GN19, PRJ16-18, PRJ21, AG10, AG11, CB13).

Route replies are JSON documents that Spark builds from the shipment legs
(one reply per order, one section per line); the operators then parse and
flatten them exactly as they would a routing service's reply."""
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..plans import carbon as cb
from ..plans import routes as rt
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register
from .joins import customer_points, supplier_points

R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"
VEHICLE_HEIGHT = 4.2

_SECTION_SQL = view_sql("legs") + """,
sec AS (SELECT order_key, line_no AS start, distance_km * 1000.0 AS distance, distance_km / 80.0 * 3600.0 AS duration,
  CASE line_no % 4 WHEN 0 THEN 'tunnel' WHEN 1 THEN 'bridge' ELSE 'road' END AS road_type,
  CASE WHEN line_no % 3 = 0 THEN NULL ELSE CAST(30 + (line_no * 13) % 90 AS DOUBLE) END AS speed_limit,
  3.5 + (order_key % 5) * 0.25 AS height_clearance,
  CASE WHEN line_no % 2 = 0 THEN CAST(10000 + (order_key % 7) * 2000 AS DOUBLE) END AS weight_limit,
  CASE WHEN line_no % 3 = 0 THEN NULL ELSE CAST(round(CAST(value * 0.001 AS DECIMAL(38,8)), 2) AS DOUBLE) END AS toll, load_kg FROM legs)
"""


def route_replies(spark, sf):
    """One JSON routing reply per order, built from its legs."""
    lg = view(spark, sf, "legs")
    sec = F.struct(
        F.col("line_no").cast("int").alias("start"), (F.col("distance_km") * 1000.0).alias("distance"),
        (F.col("distance_km") / 80.0 * 3600.0).alias("duration"),
        F.element_at(F.array(F.lit("tunnel"), F.lit("bridge"), F.lit("road"), F.lit("road")), (F.col("line_no") % 4 + 1).cast("int")).alias("road_type"),
        F.when(F.col("line_no") % 3 == 0, F.lit(None)).otherwise((30 + (F.col("line_no") * 13) % 90).cast("double")).alias("speed_limit"),
        (3.5 + (F.col("order_key") % 5) * 0.25).alias("height_clearance"),
        F.when(F.col("line_no") % 2 == 0, (10000 + (F.col("order_key") % 7) * 2000).cast("double")).alias("weight_limit"))
    toll = F.struct(F.concat(F.lit("toll-"), F.col("line_no").cast("string")).alias("name"),
                    F.when(F.col("line_no") % 3 == 0, F.lit(None)).otherwise(round_half_up(F.col("value") * 0.001, 2)).alias("cost"))
    ins = F.struct(F.concat(F.lit("Drive to nation "), F.col("dest_nation").cast("string")).alias("text"),
                   (F.col("distance_km") * 1000.0).alias("distance"), (F.col("distance_km") / 80.0 * 3600000.0).cast("long").alias("time"))
    per = lg.groupBy("order_key").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "distance_km", "load_kg", "value", sec.alias("sec"), toll.alias("toll"),
                                             ins.alias("ins")))).alias("l"),
        F.sum("load_kg").alias("load_kg"))
    path = F.struct(F.aggregate(F.col("l"), F.lit(0.0), lambda a, x: a + x["sec"]["distance"]).alias("distance"),
                    F.aggregate(F.col("l"), F.lit(0.0), lambda a, x: a + x["sec"]["duration"] * 1000).cast("long").alias("time"),
                    F.lit("").alias("points"),
                    F.transform("l", lambda x: x["sec"]).alias("sections"),
                    F.transform("l", lambda x: x["ins"]).alias("instructions"),
                    F.transform("l", lambda x: x["toll"]).alias("tolls"))
    return per.select("order_key", "load_kg", F.to_json(F.struct(F.array(path).alias("paths"))).alias("reply"))


def sections(spark, sf):
    paths = rt.parse_reply(route_replies(spark, sf), "reply")
    return rt.flatten_sections(paths, ["order_key", "load_kg"])


@register("gn15_section_flattening_with_impact", _SECTION_SQL + f"""
SELECT order_key, start, {R.format('distance')} AS distance, road_type, {R.format('150.0 * distance / 1000.0 / 1000.0')} AS co2_kg,
  {R.format('distance / 1000.0 * 0.35')} AS fuel_liters FROM sec""")
def q_gn15(spark, sf):
    s = sections(spark, sf).withColumn("imp", cb.route_impact("distance", F.lit("truck")))
    return s.select("order_key", "start", round_half_up("distance", 4).alias("distance"), "road_type",
                    round_half_up("imp.co2_kg", 4).alias("co2_kg"), round_half_up("imp.fuel_liters", 4).alias("fuel_liters"))


@register("prj16_low_speed_sections", _SECTION_SQL + f"""
SELECT order_key, start, speed_limit, {R.format('distance')} AS distance FROM sec WHERE speed_limit IS NOT NULL AND speed_limit < 50""")
def q_prj16(spark, sf):
    s = rt.low_speed_sections(sections(spark, sf))
    return s.select("order_key", "start", "speed_limit", round_half_up("distance", 4).alias("distance"))


@register("prj17_height_restricted_structures", _SECTION_SQL + f"""
SELECT order_key, start, road_type, height_clearance FROM sec WHERE road_type IN ('tunnel', 'bridge') AND height_clearance < {VEHICLE_HEIGHT}""")
def q_prj17(spark, sf):
    return rt.height_restricted(sections(spark, sf), VEHICLE_HEIGHT).select("order_key", "start", "road_type", "height_clearance")


@register("prj18_route_validity", _SECTION_SQL + f"""
SELECT order_key, NOT coalesce(bool_or((road_type = 'tunnel' AND {VEHICLE_HEIGHT} > 4.0)
   OR (road_type = 'bridge' AND w > coalesce(weight_limit, 10000.0))), false) AS valid
FROM (SELECT s.*, sum(load_kg) OVER (PARTITION BY order_key) AS w FROM sec s) GROUP BY 1""")
def q_prj18(spark, sf):
    paths = rt.parse_reply(route_replies(spark, sf), "reply").withColumn("vh", F.lit(VEHICLE_HEIGHT))
    return rt.route_validity(paths, "vh", "load_kg").select("order_key", "valid")


@register("prj21_traffic_replan_flag", view_sql("legs") + """
SELECT DISTINCT order_key, CAST((order_key * 37) % 1200 AS DOUBLE) AS delay_s, (order_key * 37) % 1200 > 600 AS replan FROM legs""")
def q_prj21(spark, sf):
    rep = route_replies(spark, sf).select("order_key")
    traffic = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"),
                                               ((F.col("o_orderkey") * 37) % 1200).cast("double").alias("delay_s"))
    j = rep.join(traffic, "order_key")
    return j.select("order_key", "delay_s", (F.col("delay_s") > rt.REPLAN_DELAY_S).alias("replan"))


@register("ag10_toll_sum_missing_as_zero", _SECTION_SQL + "SELECT order_key, CAST(round(CAST(sum(coalesce(toll, 0.0)) AS DECIMAL(38,8)), 2) AS DOUBLE) AS toll_total FROM sec GROUP BY 1")
def q_ag10(spark, sf):
    p = rt.parse_reply(route_replies(spark, sf), "reply")
    return p.select("order_key", round_half_up(rt.toll_total("path.tolls"), 2).alias("toll_total"))


@register("ag11_shipment_total_cost", """
SELECT o_orderkey, CAST(round(CAST(o_totalprice * 0.05 AS DECIMAL(38,8)), 2) AS DECIMAL(18,2)) + CAST(round(CAST(o_totalprice * 0.01 AS DECIMAL(38,8)), 2) AS DECIMAL(18,2))
  + CAST(round(CAST(o_totalprice * 0.03 AS DECIMAL(38,8)), 2) AS DECIMAL(18,2)) + CAST(round(CAST(o_totalprice * 0.02 AS DECIMAL(38,8)), 2) AS DECIMAL(18,2)) AS total_cost FROM orders""")
def q_ag11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", *[round_half_up(F.col("o_totalprice") * r, 2).alias(n) for n, r in
                                                         (("shipping", 0.05), ("insurance", 0.01), ("duties", 0.03), ("taxes", 0.02))])
    return o.select("o_orderkey", rt.total_cost("shipping", "insurance", "duties", "taxes").cast("decimal(18,2)").alias("total_cost"))


@register("gn16_driver_schedule", _SECTION_SQL + """,
tot AS (SELECT order_key, CAST(sum(duration * 1000) AS BIGINT) / 1000.0 AS secs FROM sec GROUP BY 1),
sh AS (SELECT order_key, secs, s AS shift FROM tot, range(0, 1000) r(s) WHERE s < greatest(ceil(secs / 28800.0), 1))
SELECT order_key, CAST(shift AS INTEGER) AS shift, TIMESTAMP '2024-01-01 06:00:00' + to_seconds(shift * 32400) AS shift_start,
  CAST(floor(least(28800.0, secs - shift * 28800) / 60) AS BIGINT) AS duration_min FROM sh""")
def q_gn16(spark, sf):
    p = rt.parse_reply(route_replies(spark, sf), "reply").select("order_key", F.col("path.time").alias("total_ms"),
                                                                 F.lit("2024-01-01 06:00:00").cast("timestamp_ntz").alias("start"))
    s = rt.driver_schedule(p, "total_ms", "start")
    return s.select("order_key", F.col("shift").cast("int").alias("shift"), F.col("shift_start").cast("timestamp_ntz").alias("shift_start"),
                    "duration_min")


@register("gn17_wn13_checkpoint_etas", _SECTION_SQL + """
SELECT order_key, start, CAST(s_no AS INTEGER) AS checkpoint, TIMESTAMP '2024-01-01 06:00:00' + to_seconds(CAST(floor(cum) AS BIGINT)) AS eta FROM (
  SELECT order_key, start, row_number() OVER w - 1 AS s_no, sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sec WINDOW w AS (PARTITION BY order_key ORDER BY start, distance, load_kg, toll))""")
def q_gn17(spark, sf):
    """Dispatch checkpoints: cumulative ETA after each section from a planned departure."""
    rep = route_replies(spark, sf)
    p = rt.parse_reply(rep, "reply")
    x = p.select("order_key", F.posexplode("path.sections").alias("checkpoint", "s"))
    from pyspark.sql import Window
    w = Window.partitionBy("order_key").orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("cum", F.sum("s.duration").over(w))
    eta = F.lit("2024-01-01 06:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor("cum").cast("decimal(18,6)"))
    return x.select("order_key", F.col("s.start").alias("start"), F.col("checkpoint").cast("int").alias("checkpoint"), eta.cast("timestamp_ntz").alias("eta"))


@register("gn17_dispatch_payload", _SECTION_SQL + f""",
tot AS (SELECT order_key, sum(distance) AS distance, floor(sum(duration)) AS secs, count(*) AS stops FROM sec GROUP BY 1),
o AS (SELECT tot.*, CASE o_orderkey % 3 WHEN 0 THEN 'truck' WHEN 1 THEN 'van' ELSE 'car' END AS vehicle,
        'driver-' || CAST(o_custkey % 200 AS VARCHAR) AS driver, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 6 HOUR AS departure
      FROM tot JOIN orders ON order_key = o_orderkey),
i AS (SELECT *, CASE vehicle WHEN 'truck' THEN 150.0 WHEN 'van' THEN 120.0 ELSE 100.0 END * distance / 1000.0 / 1000.0 AS co2_kg FROM o)
SELECT CAST(order_key AS VARCHAR) AS shipment_id, 'route-' || CAST(order_key AS VARCHAR) || '-0' AS route_id, driver, vehicle,
  departure AS planned_departure, departure + to_seconds(CAST(secs AS BIGINT)) AS estimated_arrival, CAST(stops AS INTEGER) AS checkpoints,
  departure + to_seconds(CAST(secs AS BIGINT)) AS last_checkpoint_eta, {R.format('co2_kg')} AS co2_kg,
  {R.format('greatest(0.0, 100 - co2_kg * 10)')} AS eco_score,
  NOT (distance > 0 AND co2_kg * 1000.0 / (distance / 1000.0) > 150 OR distance / 1000.0 * 1.2 > 75) AS passed FROM i""")
def q_gn17_payload(spark, sf):
    """Hand-over record of every order's route: departure, arrival, checkpoints, impact, compliance."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.element_at(F.array(F.lit("truck"), F.lit("van"), F.lit("car")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("vehicle"),
        F.concat(F.lit("driver-"), (F.col("o_custkey") % 200).cast("string")).alias("driver"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")).alias("departure"))
    p = rt.parse_reply(route_replies(spark, sf), "reply").join(o, "order_key")
    x = rt.dispatch_payload(p, "order_key", "driver", "vehicle", "departure").select("payload.*")
    return x.select("shipment_id", "route_id", "driver", "vehicle", F.col("planned_departure").cast("timestamp_ntz").alias("planned_departure"),
                    F.col("estimated_arrival").cast("timestamp_ntz").alias("estimated_arrival"), F.size("checkpoints").alias("checkpoints"),
                    F.element_at("checkpoints", -1)["eta"].cast("timestamp_ntz").alias("last_checkpoint_eta"),
                    round_half_up("environmental_impact.co2_kg", 4).alias("co2_kg"),
                    round_half_up("environmental_impact.eco_score", 4).alias("eco_score"), "compliance_status.passed")


# rank, share of the distance, km/h, tolls paid, profile: a direct toll road, a toll-free detour, a scenic road
_ALTERNATIVES = [(0, 1.0, 80.0, True, "truck"), (1, 1.12, 70.0, False, "truck"), (2, 1.05, 60.0, True, "van")]


@register("cb13_route_comparison", _SECTION_SQL + f""",
b AS (SELECT order_key, sum(distance) AS m, sum(coalesce(toll, 0.0)) AS tolls FROM sec GROUP BY 1),
alt(rank, share, kph, pays, profile) AS (VALUES {', '.join(f"({r}, {s}, {k}, {str(t).lower()}, '{p}')" for r, s, k, t, p in _ALTERNATIVES)}),
r AS (SELECT order_key, rank, m * share AS distance, m * share / 1000.0 / kph * 3600.0 AS time,
        m * share / 1000.0 / 1.60934 / CASE profile WHEN 'truck' THEN 6.5 ELSE 12.0 END * 3.5 + CASE WHEN pays THEN tolls ELSE 0.0 END
          + m * share / 1000.0 / 80.0 * 25.0 AS cost,
        greatest(0.0, 100 - CASE profile WHEN 'truck' THEN 150.0 ELSE 120.0 END * m * share / 1000.0 / 1000.0 * 10) AS eco FROM b, alt),
f AS (SELECT * FROM r WHERE rank = 0)
SELECT r.order_key, r.rank, {R.format('f.time - r.time')} AS time_diff, {R.format('f.distance - r.distance')} AS distance_diff,
  {R.format('f.cost - r.cost')} AS cost_diff, {R.format('f.eco - r.eco')} AS eco_diff FROM r JOIN f USING (order_key) WHERE r.rank > 0""")
def q_cb13_routes(spark, sf):
    """Each order's direct route against two alternatives: time (s), distance (m), cost, eco score."""
    p = rt.parse_reply(route_replies(spark, sf), "reply").select(
        "order_key", F.col("path.distance").alias("m"), rt.toll_total("path.tolls").alias("tolls"))
    alt = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(s).alias("share"), F.lit(k).alias("kph"), F.lit(t).alias("pays"),
                             F.lit(v).alias("profile")) for r, s, k, t, v in _ALTERNATIVES))
    x = p.withColumn("a", F.explode(alt)).select("order_key", "tolls", "a.*", (F.col("m") * F.col("a.share")).alias("distance"))
    cost = cb.transport_cost(F.col("distance") / 1000.0, "profile", F.when(F.col("pays"), F.col("tolls")).otherwise(0.0), F.lit(25.0))
    x = x.select("order_key", "rank", "distance", (F.col("distance") / 1000.0 / F.col("kph") * 3600.0).alias("time"),
                 cost["total"].alias("cost"), cb.route_impact("distance", "profile")["eco_score"].alias("eco"))
    metrics = ["time", "distance", "cost", "eco"]
    c = rt.compare_routes(x, ["order_key"], "rank", metrics)
    return c.select("order_key", "rank", *(round_half_up(f"{m}_diff", 4).alias(f"{m}_diff") for m in metrics))


@register("gn18_eta_slip_per_shipment", view_sql("legs") + """,
t AS (SELECT order_key, CAST(ship_date AS TIMESTAMP) + to_seconds(CAST(floor(sum(distance_km / 80.0 * 3600) OVER w) AS BIGINT)) AS planned,
             CAST(ship_date AS TIMESTAMP) + to_seconds(CAST(floor(sum(distance_km / 80.0 * 3600) OVER w) AS BIGINT) + CAST(floor(value / 10) AS BIGINT)) AS actual
      FROM legs WINDOW w AS (PARTITION BY order_key ORDER BY line_no, distance_km, load_kg, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT order_key, CAST(max(epoch(actual) - epoch(planned)) AS BIGINT) AS max_slip_s, round(avg(epoch(actual) - epoch(planned)), 4) AS avg_slip_s,
  max(epoch(actual) - epoch(planned)) > 7200 AS deviated FROM t GROUP BY 1""")
def q_gn18(spark, sf):
    from pyspark.sql import Window
    lg = view(spark, sf, "legs")
    w = Window.partitionBy("order_key").orderBy("line_no", "distance_km", "load_kg", "value").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.floor(F.sum(F.col("distance_km") / 80.0 * 3600).over(w))
    base = F.col("ship_date").cast("timestamp")
    x = lg.select("order_key", (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), cum.cast("decimal(18,6)"))).alias("planned"),
                  (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (cum + F.floor(F.col("value") / 10)).cast("decimal(18,6)"))).alias("actual"))
    s = rt.eta_slip(x, ["order_key"], "planned", "actual")
    return s.select("order_key", F.col("max_slip_s").cast("bigint"), F.round("avg_slip_s", 4).alias("avg_slip_s"), "deviated")


@register("gn19_turn_by_turn_checklist", view_sql("legs") + """
SELECT order_key, CAST(row_number() OVER (PARTITION BY order_key ORDER BY line_no, distance_km, load_kg, value) - 1 AS INTEGER) AS step,
  'Drive to nation ' || CAST(dest_nation AS VARCHAR) AS text FROM legs""")
def q_gn19(spark, sf):
    p = rt.parse_reply(route_replies(spark, sf), "reply")
    x = p.select("order_key", F.posexplode("path.instructions").alias("step", "i"))
    return x.select("order_key", F.col("step").cast("int").alias("step"), F.col("i.text").alias("text"))


@register("gn14_multi_stop_tours")
def q_gn14(spark, sf):
    """Per order: visit the suppliers of its lines from the first line's
    supplier (depot), then the customer; max 8 h per trip, capacity 8000 kg."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    sp = supplier_points(spark, sf).select("s_suppkey", "lat", "lon")
    stops = li.join(sp, li.l_suppkey == sp.s_suppkey).select(
        F.col("l_orderkey").alias("tour"), F.col("l_suppkey").alias("stop"), "lat", "lon", (F.col("l_quantity") * 100.0).alias("load"),
        "l_linenumber")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cp = customer_points(spark, sf)
    ends = orders.join(cp, orders.o_custkey == cp.c_custkey).select(
        F.col("o_orderkey").alias("tour"), F.col("o_custkey").alias("stop"), "lat", "lon")
    return rt.multi_stop_tours(stops, "tour", "stop", "lat", "lon", "load", n_rows=li.count() + orders.count(),
                               first="l_linenumber", ends=ends)


@register("cb13_pairwise_mode_comparison", view_sql("legs") + f""",
od AS (SELECT origin_nation, dest_nation, any_value(distance_km) AS km, sum(load_kg) AS kg FROM legs GROUP BY 1, 2),
m AS (SELECT od.*, v.mode, v.vehicle, {R.format(R.format("CASE v.vehicle WHEN 'diesel_truck' THEN 0.162 WHEN 'rail' THEN 0.024 WHEN 'cargo_ship' THEN 0.010 END * km * kg / 1000.0 * 1.15").replace(', 4)', ', 2)', 1))} AS em,
       CAST(round(CAST(CASE v.vehicle WHEN 'diesel_truck' THEN 0.35 WHEN 'rail' THEN 0.15 ELSE 0.3 END * km AS DECIMAL(38,8)), 4) AS DOUBLE) AS cost
      FROM od, (VALUES ('truck', 'diesel_truck'), ('train', 'rail'), ('ship', 'cargo_ship')) v(mode, vehicle)),
r AS (SELECT *, row_number() OVER (PARTITION BY origin_nation, dest_nation ORDER BY em, mode) AS rk FROM m)
SELECT a.origin_nation, a.dest_nation, a.mode AS best_mode, b.mode AS other_mode, {R.format('b.em - a.em')} AS emissions_diff,
  {R.format('b.cost - a.cost')} AS cost_diff FROM r a JOIN r b ON a.origin_nation = b.origin_nation AND a.dest_nation = b.dest_nation
WHERE a.rk = 1 AND b.rk > 1""")
def q_cb13(spark, sf):
    """Rank-1 option against every alternative, per origin-destination."""
    from pyspark.sql import Window
    from .carbon import q_cb14
    m = q_cb14(spark, sf).withColumn("rk", F.row_number().over(
        Window.partitionBy("origin_nation", "dest_nation").orderBy("emissions_kg", "mode")))
    a = m.filter(F.col("rk") == 1).select("origin_nation", "dest_nation", F.col("mode").alias("best_mode"),
                                           F.col("emissions_kg").alias("a_em"), F.col("cost").alias("a_cost"))
    b = m.filter(F.col("rk") > 1).select("origin_nation", "dest_nation", F.col("mode").alias("other_mode"),
                                          F.col("emissions_kg").alias("b_em"), F.col("cost").alias("b_cost"))
    j = a.join(b, ["origin_nation", "dest_nation"])
    return j.select("origin_nation", "dest_nation", "best_mode", "other_mode",
                    round_half_up(F.col("b_em") - F.col("a_em"), 4).alias("emissions_diff"),
                    round_half_up(F.col("b_cost") - F.col("a_cost"), 4).alias("cost_diff"))
