"""Road-network queries (GN1-GN14, AG14) over the ``edges``/``nodes`` views,
with route requests taken from the shipment legs."""
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..plans import network as nw
from ..plans.graph import shortest_path_labels
from ..session import stored
from ..sources.views import view, view_sql
from . import register
from .joins import customer_points

R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"

_ALL_EDGES_BODY = """,
cls AS (SELECT highway, avg(speed_kph) AS cs FROM edges GROUP BY 1),
pe AS (SELECT e.src, e.dst, e.highway, e.maxheight, e.maxweight, e.hazmat_prohibited, e.length_km * 1000.0 AS length,
              coalesce(e.speed_kph, cls.cs, 50.0) AS speed_kph,
              (nv.elevation - nu.elevation) / (e.length_km * 1000.0) AS grade
       FROM edges e LEFT JOIN cls ON e.highway = cls.highway JOIN nodes nu ON e.src = nu.node_id JOIN nodes nv ON e.dst = nv.node_id),
pe2 AS (SELECT *, length / (speed_kph / 3.6) AS travel_time FROM pe),
ce AS (SELECT p.profile, e.src, e.dst, e.length, e.grade, e.speed_kph * p.sf AS speed_kph,
              e.length / (e.speed_kph * p.sf * 0.277778) AS travel_time,
              (e.maxheight < p.h OR e.maxweight < p.w OR (p.hz AND e.hazmat_prohibited)) AS restricted
       FROM pe2 e, (VALUES ('heavy_truck', 40.0, 4.5, true, 0.8), ('van', 3.0, 2.5, false, 1.0)) p(profile, w, h, hz, sf)
       WHERE NOT restricted OR {keep}),
cw AS (SELECT profile, src, dst, 0.7 * travel_time + 0.3 * length AS w FROM ce)
"""
_PREP_BODY = _ALL_EDGES_BODY.format(keep="false")
_PREP_SQL = view_sql("edges", "nodes") + _PREP_BODY


def prepared_edges(spark, sf):
    return nw.prepare_edges(view(spark, sf, "edges"), view(spark, sf, "nodes"))


def profile_edges(spark, sf, keep_restricted=False):
    e = nw.constrained_edges(prepared_edges(spark, sf), keep_restricted=keep_restricted)
    return e.withColumn("w", nw.composite_weight())


@register("gn1_edge_speed_time_grade", _PREP_SQL + f"""
SELECT src, dst, round(speed_kph, 4) AS speed_kph, {R.format('travel_time')} AS travel_time, round(grade, 8) AS grade FROM pe2""")
def q_gn1(spark, sf):
    e = prepared_edges(spark, sf)
    from ..functions.numeric import round_half_up
    return e.select("src", "dst", F.round("speed_kph", 4).alias("speed_kph"), round_half_up("travel_time", 4).alias("travel_time"),
                    F.round("grade", 8).alias("grade"))


@register("gn2_gn3_profile_edges_composite_weight", _PREP_SQL + f"""
SELECT profile, src, dst, {R.format('travel_time')} AS travel_time, {R.format('w')} AS w
FROM ce JOIN cw USING (profile, src, dst)""")
def q_gn2(spark, sf):
    from ..functions.numeric import round_half_up
    e = profile_edges(spark, sf)
    return e.select("profile", "src", "dst", round_half_up("travel_time", 4).alias("travel_time"), round_half_up("w", 4).alias("w"))


def _bf_sql(rounds: int = 24) -> str:
    parts = ["d0 AS (SELECT p.profile, n.node_id AS source, n.node_id AS node, 0.0 AS cost FROM nodes n, "
             "(VALUES ('heavy_truck'), ('van')) p(profile))"]
    for i in range(1, rounds + 1):
        parts.append(f"d{i} AS (SELECT profile, source, node, min(cost) AS cost FROM (SELECT * FROM d{i-1} UNION ALL "
                     f"SELECT d.profile, d.source, e.dst, d.cost + e.w FROM d{i-1} d JOIN cw e ON d.profile = e.profile "
                     f"AND d.node = e.src) GROUP BY 1, 2, 3)")
    return ",\n".join(parts)


def shipment_routes(spark, sf, keep_restricted=False):
    """Shortest composite-weight paths for every (profile, origin) that ships,
    to every reachable node; with ``keep_restricted`` over every edge."""
    legs = view(spark, sf, "legs")
    origins = legs.select(F.col("origin_nation").alias("source")).distinct()
    sources = origins.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in nw.VEHICLE_PROFILES])))
    e = profile_edges(spark, sf, keep_restricted)
    return nw.shortest_paths(e, sources, "w", groups=["profile"])


_GN4_SQL = view_sql("edges", "nodes", "legs") + _PREP_BODY + ",\n" + _bf_sql() + f""",
od AS (SELECT origin_nation, dest_nation, CAST(count(*) AS BIGINT) AS n_shipments FROM legs GROUP BY 1, 2)
SELECT d.profile, od.origin_nation, od.dest_nation, {R.format('d.cost')} AS cost, od.n_shipments
FROM od JOIN d24 d ON d.source = od.origin_nation AND d.node = od.dest_nation"""


@register("gn4_gn13_shortest_paths_for_shipments", _GN4_SQL)
def q_gn4(spark, sf):
    """Per (profile, origin, destination) pair that occurs in shipments: the
    least composite cost and the number of shipments on it.  Unreachable pairs
    drop out (no path)."""
    from ..functions.numeric import round_half_up
    od = view(spark, sf, "legs").groupBy("origin_nation", "dest_nation").agg(F.count(F.lit(1)).alias("n_shipments"))
    od = stored(od, "od-pairs")  # every search round reads the pairs; the legs are joined once
    profiles = F.explode(F.array(*[F.lit(p) for p in nw.VEHICLE_PROFILES])).alias("profile")
    targets = od.select(F.col("origin_nation").alias("source"), F.col("dest_nation").alias("node"), profiles)
    sp = shortest_path_labels(profile_edges(spark, sf), targets.select("profile", "source"), "w", ["profile"], targets=targets)
    j = od.join(sp, (od.origin_nation == sp.source) & (od.dest_nation == sp.node))
    return j.select("profile", "origin_nation", "dest_nation", round_half_up("cost", 4).alias("cost"), "n_shipments")


@register("gn5_gn6_route_metrics_and_geometry")
def q_gn5(spark, sf):
    sp = shipment_routes(spark, sf)
    e = nw.constrained_edges(prepared_edges(spark, sf))
    m = nw.route_metrics(sp, e, ["profile"])
    g = nw.path_linestring(sp, view(spark, sf, "nodes"), ["profile"])
    return m.join(g, ["profile", "source", "node"])


def service_reach(spark, sf):
    """(profile, source, node, minutes): nodes within 10/20/30 hours of travel time on the undirected graph of
    each profile from every shipping origin."""
    legs = view(spark, sf, "legs")
    origins = legs.select(F.col("origin_nation").alias("source")).distinct()
    sources = origins.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in nw.VEHICLE_PROFILES])))
    e = nw.constrained_edges(prepared_edges(spark, sf))
    reach = shortest_path_labels(e, sources, "travel_time", ["profile"], undirected=True, max_cost=30 * 3600.0)
    return reach.withColumn("minutes", F.explode(F.array(F.lit(600), F.lit(1200), F.lit(1800)))).filter(F.col("cost") <= F.col("minutes") * 60.0)


@register("gn7_service_areas")
def q_gn7(spark, sf):
    """Service areas per profile, origin and time: number of nodes and their convex hull."""
    x = service_reach(spark, sf)
    pts = x.join(view(spark, sf, "nodes").select(F.col("node_id").alias("node"), "lat", "lon"), "node")
    keys = ["profile", "source", "minutes"]
    hull = nw.convex_hulls(pts, keys)
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes")).join(hull, keys)


def _reach_sql(rounds: int = 24) -> str:
    parts = ["ue AS (SELECT profile, src, dst, min(travel_time) AS w FROM (SELECT profile, src, dst, travel_time FROM ce "
             "UNION ALL SELECT profile, dst, src, travel_time FROM ce) GROUP BY 1, 2, 3)",
             "r0 AS (SELECT p.profile, n.node_id AS source, n.node_id AS node, 0.0 AS cost FROM nodes n, (VALUES ('heavy_truck'), ('van')) p(profile))"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT profile, source, node, min(cost) AS cost FROM (SELECT * FROM r{i-1} UNION ALL "
                     f"SELECT r.profile, r.source, e.dst, r.cost + e.w FROM r{i-1} r JOIN ue e ON r.profile = e.profile AND r.node = e.src) GROUP BY 1, 2, 3)")
    return ",\n".join(parts)


_REACH = view_sql("edges", "nodes", "legs") + _PREP_BODY + ",\n" + _reach_sql() + """,
x AS (SELECT r.profile, r.source, r.node, m.minutes FROM r24 r, (VALUES (600), (1200), (1800)) m(minutes)
      WHERE r.cost <= m.minutes * 60.0 AND r.source IN (SELECT DISTINCT origin_nation FROM legs))"""


@register("gn7_reachable_node_counts", _REACH + """
SELECT profile, source, minutes, CAST(count(*) AS BIGINT) AS n_nodes FROM x GROUP BY 1, 2, 3""")
def q_gn7c(spark, sf):
    """Reachable-set sizes of the service areas (GN7) per profile."""
    x = service_reach(spark, sf)
    return x.groupBy("profile", "source", F.col("minutes").cast("int").alias("minutes")).agg(F.count(F.lit(1)).alias("n_nodes"))


@register("gn7_hull_invariants", _REACH + """
SELECT profile, source, minutes, CAST(count(*) AS BIGINT) AS inside, CAST(0 AS BIGINT) AS outside, TRUE AS ring_of_nodes FROM x GROUP BY 1, 2, 3""")
def q_gn7h(spark, sf):
    """Every reachable node lies in or on the hull of its service area, and every corner of the hull is one."""
    keys = ["profile", "source", "minutes"]
    pts = service_reach(spark, sf).join(view(spark, sf, "nodes").select(F.col("node_id").alias("node"), "lat", "lon"), "node")
    hull = nw.convex_hulls(pts, keys)
    ring = F.from_json("polygon", "type string, coordinates array<array<array<double>>>")["coordinates"][0]
    sides = F.zip_with("ring", F.slice("ring", F.lit(2), F.size("ring")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    j = pts.join(hull.withColumn("ring", ring), keys)
    left = F.transform(F.slice(sides, F.lit(1), F.size("ring") - 1), lambda s: (
        (s["b"][0] - s["a"][0]) * (F.col("lat") - s["a"][1]) - (s["b"][1] - s["a"][1]) * (F.col("lon") - s["a"][0])))
    on = F.exists("ring", lambda p: (p[0] == F.col("lon")) & (p[1] == F.col("lat")))
    j = j.withColumns({"is_in": (F.col("n_vertices") < 3) | F.forall(left, lambda c: c >= -1e-9), "corner": on})
    return j.groupBy(*[F.col(k).cast("int").alias(k) if k == "minutes" else F.col(k) for k in keys]).agg(
        F.count_if("is_in").alias("inside"), F.count_if(~F.col("is_in")).alias("outside"),
        (F.count_if("corner") >= F.max("n_vertices")).alias("ring_of_nodes"))


@register("gn11_connected_components_and_degree", view_sql("edges", "nodes") + ",\nl0 AS (SELECT node_id AS node, node_id AS label FROM nodes),\n" +
          "ue AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),\n" +
          ",\n".join(f"l{i} AS (SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label FROM l{i-1} l "
                     f"LEFT JOIN ue ON ue.dst = l.node LEFT JOIN l{i-1} n ON n.node = ue.src GROUP BY l.node, l.label)"
                     for i in range(1, 26)) + """,
deg AS (SELECT n.node_id, CAST((SELECT count(*) FROM edges e WHERE e.src = n.node_id) AS BIGINT) AS out_degree,
               CAST((SELECT count(*) FROM edges e WHERE e.dst = n.node_id) AS BIGINT) AS in_degree FROM nodes n)
SELECT d.node_id, l25.label AS component, d.out_degree, d.in_degree FROM deg d JOIN l25 ON d.node_id = l25.node""")
def q_gn11(spark, sf):
    n = view(spark, sf, "nodes")
    e = view(spark, sf, "edges")
    cc = nw.connected_components(n, e)
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (cc.join(out, "node_id", "left").join(inn, "node_id", "left")
              .select("node_id", "component", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                      F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


@register("ag14_network_stats", view_sql("edges", "nodes") + """,
bb AS (SELECT min(lat) a, max(lat) b, min(lon) c, max(lon) d FROM nodes)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS n_nodes, CAST(count(*) AS BIGINT) AS n_edges, round(sum(length_km), 4) AS total_km,
  round(sum(length_km) / abs((b - a) * (2 * pi() * 6371.0 / 360.0) * (d - c) * (2 * pi() * 6371.0 / 360.0) * cos(radians((a + b) / 2))), 8) AS street_density
FROM edges, bb GROUP BY a, b, c, d""")
def q_ag14(spark, sf):
    s = nw.network_stats(view(spark, sf, "nodes"), view(spark, sf, "edges"))
    return s.select("n_nodes", "n_edges", F.round("total_km", 4).alias("total_km"), F.round("street_density", 8).alias("street_density"))


_GN5_BODY = ",\n" + _bf_sql() + """,
cwe AS (SELECT ce.profile, ce.src, ce.dst, ce.length, ce.travel_time, ce.grade, ce.restricted, cw.w FROM ce JOIN cw USING (profile, src, dst)),
rpe AS (SELECT st.profile, st.source, st.node, e.length, e.travel_time, e.grade, e.restricted FROM d24 st
       JOIN d24 su ON su.profile = st.profile AND su.source = st.source
       JOIN cwe e ON e.profile = st.profile AND e.src = su.node
       JOIN d24 vt ON vt.profile = st.profile AND vt.source = e.dst AND vt.node = st.node
       WHERE st.source <> st.node AND abs(su.cost + e.w + vt.cost - st.cost) <= 1e-6 * greatest(1.0, st.cost)
         AND st.source IN (SELECT DISTINCT origin_nation FROM legs))
SELECT profile, source, node, CAST(round(CAST(CAST(sum(length) / 1000.0 AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS total_km,
  CAST(round(CAST(CAST(sum(travel_time) / 60.0 AS VARCHAR) AS DECIMAL(38,18)), 1) AS DOUBLE) AS estimated_time_min,
  CAST(round(CAST(CAST(sum(greatest(0.0, coalesce(grade, 0.0) * length)) AS VARCHAR) AS DECIMAL(38,18)), 1) AS DOUBLE) AS elevation_gain,
  CAST(count(*) FILTER (WHERE restricted) AS BIGINT) AS num_restrictions
FROM rpe GROUP BY 1, 2, 3"""


@register("gn5_route_metrics", view_sql("edges", "nodes", "legs") + _PREP_BODY + _GN5_BODY)
def q_gn5m(spark, sf):
    """Route metrics of every shortest path from a shipping origin: km (2
    places), minutes (1 place), elevation gain, restriction count."""
    sp = shipment_routes(spark, sf)
    e = nw.constrained_edges(prepared_edges(spark, sf))
    return nw.route_metrics(sp, e, ["profile"])


@register("gn5_open_route_restrictions", view_sql("edges", "nodes", "legs") + _ALL_EDGES_BODY.format(keep="true") + _GN5_BODY)
def q_gn5r(spark, sf):
    """Route metrics where no edge is closed: how many restricted edges each
    profile's unconstrained shortest path would use."""
    sp = shipment_routes(spark, sf, keep_restricted=True)
    return nw.route_metrics(sp, nw.constrained_edges(prepared_edges(spark, sf), keep_restricted=True), ["profile"])
