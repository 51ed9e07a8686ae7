"""Logistics views derived from the driver's TPC-H style tables.

Each view exists twice: as a Spark DataFrame (what the library runs) and as
SQL text (what the DuckDB oracle runs).  The SQL is the specification of the
binding, so it is kept next to the DataFrame code.

Scale notes: ``nation`` and ``region`` have a fixed row count (25 and 5) by
the TPC-H specification, so they are broadcast with a proven bound.  The
other dimensions (part, supplier, customer, orders) grow with the scale
factor and are left to Catalyst/AQE, which converts a join to broadcast only
after measuring the side at run time.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, haversine_sql
from .tables import table

# Test-view binding of part types to vehicle types and of region names to region codes.
VEHICLE_BY_PART_TYPE = {
    "ECONOMY": "rail", "SMALL": "drone", "MEDIUM": "diesel_truck",
    "LARGE": "cargo_ship", "STANDARD": "hydrogen_truck", "PROMO": "electric_truck",
}
REGION_CODE_BY_NAME = {
    "AFRICA": "AF", "AMERICA": "NA", "ASIA": "AS", "EUROPE": "EU", "MIDDLE EAST": "OC",
}
# Ledger status bound to each event type.
STATUS_BY_EVENT = {
    "signup": "CREATED", "view": "DISPATCHED", "click": "IN_TRANSIT",
    "error": "CUSTOMS_HOLD", "purchase": "DELIVERED",
}
# Road classes and nominal speeds for the synthetic road edges.
ROAD_CLASSES = ("motorway", "primary", "residential")


def map_lookup(mapping: dict, key) -> F.Column:
    """Literal map lookup (unknown key -> null); stays a JVM expression."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def case_sql(mapping: dict, key: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {key} {whens} END"


# ---------------------------------------------------------------- DataFrames

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("place_id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("bigint").alias("region_key"),
        ((F.col("n_nationkey") * 37) % 140 - 70).cast("double").alias("lat"),
        ((F.col("n_nationkey") * 53) % 360 - 180).cast("double").alias("lon"),
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily demand per brand: ``(series_id, ds, y)``.

    Lineitem is reduced to (partkey, day) sums before the part join, so the
    shuffle carries pre-aggregated rows; the brand/day aggregate follows.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pre = (li.groupBy("l_partkey", F.to_date("l_shipdate").alias("ds"))
             .agg(F.sum("l_quantity").alias("q")))
    return (pre.join(part, pre.l_partkey == part.p_partkey)
               .groupBy(F.col("p_brand").alias("series_id"), "ds")
               .agg(F.sum("q").alias("y")))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    # orders meet their customers first, so the wide lines are shuffled once less
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
           .join(s, li.l_suppkey == s.s_suppkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("o_custkey").alias("cust_key"),
        F.to_date("o_orderdate").alias("order_date"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_quantity") * F.col("p_size")).alias("weight"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("s_nationkey").cast("bigint").alias("origin_nation"),
        F.col("c_nationkey").cast("bigint").alias("dest_nation"),
        F.col("p_type").alias("p_type"),
        F.col("p_brand").alias("brand"),
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transport leg per shipment line: supplier nation -> customer nation."""
    sh = shipments(spark, sf_dir)
    pl = places(spark, sf_dir)
    reg = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("rk"), "r_name")
    o = F.broadcast(pl.select(F.col("place_id").alias("o_id"), F.col("lat").alias("o_lat"),
                              F.col("lon").alias("o_lon"), F.col("region_key").alias("o_rk")))
    d = F.broadcast(pl.select(F.col("place_id").alias("d_id"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon")))
    j = (sh.join(o, sh.origin_nation == o.o_id).join(d, sh.dest_nation == d.d_id)
           .join(F.broadcast(reg), F.col("o_rk") == F.col("rk")))
    return j.select(
        "order_key", "line_no", "ship_date", "origin_nation", "dest_nation",
        haversine_km("o_lat", "o_lon", "d_lat", "d_lon").alias("distance_km"),
        map_lookup(VEHICLE_BY_PART_TYPE, F.col("p_type")).alias("vehicle_type"),
        map_lookup(REGION_CODE_BY_NAME, F.col("r_name")).alias("region"),
        F.col("weight").alias("load_kg"),
        (F.col("return_flag") == "R").alias("empty_return"),
        "value", "segment",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed road edges between places: each node links to three others."""
    pl = places(spark, sf_dir)
    n = F.lit(25)
    cand = pl.select(F.col("place_id").alias("src"), F.explode(F.array(
        (F.col("place_id") * 7 + 3) % n, (F.col("place_id") * 3 + 1) % n, (F.col("place_id") + 1) % n)).alias("dst"))
    cand = cand.filter(F.col("src") != F.col("dst")).distinct()
    a = F.broadcast(pl.select(F.col("place_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")))
    b = F.broadcast(pl.select(F.col("place_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")))
    e = cand.join(a, cand.src == a.a).join(b, cand.dst == b.b)
    return e.select(
        F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
        haversine_km("a_lat", "a_lon", "b_lat", "b_lon").alias("length_km"),
        F.element_at(F.array(*[F.lit(c) for c in ROAD_CLASSES]), ((F.col("src") + F.col("dst")) % 3 + 1).cast("int")).alias("highway"),
        F.when((F.col("src") * F.col("dst")) % 4 == 0, F.lit(None).cast("double"))
         .otherwise((30 + ((F.col("src") + F.col("dst")) % 5) * 20).cast("double")).alias("speed_kph"),
        (4.0 + (F.col("src") % 3) * 0.5).alias("maxheight"),
        (20.0 + (F.col("dst") % 4) * 10.0).alias("maxweight"),
        ((F.col("src") + F.col("dst")) % 7 == 0).alias("hazmat_prohibited"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road-network nodes: the places with an elevation in metres."""
    return places(spark, sf_dir).select(F.col("place_id").alias("node_id"), "lat", "lon",
                                        ((F.col("place_id") * 137) % 500).cast("double").alias("elevation"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed street segments between delivery stops (customers), both ways, so the graph grows with the
    table: every stop hangs on another, and every fifth closes a loop with its neighbour.  Minutes are whole
    numbers, so paths tie; some segments are closed to heavy trucks."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c"))
    up = c.filter("c > 0").select(F.col("c").alias("a"), F.floor((F.col("c") - 1) / 2).cast("bigint").alias("b"))
    ring = c.filter("c % 5 = 0").select((F.col("c") + 1).alias("b"), F.col("c").alias("a"))
    ring = ring.join(c.select(F.col("c").alias("b")), "b").select("a", "b")
    pairs = up.unionByName(ring)
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "a", "b").unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "a", "b"))
    return both.select("src", "dst", ((F.col("a") * 7 + F.col("b") * 13) % 9 + 1).cast("double").alias("minutes"),
                       ((F.col("a") + F.col("b")) % 11 == 0).alias("closed"))


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"), F.col("user_id").alias("device_id"), F.col("event_type").alias("sensor_type"),
        "value", "ts", F.col("user_id").alias("shipment_id"), "props",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("shipment_id"), F.col("event_id").alias("seq"), "ts",
        map_lookup(STATUS_BY_EVENT, F.col("event_type")).alias("status"),
        F.col("event_type"), F.col("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily error 'damage' per user, stamped at midnight."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return (ev.groupBy(F.col("user_id").alias("zip_code"), F.date_trunc("day", "ts").alias("day"))
              .agg(F.sum("value").alias("daily_damage")))


# ----------------------------------------------------------------- SQL text

_VIEW_SQL = {
    "places": ("""
SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region_key,
       CAST((n_nationkey*37) % 140 - 70 AS DOUBLE) AS lat, CAST((n_nationkey*53) % 360 - 180 AS DOUBLE) AS lon
FROM nation""", ()),
    "demand": ("""
SELECT p.p_brand AS series_id, CAST(l.l_shipdate AS DATE) AS ds, SUM(l.l_quantity) AS y
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""", ()),
    "shipments": ("""
SELECT l.l_orderkey AS order_key, CAST(l.l_linenumber AS BIGINT) AS line_no, l.l_partkey AS part_key,
       l.l_suppkey AS supp_key, o.o_custkey AS cust_key, CAST(o.o_orderdate AS DATE) AS order_date,
       CAST(l.l_shipdate AS DATE) AS ship_date, l.l_quantity AS quantity, l.l_quantity * p.p_size AS weight,
       l.l_extendedprice AS value, l.l_discount AS discount, l.l_returnflag AS return_flag,
       o.o_orderstatus AS order_status, o.o_orderpriority AS priority, c.c_mktsegment AS segment,
       CAST(s.s_nationkey AS BIGINT) AS origin_nation, CAST(c.c_nationkey AS BIGINT) AS dest_nation,
       p.p_type AS p_type, p.p_brand AS brand
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey""", ()),
    "legs": (f"""
SELECT sh.order_key, sh.line_no, sh.ship_date, sh.origin_nation, sh.dest_nation,
       {haversine_sql('o.lat', 'o.lon', 'd.lat', 'd.lon')} AS distance_km,
       {case_sql(VEHICLE_BY_PART_TYPE, 'sh.p_type')} AS vehicle_type,
       {case_sql(REGION_CODE_BY_NAME, 'r.r_name')} AS region,
       sh.weight AS load_kg, sh.return_flag = 'R' AS empty_return, sh.value, sh.segment
FROM shipments sh JOIN places o ON sh.origin_nation = o.place_id JOIN places d ON sh.dest_nation = d.place_id
JOIN region r ON o.region_key = r.r_regionkey""", ("shipments", "places")),
    "edges": (f"""
SELECT c.src, c.dst, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS length_km,
       CASE (c.src + c.dst) % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' ELSE 'residential' END AS highway,
       CASE WHEN (c.src * c.dst) % 4 = 0 THEN NULL ELSE CAST(30 + ((c.src + c.dst) % 5) * 20 AS DOUBLE) END AS speed_kph,
       4.0 + (c.src % 3) * 0.5 AS maxheight, 20.0 + (c.dst % 4) * 10.0 AS maxweight, (c.src + c.dst) % 7 = 0 AS hazmat_prohibited
FROM (SELECT DISTINCT src, dst FROM (
        SELECT place_id AS src, (place_id*7+3) % 25 AS dst FROM places
        UNION ALL SELECT place_id, (place_id*3+1) % 25 FROM places
        UNION ALL SELECT place_id, (place_id+1) % 25 FROM places) WHERE src <> dst) c
JOIN places a ON c.src = a.place_id JOIN places b ON c.dst = b.place_id""", ("places",)),
    "nodes": ("""
SELECT place_id AS node_id, lat, lon, CAST((place_id * 137) % 500 AS DOUBLE) AS elevation FROM places""", ("places",)),
    "streets": ("""
SELECT src, dst, CAST((a * 7 + b * 13) % 9 + 1 AS DOUBLE) AS minutes, (a + b) % 11 = 0 AS closed
FROM (SELECT a AS src, b AS dst, a, b FROM street_pairs UNION ALL SELECT b, a, a, b FROM street_pairs)""", ("street_pairs",)),
    "street_pairs": ("""
SELECT c_custkey AS a, (c_custkey - 1) // 2 AS b FROM customer WHERE c_custkey > 0
UNION ALL SELECT x.c_custkey, y.c_custkey FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 WHERE x.c_custkey % 5 = 0""", ()),
    "sensor": ("""
SELECT event_id, user_id AS device_id, event_type AS sensor_type, value, ts, user_id AS shipment_id, props
FROM events""", ()),
    "ledger": (f"""
SELECT user_id AS shipment_id, event_id AS seq, ts, {case_sql(STATUS_BY_EVENT, 'event_type')} AS status,
       event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events""", ()),
    "damage": ("""
SELECT user_id AS zip_code, date_trunc('day', ts) AS day, SUM(value) AS daily_damage
FROM events WHERE event_type = 'error' GROUP BY 1, 2""", ()),
}


def view_sql(*names: str) -> str:
    """``WITH`` clause defining the named views (and their dependencies) for DuckDB."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in _VIEW_SQL[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEW_SQL[n][0]}\n)" for n in order) + "\n"


VIEWS = {
    "places": places, "demand": demand, "shipments": shipments, "legs": legs,
    "edges": edges, "nodes": nodes, "streets": streets, "sensor": sensor, "ledger": ledger, "damage": damage,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)
