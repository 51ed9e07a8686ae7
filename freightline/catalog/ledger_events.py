"""More ledger and factor queries (LG6, LG7, LG14, LG15, CB16, DQ16, PRJ20, TK1, GN10)."""
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators.quality import factor_table_valid
from ..plans import carbon as cb
from ..plans import ledger as lg
from ..plans import network as nw
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import REGISTRY, register
from .carbon import leg_emissions
from .ledger import approvals, temperature_violations


@register("lg6_carrier_assignment_latest", view_sql("ledger") + """
SELECT shipment_id, arg_max('CARRIER-' || CAST(k % 7 AS VARCHAR), (ts, seq)) AS carrier, max(ts) AS assigned_at
FROM ledger WHERE event_type = 'click' GROUP BY 1""")
def q_lg6(spark, sf):
    a = view(spark, sf, "ledger").filter(F.col("event_type") == "click") \
        .withColumn("carrier", F.concat(F.lit("CARRIER-"), (F.col("k") % 7).cast("string")))
    return lg.latest_carrier(a)


@register("lg7_batch_update_parallel_arrays", view_sql("ledger") + """,
b AS (SELECT date_trunc('hour', ts) AS batch_ts, seq // 100 AS chunk, shipment_id, seq, status, k FROM ledger WHERE event_type <> 'signup'),
g AS (SELECT batch_ts, chunk, count(*) AS n, bool_or(k % 50 = 0) AS broken FROM b GROUP BY 1, 2),
ex AS (SELECT DISTINCT shipment_id FROM ledger WHERE status = 'CREATED' AND ts < TIMESTAMP '2024-01-10')
SELECT b.batch_ts, b.shipment_id, b.status, 'LOC-' || CAST(b.k AS VARCHAR) AS location FROM b JOIN g ON b.batch_ts = g.batch_ts AND b.chunk = g.chunk
WHERE NOT g.broken AND b.shipment_id IN (SELECT shipment_id FROM ex)""")
def q_lg7(spark, sf):
    """Batch update requests per hour (chunks of at most 100 events); a chunk
    holding an event with k % 50 = 0 sends one location too few (length
    mismatch) and is rejected whole; only shipments created before 10 Jan exist."""
    led = view(spark, sf, "ledger")
    ev = led.filter(F.col("event_type") != "signup")
    loc = F.concat(F.lit("LOC-"), F.col("k").cast("string"))
    per = ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("batch_ts"), F.floor(F.col("seq") / 100).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "shipment_id", "status", loc.alias("location"), "k"))).alias("u"))
    broken = F.exists("u", lambda x: x["k"] % 50 == 0)
    batches = per.select(F.concat_ws("-", F.col("batch_ts").cast("string"), F.col("chunk").cast("string")).alias("batch_id"), "batch_ts",
                         F.transform("u", lambda x: x["shipment_id"]).alias("ids"), F.transform("u", lambda x: x["status"]).alias("statuses"),
                         F.when(broken, F.slice(F.transform("u", lambda x: x["location"]), 2, 1 << 20))
                          .otherwise(F.transform("u", lambda x: x["location"])).alias("locations"))
    existing = led.filter((F.col("status") == "CREATED") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")))
    return lg.batch_updates(batches, existing).select("batch_ts", "shipment_id", "status", "location")


@register("lg14_metadata_projection", view_sql("ledger") + """,
latest AS (SELECT shipment_id, arg_max(status, (ts, seq)) AS status, max(ts) AS last_update FROM ledger GROUP BY 1)
SELECT shipment_id, status, last_update, status = 'DELIVERED' AS is_delivered, status = 'CANCELLED' AS is_cancelled,
  status = 'CUSTOMS_HOLD' AS in_customs FROM latest""")
def q_lg14(spark, sf):
    s = lg.latest_state(view(spark, sf, "ledger"))
    return lg.metadata(s).select("shipment_id", "status", "last_update", "is_delivered", "is_cancelled", "in_customs")


def _sub(name):
    return "(" + REGISTRY[name][1] + ")"


@register("lg15_domain_events", f"""
SELECT 'ShipmentCreated' AS event, shipment_id FROM {_sub('lg1_first_create_wins')} WHERE accepted
UNION ALL SELECT 'ClaimFiled', shipment_id FROM {_sub('lg12_insurance_claims')} WHERE claim_status = 'PENDING'
UNION ALL SELECT 'CustomsCleared', shipment_id FROM {_sub('ag16_lg11_customs_clearance')} WHERE cleared
UNION ALL SELECT 'ShipmentArchived', shipment_id FROM {_sub('lg8_archive_delivered')}
UNION ALL SELECT 'TemperatureViolation', shipment_id FROM {_sub('lg10_temperature_compliance')} WHERE NOT compliant
UNION ALL SELECT 'ShipmentDelivered', shipment_id FROM ({view_sql('ledger')} SELECT * FROM ledger) WHERE status = 'DELIVERED'
UNION ALL SELECT 'ShipmentUpdated', shipment_id FROM ({view_sql('ledger')} SELECT * FROM ledger) WHERE status NOT IN ('CREATED', 'DELIVERED')""")
def q_lg15(spark, sf):
    """Domain events derived from the ledger folds, one union."""
    led = view(spark, sf, "ledger")
    created = lg.first_create(led).filter("accepted").select(F.lit("ShipmentCreated").alias("event"), "shipment_id")
    claims = lg.claim_decision(led.filter(F.col("event_type") == "error").select("shipment_id", F.col("value").alias("amount"),
                                                                                (F.col("k") * 5.0).alias("coverage")), "amount", "coverage")
    claims = claims.filter(F.col("claim_status") == "PENDING").select(F.lit("ClaimFiled").alias("event"), "shipment_id")
    cleared = lg.customs_cleared(approvals(spark, sf), "shipment_id", "agency", "ts").filter("cleared") \
                .select(F.lit("CustomsCleared").alias("event"), "shipment_id")
    archived = lg.latest_state(led).filter(F.col("status") == "DELIVERED").select(F.lit("ShipmentArchived").alias("event"), "shipment_id")
    temp = temperature_violations(spark, sf).filter(F.col("n_violations") > 0).select(F.lit("TemperatureViolation").alias("event"), "shipment_id")
    changed = led.filter(F.col("status") != "CREATED").select(
        F.when(F.col("status") == "DELIVERED", F.lit("ShipmentDelivered")).otherwise(F.lit("ShipmentUpdated")).alias("event"), "shipment_id")
    return created.unionByName(claims).unionByName(cleared).unionByName(archived).unionByName(temp).unionByName(changed)


_MEASURED_SQL = view_sql("legs") + """,
meas AS (SELECT vehicle_type, region, CAST(ship_date AS TIMESTAMP) AS last_updated,
   CASE WHEN sum(distance_km * load_kg) > 0 THEN sum(distance_km * load_kg * (1 + (order_key % 11) / 100.0)) / sum(distance_km * load_kg) END AS ratio
   FROM legs GROUP BY 1, 2, 3),
f AS (SELECT m.*, CASE m.vehicle_type WHEN 'diesel_truck' THEN 0.162 WHEN 'electric_truck' THEN 0.045 WHEN 'cargo_ship' THEN 0.01
        WHEN 'air_freight' THEN 0.805 WHEN 'rail' THEN 0.024 WHEN 'drone' THEN 0.15 WHEN 'hydrogen_truck' THEN 0.1 END * m.ratio AS factor FROM meas m)
"""


def measured_factors(spark, sf):
    """Factor versions measured from shipments: per (vehicle, region, day) the
    default factor times an observed load-weighted adjustment."""
    lgd = view(spark, sf, "legs")
    w = F.col("distance_km") * F.col("load_kg")
    g = lgd.groupBy("vehicle_type", "region", F.col("ship_date").cast("timestamp").alias("last_updated")).agg(
        F.when(F.sum(w) > 0, F.sum(w * (1 + (F.col("order_key") % 11) / 100.0)) / F.sum(w)).alias("ratio"))
    return g.withColumn("factor", F.element_at(cb.lit_map(cb.EMISSION_FACTORS), F.col("vehicle_type")) * F.col("ratio")) \
            .withColumn("source", F.lit("measured"))


@register("cb16_latest_factor_versions", _MEASURED_SQL + """
SELECT vehicle_type, region, CAST(round(CAST(arg_max(factor, last_updated) AS DECIMAL(38,8)), 6) AS DOUBLE) AS factor,
  max(last_updated) AS last_updated FROM f WHERE factor IS NOT NULL GROUP BY 1, 2""")
def q_cb16(spark, sf):
    v = cb.latest_factors(measured_factors(spark, sf).filter(F.col("factor").isNotNull()))
    return v.select("vehicle_type", "region", F.round(F.col("factor").cast("decimal(38,8)"), 6).cast("double").alias("factor"),
                    F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@register("dq16_factor_table_rules", _MEASURED_SQL + """
SELECT vehicle_type, region, last_updated, coalesce(factor >= 0, false) AS valid FROM f""")
def q_dq16(spark, sf):
    v = factor_table_valid(measured_factors(spark, sf))
    return v.select("vehicle_type", "region", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"),
                    F.coalesce("valid", F.lit(False)).alias("valid"))


# Economic indicator codes and their short names.
INDICATORS = {"NY.GDP.MKTP.CD": "gdp", "NE.EXP.GNFS.CD": "exports", "NE.IMP.GNFS.CD": "imports", "FP.CPI.TOTL": "cpi"}
_CODES = list(INDICATORS) + ["XX.UNKNOWN"]


@register("prj20_indicator_code_names", """
SELECT o_orderkey, ['NY.GDP.MKTP.CD','NE.EXP.GNFS.CD','NE.IMP.GNFS.CD','FP.CPI.TOTL','XX.UNKNOWN'][o_orderkey % 5 + 1] AS indicator,
  CASE ['NY.GDP.MKTP.CD','NE.EXP.GNFS.CD','NE.IMP.GNFS.CD','FP.CPI.TOTL','XX.UNKNOWN'][o_orderkey % 5 + 1]
    WHEN 'NY.GDP.MKTP.CD' THEN 'gdp' WHEN 'NE.EXP.GNFS.CD' THEN 'exports' WHEN 'NE.IMP.GNFS.CD' THEN 'imports' WHEN 'FP.CPI.TOTL' THEN 'cpi' END AS short_name
FROM orders""")
def q_prj20(spark, sf):
    o = table(spark, sf, "orders")
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", code.alias("indicator"), cb.lit_map(INDICATORS)[code].alias("short_name"))


@register("tk1_sort_by_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def q_tk1(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id")


def _gn10_sql(rounds: int = 24) -> str:
    from .network import _PREP_BODY
    parts = ["vw AS (SELECT profile, src, dst, min(travel_time) AS w FROM ce GROUP BY 1, 2, 3)",
             "a0 AS (SELECT p.profile, n.node_id AS source, n.node_id AS node, 0.0 AS cost FROM nodes n, (VALUES ('heavy_truck'), ('van')) p(profile))"]
    for i in range(1, rounds + 1):
        parts.append(f"a{i} AS (SELECT profile, source, node, min(cost) AS cost FROM (SELECT * FROM a{i-1} UNION ALL "
                     f"SELECT a.profile, a.source, e.dst, a.cost + e.w FROM a{i-1} a JOIN vw e ON a.profile = e.profile AND a.node = e.src) GROUP BY 1, 2, 3)")
    return (view_sql("edges", "nodes") + _PREP_BODY + ",\n" + ",\n".join(parts) + f""",
bc AS (SELECT st.profile, sv.node AS node_id, CAST(count(*) AS DOUBLE) AS betweenness FROM a{rounds} st
       JOIN a{rounds} sv ON sv.profile = st.profile AND sv.source = st.source
       JOIN a{rounds} vt ON vt.profile = st.profile AND vt.source = sv.node AND vt.node = st.node
       WHERE sv.node <> st.source AND sv.node <> st.node AND abs(sv.cost + vt.cost - st.cost) <= 1e-6 * greatest(1.0, st.cost)
       GROUP BY 1, 2),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile ORDER BY betweenness DESC, node_id) AS INTEGER) AS rank FROM bc)
SELECT profile, node_id, betweenness, rank FROM top WHERE rank <= 3""")


@register("gn10_node_betweenness_top", _gn10_sql())
def q_gn10(spark, sf):
    """Betweenness by travel time per vehicle profile, top 3 nodes of each.  No two paths of this network tie,
    so the SQL counts whole paths; ``gn10_street_betweenness`` has ties."""
    from .network import prepared_edges
    e = nw.constrained_edges(prepared_edges(spark, sf))
    bc = nw.betweenness(e, view(spark, sf, "nodes"), "travel_time", groups=["profile"])
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.col("betweenness").desc(), "node_id"))
    top = bc.withColumn("betweenness", F.round("betweenness", 6)).withColumn("rank", rank.cast("int"))
    return top.filter("rank <= 3").select("profile", "node_id", "betweenness", "rank")  # a top-k report
