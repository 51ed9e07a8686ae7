"""Streaming operators in batch form (same functions as the streams) and the
stateful ledger stream (SS1-SS9, SS11-SS14)."""
from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..functions.numeric import round_half_up
from ..operators import joins as jn
from ..session import scratch_path
from ..sources.tables import table
from ..sources.views import places, view, view_sql
from ..streaming import sensors as ss
from ..streaming.replay import run_deliveries
from . import register
from .ledger import LG3_FOLD_SQL

_READ_SQL = """
rd AS (SELECT 'dev-' || CAST(user_id AS VARCHAR) AS device_id, ts, 'SHP-' || CAST(user_id AS VARCHAR) AS shipment_id,
  upper(event_type) AS sensor_type, value, CAST(event_id % 100 AS DOUBLE) AS battery FROM events WHERE event_id % 97 <> 0)
"""


def readings(spark, sf):
    raw = ss.events_to_messages(table(spark, sf, "events"))
    r = ss.accepted(ss.parse_messages(raw))
    return r.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("ss1_ss2_parse_and_accept", "WITH " + _READ_SQL + "SELECT device_id, ts, shipment_id, sensor_type, value, battery FROM rd")
def q_ss1(spark, sf):
    return readings(spark, sf).select("device_id", "ts", "shipment_id", "sensor_type", "value", "battery")


@register("ss2_ss3_dead_letters", """
SELECT 'missing device_id' AS error, CAST(NULL AS VARCHAR) AS device_id, event_id FROM events WHERE event_id % 97 = 0""")
def q_ss3(spark, sf):
    raw = ss.events_to_messages(table(spark, sf, "events"))
    p = raw.select("event_id", F.col("value").alias("raw"),
                   F.from_json("value", ss.SENSOR_MESSAGE_SCHEMA, ss.JSON_OPTIONS).alias("m"))
    return ss.dead_letters(p, keep=["event_id"]).select("error", "device_id", "event_id")


@register("ss4_readings_sink_idempotent", "WITH " + _READ_SQL + "SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS n FROM rd GROUP BY 1")
def q_ss4(spark, sf):
    """foreachBatch sink body run twice for the same batch id: the second run
    replaces the first (no duplicates); read back per date."""
    path = scratch_path(spark, "readings")
    r = readings(spark, sf)
    ss.write_readings_batch(r, 0, path)
    ss.write_readings_batch(r, 0, path)
    back = spark.read.parquet(path)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


_BOUNDS_SQL = _READ_SQL + """,
hist AS (SELECT * FROM rd WHERE ts < TIMESTAMP '2024-01-15'),
med AS (SELECT sensor_type, quantile_cont(value, 0.5) AS median FROM hist GROUP BY 1),
mad AS (SELECT h.sensor_type, m.median, quantile_cont(abs(h.value - m.median), 0.5) AS mad FROM hist h JOIN med m ON h.sensor_type = m.sensor_type GROUP BY 1, 2),
an AS (SELECT r.device_id, r.ts, r.shipment_id, r.sensor_type, r.value,
  CASE WHEN b.mad > 0 THEN 0.6745 * (r.value - b.median) / b.mad END AS z FROM rd r LEFT JOIN mad b ON r.sensor_type = b.sensor_type
  WHERE r.ts >= TIMESTAMP '2024-01-15'),
sev AS (SELECT *, CASE WHEN abs(z) > 6 THEN 'CRITICAL' WHEN abs(z) > 3 THEN 'WARNING' END AS severity FROM an)
"""


def anomalies(spark, sf):
    r = readings(spark, sf)
    bounds = ss.learn_bounds(r.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return ss.detect_anomalies(r.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")), bounds)


@register("ss5_anomaly_detection_batch", "WITH " + _BOUNDS_SQL + """
SELECT device_id, ts, sensor_type, CAST(round(CAST(z AS DECIMAL(38,8)), 4) AS DOUBLE) AS robust_z, severity FROM sev""")
def q_ss5(spark, sf):
    a = anomalies(spark, sf)
    return a.select("device_id", "ts", "sensor_type", round_half_up("robust_z", 4).alias("robust_z"), "severity")


@register("ss6_alerts_batch", "WITH " + _BOUNDS_SQL + """
SELECT shipment_id, CAST(count(*) AS BIGINT) AS n_anomalies, CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS BIGINT) AS n_critical,
  max(ts) AS last_anomaly_ts, CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 'ANOMALY_DETECTED' END AS status_event
FROM sev WHERE severity IS NOT NULL GROUP BY 1""")
def q_ss6(spark, sf):
    return ss.alerts(anomalies(spark, sf))


@register("ss7_dashboard_tumbling_batch", "WITH " + _READ_SQL + """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, shipment_id, sensor_type, CAST(count(*) AS BIGINT) AS n,
  CAST(round(CAST(avg(value) AS DECIMAL(38,8)), 4) AS DOUBLE) AS avg_value, max(value) AS max_value FROM rd GROUP BY 1, 2, 3""")
def q_ss7(spark, sf):
    d = ss.dashboard(readings(spark, sf), watermark=None)
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "shipment_id", "sensor_type", "n",
                    round_half_up("avg_value", 4).alias("avg_value"), "max_value")


@register("ss8_dedupe_batch", "WITH " + _READ_SQL + """
SELECT device_id, ts, sensor_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT device_id, ts, sensor_type FROM rd UNION ALL
  SELECT device_id, ts, sensor_type FROM rd WHERE battery < 5) GROUP BY 1, 2, 3""")
def q_ss8(spark, sf):
    """Readings with every low-battery reading delivered twice, then deduplicated
    and re-counted with the redelivered copies (the copies must not survive)."""
    r = readings(spark, sf)
    redelivered = r.unionByName(r.filter(F.col("battery") < 5))
    d = ss.dedupe(redelivered)
    again = d.unionByName(r.filter(F.col("battery") < 5))
    return again.groupBy("device_id", "ts", "sensor_type").agg(F.count(F.lit(1)).alias("n"))


@register("ss9_sliding_windows_batch", "WITH " + _READ_SQL + """,
w AS (SELECT device_id, value, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE AS ws FROM rd, range(0, 4) t(k))
SELECT ws AS window_start, device_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def q_ss9a(spark, sf):
    s = ss.sliding(readings(spark, sf))
    return s.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "device_id", "n", F.round("total", 4).alias("total"))


@register("ss9_session_windows_batch", "WITH " + _READ_SQL + """,
g AS (SELECT device_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY device_id ORDER BY ts) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM rd),
s AS (SELECT device_id, ts, sum(brk) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT device_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY device_id, sid""")
def q_ss9b(spark, sf):
    s = ss.sessions(readings(spark, sf))
    return s.select("device_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


@register("ss11_tracking_update_nearest_place", view_sql("places") + """,
loc AS (SELECT user_id, arg_max((CAST(user_id % 90 AS DOUBLE), CAST(user_id % 180 AS DOUBLE)), (ts, event_id)) AS p FROM events GROUP BY 1),
pairs AS (SELECT l.user_id, pl.place_id, """ + haversine_sql("l.p[1]", "l.p[2]", "pl.lat", "pl.lon") + """ AS d FROM loc l, places pl)
SELECT 'SHP-' || CAST(user_id AS VARCHAR) AS shipment_id, arg_min(place_id, (d, place_id)) AS nearest_place,
  CAST(round(CAST(min(d) AS DECIMAL(38,8)), 4) AS DOUBLE) AS distance_km FROM pairs GROUP BY user_id""")
def q_ss11(spark, sf):
    """Latest location per shipment from the readings, enriched with the nearest
    place (JN9) -- the upsert body of the tracking stream."""
    r = readings(spark, sf)
    latest = r.groupBy("shipment_id").agg(F.max_by(F.struct("lat", "lng"), F.struct("ts", "battery")).alias("p"))
    pts = latest.select("shipment_id", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lon"))
    nn = jn.nearest_neighbor(pts, places(spark, sf), "shipment_id", "lat", "lon", "place_id", "lat", "lon", metric="haversine")
    return nn.select("shipment_id", F.col("place_id").alias("nearest_place"), round_half_up("distance", 4).alias("distance_km"))


@register("ss14_request_rate_per_minute", """
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, user_id, CASE event_type WHEN 'view' THEN 'shipments'
  WHEN 'click' THEN 'inventory' WHEN 'purchase' THEN 'suppliers' WHEN 'signup' THEN 'analytics' ELSE 'ai' END AS kind,
  CAST(count(*) AS BIGINT) AS calls,
  count(*) > CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 200 WHEN 'purchase' THEN 150 WHEN 'signup' THEN 50 ELSE 30 END AS exceeded
FROM events GROUP BY 1, 2, 3, event_type""")
def q_ss14(spark, sf):
    ev = table(spark, sf, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "shipments", "click": "inventory", "purchase": "suppliers",
                                                           "signup": "analytics", "error": "ai"}.items() for x in kv]), F.col("event_type"))
    calls = ev.select("user_id", "ts", kind.alias("kind"))
    r = ss.request_rate(calls, "user_id", "kind", "ts")
    return r.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "kind", "calls", "exceeded")


@register("ss12_streaming_ledger_state", LG3_FOLD_SQL)
def q_ss12(spark, sf):
    """The exact acceptance fold run as a stream: the ledger arrives in four time-ordered deliveries, each
    spread over all tasks and folded with ``applyInPandasWithState`` from the state of the one before."""
    led = view(spark, sf, "ledger").select("shipment_id", "seq", "ts", "status")
    lo, hi = led.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return spark.createDataFrame([], "shipment_id bigint, seq bigint, status string, accepted boolean, state_after string")
    cuts = [lo + (hi - lo) / 4 * i for i in range(1, 4)]
    bounds = list(zip([None, *cuts], [*cuts, None]))
    deliveries = [led.filter((F.lit(True) if a is None else F.col("ts") >= F.lit(a)) & (F.lit(True) if b is None else F.col("ts") < F.lit(b)))
                  for a, b in bounds]
    out = run_deliveries(spark, deliveries, ss.running_ledger_state, "ledger")
    return out.withColumn("shipment_id", F.col("shipment_id").cast("bigint"))
