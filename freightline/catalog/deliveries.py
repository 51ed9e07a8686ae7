"""Windows, sessions, deduplication, request rates and the readings sink as streams (SS4, SS7-SS9, SS14).

The feed comes in two deliveries: readings before ``SPLIT``, then the rest together with every fiftieth
early reading.  Such a late reading counts only where the watermark left its window open, and windows
that the last watermark leaves open are not emitted; the SQL states both rules."""
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..session import scratch_path
from ..sources.tables import table
from ..streaming import sensors as ss
from ..streaming.replay import run_deliveries
from . import register

SPLIT = "2024-01-20 00:00:00"
R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"
_EARLY = f"ts < TIMESTAMP '{SPLIT}' AND event_id % 50 <> 0"


def _feed_sql(delay: str, where: str = "event_id % 97 <> 0") -> str:
    """Readings with their delivery ``b``, and the watermarks after each delivery."""
    return f"""WITH rd AS (SELECT 'dev-' || CAST(user_id AS VARCHAR) AS device_id, ts, 'SHP-' || CAST(user_id AS VARCHAR) AS shipment_id,
  upper(event_type) AS sensor_type, event_type, user_id, value, event_id, CASE WHEN {_EARLY} THEN 1 ELSE 2 END AS b FROM events WHERE {where}),
wm AS (SELECT date_trunc('milliseconds', max(ts) FILTER (WHERE b = 1)) - INTERVAL {delay} AS w1, date_trunc('milliseconds', max(ts)) - INTERVAL {delay} AS w2 FROM rd)
"""


def _deliveries(df):
    early = F.expr(_EARLY)
    return [df.filter(early), df.filter(~early)]


def _messages(spark, sf):
    return [ss.events_to_messages(d) for d in _deliveries(table(spark, sf, "events"))]


def _readings(raw):
    return ss.accepted(ss.parse_messages(raw))


def _at(name):
    return F.col(name).cast("timestamp_ntz")


@register("ss4_readings_sink_stream", _feed_sql("2 HOUR") + "SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS n FROM rd GROUP BY 1")
def q_ss4_stream(spark, sf):
    """Readings land per batch id; every batch is written twice, as after a failure, and counts once."""
    path = scratch_path(spark, "readings-stream")

    def sink(batch, batch_id):
        for _ in range(2):
            ss.write_readings_batch(batch, batch_id, path)

    run_deliveries(spark, _messages(spark, sf), _readings, "ss4", sink)
    return spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@register("ss7_dashboard_stream", _feed_sql("2 HOUR") + f"""
SELECT ws AS window_start, shipment_id, sensor_type, CAST(count(*) AS BIGINT) AS n, {R.format('avg(value)')} AS avg_value, max(value) AS max_value
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS ws FROM rd), wm
WHERE (b = 1 OR ws + INTERVAL 1 HOUR > w1) AND ws + INTERVAL 1 HOUR <= w2 GROUP BY 1, 2, 3""")
def q_ss7_stream(spark, sf):
    d = run_deliveries(spark, _messages(spark, sf), lambda raw: ss.dashboard(_readings(raw)), "ss7")
    return d.select(_at("w.start").alias("window_start"), "shipment_id", "sensor_type", "n",
                    round_half_up("avg_value", 4).alias("avg_value"), "max_value")


@register("ss7_late_readings", _feed_sql("2 HOUR") + """
SELECT CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS n FROM rd, wm
WHERE b = 2 AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= w1 GROUP BY 1""")
def q_ss7_late(spark, sf):
    """Readings per day that the dashboard's watermark shut out: all that arrived less those counted and
    those whose window is still open."""
    messages = _messages(spark, sf)
    arrived = _readings(messages[0].unionByName(messages[1])).groupBy(F.window("ts", "1 hour")["start"].alias("at")).agg(F.count(F.lit(1)).alias("n"))
    counted = run_deliveries(spark, messages, lambda raw: ss.dashboard(_readings(raw)), "ss7-late").groupBy(
        F.col("w.start").alias("at")).agg(F.sum("n").alias("counted"))
    last = counted.agg(F.max("at")).scalar()
    late = arrived.filter(F.col("at") <= last).join(counted, "at", "left").select("at", (F.col("n") - F.coalesce("counted", F.lit(0))).alias("n"))
    return late.filter("n > 0").groupBy(F.to_date("at").alias("date")).agg(F.sum("n").alias("n"))


@register("ss8_dedupe_stream", _feed_sql("10 MINUTE") + """
SELECT device_id, ts, sensor_type, 1::BIGINT AS n FROM rd, wm WHERE b = 1 OR ts > w1 GROUP BY 1, 2, 3""")
def q_ss8_stream(spark, sf):
    """The last day of the first delivery is delivered again with the second; no copy comes out twice."""
    first, second = _deliveries(table(spark, sf, "events"))
    again = first.filter(F.col("ts") >= F.expr(f"TIMESTAMP '{SPLIT}' - INTERVAL 1 DAY"))
    feeds = [ss.events_to_messages(first), ss.events_to_messages(second.unionByName(again))]
    d = run_deliveries(spark, feeds, lambda raw: ss.dedupe(_readings(raw), streaming=True).select("device_id", "ts", "sensor_type"), "ss8")
    return d.groupBy("device_id", _at("ts").alias("ts"), "sensor_type").agg(F.count(F.lit(1)).alias("n"))


@register("ss9_sliding_windows_stream", _feed_sql("2 HOUR") + """,
w AS (SELECT device_id, value, b, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE AS ws FROM rd, range(0, 4) t(k))
SELECT ws AS window_start, device_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM w, wm
WHERE (b = 1 OR ws + INTERVAL 1 HOUR > w1) AND ws + INTERVAL 1 HOUR <= w2 GROUP BY 1, 2""")
def q_ss9_sliding_stream(spark, sf):
    s = run_deliveries(spark, _messages(spark, sf), lambda raw: ss.sliding(_readings(raw), watermark="2 hours"), "ss9-sliding")
    return s.select(_at("w.start").alias("window_start"), "device_id", "n", F.round("total", 4).alias("total"))


def _sessions_sql(rows: str, out: str) -> str:
    return f"""{out}_g AS (SELECT device_id, ts, b, CASE WHEN ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM {rows}),
{out}_s AS (SELECT device_id, ts, b, sum(brk) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM {out}_g),
{out} AS (SELECT *, max(ts) OVER (PARTITION BY device_id, sid) + INTERVAL 30 MINUTE AS session_end FROM {out}_s)"""


@register("ss9_session_windows_stream", _feed_sql("2 HOUR") + f""",
r1 AS (SELECT * FROM rd WHERE b = 1), {_sessions_sql('r1', 'one')},
r2 AS (SELECT device_id, ts, b FROM one, wm WHERE session_end > w1 UNION ALL
       SELECT device_id, ts, b FROM rd, wm WHERE b = 2 AND ts + INTERVAL 30 MINUTE > w1), {_sessions_sql('r2', 'two')},
done AS (SELECT device_id, sid, 1 AS d, ts, session_end FROM one, wm WHERE session_end <= w1 UNION ALL
         SELECT device_id, sid, 2 AS d, ts, session_end FROM two, wm WHERE session_end <= w2)
SELECT device_id, min(ts) AS session_start, max(session_end) AS session_end, CAST(count(*) AS BIGINT) AS n FROM done GROUP BY device_id, sid, d""")
def q_ss9_sessions_stream(spark, sf):
    s = run_deliveries(spark, _messages(spark, sf), lambda raw: ss.sessions(_readings(raw), watermark="2 hours"), "ss9-sessions")
    return s.select("device_id", _at("s.start").alias("session_start"), _at("s.end").alias("session_end"), "n")


@register("ss14_request_rate_stream", _feed_sql("5 MINUTE", "true") + """
SELECT ws AS window_start, user_id, CASE event_type WHEN 'view' THEN 'shipments' WHEN 'click' THEN 'inventory' WHEN 'purchase' THEN 'suppliers'
  WHEN 'signup' THEN 'analytics' ELSE 'ai' END AS kind, CAST(count(*) AS BIGINT) AS calls,
  count(*) > CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 200 WHEN 'purchase' THEN 150 WHEN 'signup' THEN 50 ELSE 30 END AS exceeded
FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, ts) AS ws FROM rd), wm
WHERE (b = 1 OR ws + INTERVAL 1 MINUTE > w1) AND ws + INTERVAL 1 MINUTE <= w2 GROUP BY 1, 2, 3, event_type""")
def q_ss14_stream(spark, sf):
    kinds = {"view": "shipments", "click": "inventory", "purchase": "suppliers", "signup": "analytics", "error": "ai"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    calls = [d.select("user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind")) for d in _deliveries(table(spark, sf, "events"))]
    r = run_deliveries(spark, calls, lambda c: ss.request_rate(c, "user_id", "kind", "ts", watermark="5 minutes"), "ss14")
    return r.select(_at("w.start").alias("window_start"), "user_id", "kind", "calls", "exceeded")
