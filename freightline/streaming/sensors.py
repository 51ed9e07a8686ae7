"""IoT sensor messages to readings, anomalies, alerts and dashboards (SS1-SS9, SS11-SS14)."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import exact_quantiles

SENSOR_MESSAGE_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("metadata", T.StructType([T.StructField("shipment_id", T.StringType())])),
    T.StructField("readings", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()),
        T.StructField("coordinates", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]))]))),
    T.StructField("battery", T.DoubleType()),
    T.StructField("signal_strength", T.DoubleType()),
])
DEAD_LETTER_PAYLOAD_CHARS = 500
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# API rate limits per minute by endpoint group.
RATE_LIMITS_PER_MINUTE = {"shipments": 100, "inventory": 200, "suppliers": 150, "analytics": 50, "ai": 30}


def parse_messages(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """SS1: JSON text -> message struct ``m`` (null when unparseable), raw kept."""
    return raw.select(F.col(text_col).alias("raw"), F.from_json(F.col(text_col), SENSOR_MESSAGE_SCHEMA, JSON_OPTIONS).alias("m"))


def accepted(parsed: DataFrame) -> DataFrame:
    """SS2 accepted side: parsed with a device id -> one row per reading."""
    ok = parsed.filter(F.col("m").isNotNull() & F.col("m.device_id").isNotNull())
    return ok.select(F.col("m.device_id").alias("device_id"), F.col("m.timestamp").alias("ts"),
                     F.col("m.metadata.shipment_id").alias("shipment_id"), F.col("m.battery").alias("battery"),
                     F.col("m.signal_strength").alias("signal_strength"), F.explode_outer("m.readings").alias("r")) \
             .select("device_id", "ts", "shipment_id", "battery", "signal_strength", F.col("r.type").alias("sensor_type"),
                     F.col("r.value").alias("value"), F.col("r.unit").alias("unit"), F.col("r.coordinates.lat").alias("lat"),
                     F.col("r.coordinates.lng").alias("lng"))


def dead_letters(parsed: DataFrame, keep=()) -> DataFrame:
    """SS2 rejected side + SS3: error, device (if any) and the first 500 chars."""
    bad = parsed.filter(F.col("m").isNull() | F.col("m.device_id").isNull())
    err = F.when(F.col("m").isNull(), F.lit("unparseable JSON")).otherwise(F.lit("missing device_id"))
    return bad.select(*keep, err.alias("error"), F.col("m.device_id").alias("device_id"),
                      F.substring("raw", 1, DEAD_LETTER_PAYLOAD_CHARS).alias("payload"))


def write_readings_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """SS4 sink for ``foreachBatch``: one folder per batch id written with
    overwrite, so a replayed batch replaces itself (idempotent)."""
    (batch.withColumn("date", F.to_date("ts"))
          .write.mode("overwrite").partitionBy("date").parquet(f"{path.rstrip('/')}/batch_id={batch_id}"))


def learn_bounds(history: DataFrame) -> DataFrame:
    """SS5 (our definition): per sensor type median and MAD of the value, learnt in batch; exact quantiles by
    selection over counted bins, so a frequent type is spread over all tasks."""
    med = exact_quantiles(history, "value", [0.5], ["sensor_type"]).select("sensor_type", F.col("q")[0].alias("median"))
    dev = history.select("sensor_type", "value").join(med, "sensor_type").select("sensor_type", F.abs(F.col("value") - F.col("median")).alias("_d"))
    mad = exact_quantiles(dev, "_d", [0.5], ["sensor_type"]).select("sensor_type", F.col("q")[0].alias("mad"))
    return med.join(mad, "sensor_type")


def detect_anomalies(readings: DataFrame, bounds: DataFrame, warn_z: float = 3.0, crit_z: float = 6.0) -> DataFrame:
    """SS5: robust z = 0.6745 (x - median) / MAD against the learnt bounds
    (a stream-static join; the bounds table has one row per sensor type).
    Types without bounds flow through unflagged."""
    j = readings.join(bounds, "sensor_type", "left")
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col("value") - F.col("median")) / F.col("mad"))
    sev = F.when(F.abs(z) > crit_z, "CRITICAL").when(F.abs(z) > warn_z, "WARNING")
    return j.withColumn("robust_z", z).withColumn("severity", sev)


def alerts(anomalies: DataFrame) -> DataFrame:
    """SS6: per shipment and window of the stream, alert counts; a CRITICAL
    reading produces a status event ANOMALY_DETECTED for the ledger."""
    a = anomalies.filter(F.col("severity").isNotNull())
    return a.groupBy("shipment_id").agg(F.count(F.lit(1)).alias("n_anomalies"),
                                        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
                                        F.max("ts").alias("last_anomaly_ts")) \
            .withColumn("status_event", F.when(F.col("n_critical") > 0, F.lit("ANOMALY_DETECTED")))


def dashboard(readings: DataFrame, window: str = "1 hour", watermark: str | None = "2 hours") -> DataFrame:
    """SS7: tumbling-window aggregate per shipment and sensor type."""
    r = readings.withWatermark("ts", watermark) if watermark else readings
    return r.groupBy(F.window("ts", window).alias("w"), "shipment_id", "sensor_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))


def dedupe(readings: DataFrame, watermark: str | None = "10 minutes", streaming: bool = False) -> DataFrame:
    """SS8: duplicate deliveries (same device, time, type) dropped; in a stream
    the state is bounded by the watermark."""
    keys = ["device_id", "ts", "sensor_type"]
    if streaming:
        return readings.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)
    return readings.dropDuplicates(keys)


def sliding(readings: DataFrame, size: str = "1 hour", slide: str = "15 minutes", watermark: str | None = None) -> DataFrame:
    """SS9: sliding windows per device."""
    r = readings.withWatermark("ts", watermark) if watermark else readings
    return r.groupBy(F.window("ts", size, slide).alias("w"), "device_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(readings: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """SS9: session windows per device."""
    r = readings.withWatermark("ts", watermark) if watermark else readings
    return r.groupBy(F.session_window("ts", gap).alias("s"), "device_id").agg(F.count(F.lit(1)).alias("n"))


def request_rate(calls: DataFrame, user: str, kind: str, ts: str, watermark: str | None = None) -> DataFrame:
    """SS14: calls per user and endpoint group per minute, flagged above the
    configured per-minute limit."""
    r = calls.withWatermark(ts, watermark) if watermark else calls
    lim = F.element_at(F.create_map(*[F.lit(x) for kv in RATE_LIMITS_PER_MINUTE.items() for x in kv]), F.col(kind))
    g = r.groupBy(F.window(ts, "1 minute").alias("w"), user, kind).agg(F.count(F.lit(1)).alias("calls"))
    return g.withColumn("limit", lim).withColumn("exceeded", F.coalesce(F.col("calls") > F.col("limit"), F.lit(False)))


# ------------------------------------------------------ SS12 streaming ledger

# Shipments share groups by a hash of their id: a group's call in Python costs far more than the few events a
# shipment has in a micro-batch.  The number is part of the state's keys, so a running stream must keep it.
LEDGER_GROUPS = 2048
STATE_SCHEMA = "held ARRAY<STRUCT<shipment_id: STRING, status: STRING>>"
LEDGER_OUT_SCHEMA = "shipment_id STRING, seq LONG, status STRING, accepted BOOLEAN, state_after STRING"


def _fold_state(key, pdfs: Iterator[pd.DataFrame], state):
    from ..plans.ledger import TRANSITIONS
    allowed = {k: set(v) for k, v in TRANSITIONS.items()}
    frames = list(pdfs)
    if not frames:
        return
    held = {k: v for k, v in state.get[0]} if state.exists else {}
    pdf = pd.concat(frames).sort_values(["ts", "seq"], kind="mergesort")
    acc, after = [], []
    for shipment, st in zip(pdf["shipment_id"].tolist(), pdf["status"].tolist()):
        cur = held.get(shipment)
        ok = (st == "CREATED") if cur is None else (st in allowed.get(cur, ()))
        if ok:
            held[shipment] = cur = st
        acc.append(ok)
        after.append(cur)
    state.update((list(held.items()),))
    yield pd.DataFrame({"shipment_id": pdf["shipment_id"], "seq": pdf["seq"], "status": pdf["status"],
                        "accepted": acc, "state_after": after})


def running_ledger_state(events: DataFrame) -> DataFrame:
    """SS12: per-shipment state carried across micro-batches with
    ``applyInPandasWithState``; within a batch a shipment's events are
    folded in (ts, seq) order from its stored status.  The state of a group holds
    the status of each of its shipments that has been created."""
    e = events.select(F.col("shipment_id").cast("string").alias("shipment_id"), "seq", "ts", "status")
    e = e.withColumn("grp", F.pmod(F.xxhash64("shipment_id"), F.lit(LEDGER_GROUPS)))
    return e.groupBy("grp").applyInPandasWithState(
        _fold_state, outputStructType=LEDGER_OUT_SCHEMA, stateStructType=STATE_SCHEMA,
        outputMode="append", timeoutConf="NoTimeout")


def events_to_messages(events: DataFrame) -> DataFrame:
    """Sensor messages (JSON text) built from event rows -- the test feed."""
    reading = F.struct(F.upper(F.col("event_type")).alias("type"), F.col("value").alias("value"), F.lit("u").alias("unit"),
                       F.struct((F.col("user_id") % 90).cast("double").alias("lat"), (F.col("user_id") % 180).cast("double").alias("lng")).alias("coordinates"))
    msg = F.struct(F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
                   F.col("ts").cast("timestamp").alias("timestamp"),
                   F.struct(F.concat(F.lit("SHP-"), F.col("user_id").cast("string")).alias("shipment_id")).alias("metadata"),
                   F.array(reading).alias("readings"), (F.col("event_id") % 100).cast("double").alias("battery"),
                   F.lit(-70.0).alias("signal_strength"))
    # every 97th message is malformed (device id missing) to exercise the dead-letter path
    bad = F.to_json(F.struct(F.col("ts").cast("timestamp").alias("timestamp"), F.array(reading).alias("readings")), JSON_OPTIONS)
    return events.select("event_id", F.when(F.col("event_id") % 97 == 0, bad).otherwise(F.to_json(msg, JSON_OPTIONS)).alias("value"))
