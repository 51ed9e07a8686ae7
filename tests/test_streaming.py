"""Structured Streaming runs (file source, availableNow) compared with the batch form."""
import os
import tempfile

from pyspark.sql import functions as F

from freightline.sources.tables import table
from freightline.sources.views import view
from freightline.streaming import sensors as ss


def _msgs(spark, sf, folder):
    m = ss.events_to_messages(table(spark, sf, "events")).select("value")
    m.repartition(3).write.mode("overwrite").text(folder)
    return folder


def _run(query, name):
    q = query.queryName(name).format("memory").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_sensor_stream_equals_batch(spark, sf_small):
    d = tempfile.mkdtemp(prefix="fl-msgs-")
    _msgs(spark, sf_small, d)
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(d)
    acc = ss.accepted(ss.parse_messages(stream))
    _run(acc.writeStream.outputMode("append").option("checkpointLocation", d + "-ck1"), "acc")
    batch = ss.accepted(ss.parse_messages(spark.read.text(d)))
    assert spark.table("acc").count() == batch.count() > 0
    dl = ss.dead_letters(ss.parse_messages(stream))
    _run(dl.writeStream.outputMode("append").option("checkpointLocation", d + "-ck2"), "dl")
    got = spark.table("dl").collect()
    assert got and all(r.error == "missing device_id" and len(r.payload) <= 500 for r in got)


def test_dedupe_within_watermark(spark, sf_small):
    d = tempfile.mkdtemp(prefix="fl-dup-")
    _msgs(spark, sf_small, d)
    # redeliver the first file as a duplicate delivery
    first = sorted(f for f in os.listdir(d) if f.startswith("part-"))[0]
    dup = d + "-dup"
    os.makedirs(dup)
    os.link(os.path.join(d, first), os.path.join(dup, "part-dup.txt"))
    stream = spark.readStream.format("text").load(d + "*")
    r = ss.accepted(ss.parse_messages(stream))
    out = ss.dedupe(r, "1 day", streaming=True)
    _run(out.writeStream.outputMode("append").option("checkpointLocation", d + "-ck"), "dedup")
    batch = ss.accepted(ss.parse_messages(spark.read.text(d))).dropDuplicates(["device_id", "ts", "sensor_type"])
    assert spark.table("dedup").count() == batch.count()


def test_dashboard_windows_with_closing_event(spark, sf_small):
    d = tempfile.mkdtemp(prefix="fl-win-")
    _msgs(spark, sf_small, d)
    # a closing message far in the future moves the watermark past every real window
    closing = '{"device_id":"dev-close","timestamp":"2030-01-01T00:00:00.000000Z","metadata":{"shipment_id":"X"},' \
              '"readings":[{"type":"VIEW","value":1.0,"unit":"u","coordinates":{"lat":0.0,"lng":0.0}}]}'
    cdir = d + "-close"
    os.makedirs(cdir)
    with open(os.path.join(cdir, "z.txt"), "w") as fh:
        fh.write(closing + "\n")
    # the message files each span the whole month, so they arrive in one batch
    # (a second file read after the watermark moved would rightly be late)
    src = spark.readStream.format("text").load(d + "*")
    r = ss.accepted(ss.parse_messages(src))
    agg = ss.dashboard(r, "1 hour", "2 hours")
    _run(agg.writeStream.outputMode("append").option("checkpointLocation", d + "-ck"), "dash")
    got = spark.table("dash").filter(F.col("shipment_id") != "X")
    batch = ss.dashboard(ss.accepted(ss.parse_messages(spark.read.text(d))), "1 hour", None)
    assert got.count() == batch.count()
    assert got.agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]


def test_ledger_feed_upsert_latest_state(spark, sf_small):
    """SRC13 + LG2: ledger events arrive as JSON files; each micro-batch upserts
    the latest state per shipment into a table (idempotent per batch id)."""
    from freightline.plans.ledger import latest_state
    d = tempfile.mkdtemp(prefix="fl-ledger-")
    led = view(spark, sf_small, "ledger").select("shipment_id", "seq", "ts", "status")
    led.repartitionByRange(4, "ts").write.mode("overwrite").json(d)
    state_path = d + "-state"

    def upsert(batch, batch_id):
        cur = latest_state(batch)
        try:
            old = spark.read.parquet(state_path)
        except Exception:  # first batch: no table yet
            old = None
        merged = cur if old is None else old.unionByName(cur)
        best = merged.groupBy("shipment_id").agg(F.max_by(F.struct("status", "last_update", "last_seq", "n_events"),
                                                          F.struct("last_update", "last_seq")).alias("s"),
                                                 F.sum("n_events").alias("n_total"))
        out = best.select("shipment_id", "s.status", "s.last_update", "s.last_seq", F.col("n_total").alias("n_events"))
        tmp = f"{state_path}-b{batch_id}"
        out.write.mode("overwrite").parquet(tmp)
        spark.read.parquet(tmp).write.mode("overwrite").parquet(state_path)

    stream = spark.readStream.schema(led.schema).option("maxFilesPerTrigger", 1).json(d)
    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", d + "-ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.shipment_id: (r.status, r.last_seq) for r in spark.read.parquet(state_path).collect()}
    want = {r.shipment_id: (r.status, r.last_seq) for r in latest_state(led).collect()}
    assert got == want


def test_live_disruption_scoring_stream(spark, sf_small):
    """SS13: a fitted pipeline scores a stream of shipments; alerts above 0.35."""
    from freightline.catalog.models import disruption_frame
    from freightline.plans import disruption as dz
    frame = disruption_frame(spark, sf_small)
    model = dz.disruption_pipeline(max_iter=3).fit(frame)
    d = tempfile.mkdtemp(prefix="fl-dis-")
    frame.write.mode("overwrite").parquet(d)
    stream = spark.readStream.schema(frame.schema).parquet(d)
    scored = dz.score(model, stream).select("event_id", "risk_probability", "alert", "risk_level")
    _run(scored.writeStream.outputMode("append").option("checkpointLocation", d + "-ck"), "scored")
    got = spark.table("scored")
    assert got.count() == frame.count()
    assert got.filter((F.col("risk_probability") > 0.35) != F.col("alert")).count() == 0


def test_ledger_stream_calls_grow_slower_than_shipments(spark, monkeypatch):
    """Many shipments share a call of the fold, and each is still folded alone, across deliveries."""
    from freightline.plans.ledger import exact_fold
    from freightline.streaming.replay import run_deliveries
    rows = [(i, 10 * k + i % 7, t, s) for i in range(300) for k, (t, s) in enumerate(
        [(1, "DISPATCHED"), (2, "CREATED"), (3, "CREATED"), (4, "DISPATCHED"), (6, "DELIVERED"), (7, "IN_TRANSIT"), (8, "DELIVERED")])
        if (i + k) % 5]
    led = spark.createDataFrame(rows, "shipment_id long, seq long, t long, status string").selectExpr(
        "shipment_id", "seq", "timestamp_seconds(t) AS ts", "status")
    calls, fold = spark.sparkContext.accumulator(0), ss._fold_state

    def counted(key, pdfs, state):
        calls.add(1)
        yield from fold(key, pdfs, state)

    monkeypatch.setattr(ss, "_fold_state", counted)
    monkeypatch.setattr(ss, "LEDGER_GROUPS", 16, raising=False)
    out = run_deliveries(spark, [led.filter("ts < timestamp_seconds(5)"), led.filter("ts >= timestamp_seconds(5)")],
                         ss.running_ledger_state, "ledger-test")
    cols = ["shipment_id", "seq", "status", "accepted", "state_after"]
    got = {tuple(r) for r in out.withColumn("shipment_id", F.col("shipment_id").cast("long")).select(cols).collect()}
    assert got == {tuple(r) for r in exact_fold(led).select(cols).collect()} and len(got) == len(rows)
    assert calls.value <= 4 * 16
