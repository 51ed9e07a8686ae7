"""Feed and hand-off queries (SRC7, SRC13, SS13)."""
from pyspark.sql import functions as F

from ..plans import disruption as dz
from ..session import scratch_path
from ..sources.views import view, view_sql
from . import REGISTRY, register
from .demand import demand_features
from .models import disruption_frame


@register("src7_feature_handoff_parquet", REGISTRY["wn1_wn2_lag_rolling_features"][1])
def q_src7(spark, sf):
    """Feature table handed between pipeline steps as Parquet (the reference
    uses Feather): written once, read back by the next step."""
    path = scratch_path(spark, "features")
    f = demand_features(spark, sf).select("series_id", "ds", F.round("y", 4).alias("y"), F.round("y_lag7", 4).alias("y_lag7"),
                                          F.round("y_roll7", 4).alias("y_roll7"))
    f.write.mode("overwrite").partitionBy("series_id").parquet(path)
    return spark.read.parquet(path).select("series_id", "ds", "y", "y_lag7", "y_roll7")


@register("src13_ledger_event_feed_stream", view_sql("ledger") + "SELECT shipment_id, seq, ts, status FROM ledger")
def q_src13(spark, sf):
    """Ledger events published as JSON files and consumed with ``readStream``
    + ``from_json`` (replacing the polling loop); the stream lands in Parquet."""
    src = scratch_path(spark, "ledger-feed")
    led = view(spark, sf, "ledger").select("shipment_id", "seq", "ts", "status")
    led.select(F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value")) \
       .repartitionByRange(4, "value").write.mode("overwrite").text(src)
    out = scratch_path(spark, "ledger-feed-out")
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(src)
    parsed = raw.select(F.from_json("value", "shipment_id BIGINT, seq BIGINT, ts TIMESTAMP_NTZ, status STRING",
                                    {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("e")).select("e.*")
    q = (parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@register("ss13_live_disruption_scoring_stream")
def q_ss13(spark, sf):
    """A fitted pipeline scores shipments arriving as a stream; the alert
    summary (AG15) is computed from the scored sink."""
    frame = disruption_frame(spark, sf)
    model = dz.disruption_pipeline(max_iter=5).fit(frame)
    src = scratch_path(spark, "disruption-feed")
    frame.write.mode("overwrite").parquet(src)
    out = scratch_path(spark, "disruption-scored")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4).parquet(src)
    scored = dz.score(model, stream).select("event_id", "zip_code", "ts", "risk_probability", "alert", "risk_level")
    q = (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    s = spark.read.parquet(out)
    return s.filter("alert").groupBy(F.to_date("ts").alias("ds")).agg(
        F.count(F.lit(1)).alias("n_high_risk"), F.array_join(F.array_sort(F.collect_set(F.col("zip_code").cast("string"))), ",").alias("locations"))
