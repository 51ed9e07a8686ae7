"""Deliveries of a stream: state and watermark carry over, late rows stay out, copies come out once."""
import datetime as dt

from freightline.streaming import sensors as ss
from freightline.streaming.replay import run_deliveries

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "device_id string, shipment_id string, sensor_type string, ts timestamp, value double"


def delivery(spark, *minutes):
    return spark.createDataFrame([("d", "s", "T", T0 + dt.timedelta(minutes=m), float(m)) for m in minutes], SCHEMA)


def test_late_rows_stay_out_and_open_windows_carry_over(spark):
    feeds = [delivery(spark, 5, 65, 190), delivery(spark, 10, 70, 195, 400)]
    got = {(r["w"]["start"].replace(tzinfo=None) - T0).seconds // 3600: r["n"]
           for r in run_deliveries(spark, feeds, ss.dashboard, "t").collect()}
    # after the first delivery the watermark is at minute 70: minute 10 is late, 70 still counts
    assert got == {0: 1, 1: 2, 3: 2}


def test_copies_of_a_second_delivery_are_dropped(spark):
    feeds = [delivery(spark, 1, 2, 2), delivery(spark, 2, 3), delivery(spark)]
    rows = run_deliveries(spark, feeds, lambda r: ss.dedupe(r, streaming=True), "t").collect()
    assert sorted(r["value"] for r in rows) == [1.0, 2.0, 3.0]


def test_sink_is_called_with_growing_ids(spark):
    seen = []
    assert run_deliveries(spark, [delivery(spark, 1), delivery(spark, 2)], lambda r: r, "t", lambda b, i: seen.append((i, b.count()))) is None
    assert [n for _, n in sorted(set(seen)) if n] == [1, 1]
