"""Route comparison, dispatch records and map layers on small hand-made rows."""
import json

from pyspark.sql import functions as F

from freightline.plans import routes as rt
from freightline.sources import files as fs


def reply(*sections):
    return json.dumps({"paths": [{"distance": sum(s["distance"] for s in sections), "time": int(sum(s["duration"] for s in sections) * 1000),
                                  "points": "", "sections": list(sections), "instructions": [], "tolls": []}]})


def section(start, distance, duration, **more):
    return {"start": start, "distance": distance, "duration": duration, "road_type": "road", **more}


def test_route_validity_by_section(spark):
    rows = [(1, 5000.0, 4.2, reply(section(0, 10.0, 1.0))), (2, 5000.0, 4.2, reply(section(0, 10.0, 1.0), section(1, 5.0, 1.0, road_type="tunnel"))),
            (3, 12000.0, 3.0, reply(section(0, 10.0, 1.0, road_type="bridge"))),
            (4, 12000.0, 3.0, reply(section(0, 10.0, 1.0, road_type="bridge", weight_limit=20000.0))), (5, 12000.0, None, reply())]
    df = spark.createDataFrame(rows, "id long, w double, h double, reply string")
    got = {r["id"]: r["valid"] for r in rt.route_validity(rt.parse_reply(df, "reply"), "h", "w").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_compare_routes_first_minus_alternative(spark):
    df = spark.createDataFrame([(1, 0, 100.0, None), (1, 1, 130.0, 2.0), (1, 2, 90.0, 1.0), (2, 0, 5.0, 1.0)], "id long, rank int, time double, eco double")
    got = {(r["id"], r["rank"]): (r["time_diff"], r["eco_diff"]) for r in rt.compare_routes(df, ["id"], "rank", ["time", "eco"]).collect()}
    assert got == {(1, 1): (-30.0, None), (1, 2): (10.0, None)}


def test_dispatch_payload_json(spark):
    df = spark.createDataFrame([(7, "ann", "van", reply(section(0, 30000.0, 1200.5), section(1, 30000.0, 1200.0))), (8, "bo", "truck", reply())],
                               "id long, driver string, vehicle string, reply string").withColumn("at", F.lit("2024-02-28 23:50:00").cast("timestamp_ntz"))
    got = {r["id"]: json.loads(r["payload_json"]) for r in rt.dispatch_payload(rt.parse_reply(df, "reply"), "id", "driver", "vehicle", "at").collect()}
    first = got[7]
    assert first["route_id"] == "route-7-0" and first["planned_departure"].startswith("2024-02-28T23:50:00")
    assert first["estimated_arrival"].startswith("2024-02-29T00:30:00")
    assert [c["eta"][:19] for c in first["checkpoints"]] == ["2024-02-29T00:10:00", "2024-02-29T00:30:00"]
    assert first["environmental_impact"]["co2_kg"] == 7.2 and first["compliance_status"] == {"passed": True, "issues": []}
    assert got[8]["checkpoints"] == [] and got[8]["estimated_arrival"] == got[8]["planned_departure"]


def test_map_layers(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], True, "cold_storage", "flood", "heavy rain"), ([[1.0, 2.0]], None, None, None, None)],
                               "coords array<array<double>>, good boolean, kind string, risk string, sky string")
    lines = [json.loads(r["feature"]) for r in fs.optimized_route_feature(df, "coords", "good", ["kind"]).collect()]
    assert [x["properties"]["style"] for x in lines] == [{"color": "#00cc00"}, {"color": "#ff3300", "dash_array": "5"}]
    marks = [tuple(r) for r in df.select(*(v.alias(k) for k, v in fs.warehouse_marker("kind").items())).collect()]
    assert marks == [("snowflake", "blue"), ("warehouse", "gray")]
    assert [r[0] for r in df.select(fs.weather_marker("sky")["popup"]).collect()] == ["Weather Alert: Heavy Rain", None]
    zones = [json.loads(r["feature"])["properties"] for r in fs.risk_zone_feature(df, "coords", "risk", ["kind"]).collect()]
    assert zones[0]["layer"] == "Flood Risk Zone" and zones[0]["fillColor"] == "#0066cc" and "fillColor" not in zones[1]


def test_feature_files_are_compressed(spark, sf_small):
    """The written features take a small part of their text; the rows read back are whole."""
    import os
    from freightline.catalog import mapfeed
    out = mapfeed.q_src11_routes(spark, sf_small)
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file:"))
    parts = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts)
    text = spark.read.text(folder)
    assert text.count() == out.count() > 0
    assert sum(os.path.getsize(f"{folder}/{f}") for f in parts) * 4 < text.selectExpr("sum(length(value))").first()[0]


def test_tour_planning_partitions_follow_the_rows(spark, monkeypatch):
    """More rows, more tasks of the same size; rows of one stop are one visit with all its load."""
    monkeypatch.setattr(rt, "TOUR_ROWS", 100, raising=False)
    rows = [(t, s, 10.0 + s / 100, 20.0, 3000.0) for t in range(250) for s in (1, 2, 3, 2)]
    df = spark.createDataFrame(rows, "tour long, stop long, lat double, lon double, load double")
    out = rt.multi_stop_tours(df, "tour", "stop", "lat", "lon", "load")
    assert out.rdd.getNumPartitions() == 10
    got = {}
    for r in out.orderBy("tour", "visit").collect():
        got.setdefault(r.tour, []).append((r.stop, r.trip))
    assert len(got) == 250 and set(map(tuple, got.values())) == {((1, 0), (2, 1), (3, 2))}


def test_tours_start_at_the_first_line_and_end_at_the_customer(spark, sf_small):
    """The depot is the supplier of an order's first line, whatever its key; the customer is the last visit."""
    from freightline.catalog import routes
    from freightline.sources.tables import table
    got = {}
    for r in routes.q_gn14(spark, sf_small).orderBy("tour", "visit").collect():
        got.setdefault(r.tour, []).append((r.stop, r.is_end))
    customer = {r.o_orderkey: r.o_custkey for r in table(spark, sf_small, "orders").collect()}
    lines = {}
    for r in table(spark, sf_small, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_suppkey").collect():
        lines.setdefault(r.l_orderkey, []).append(r.l_suppkey)
    assert set(got) == set(lines) and any(v[0] != min(v) for v in lines.values())
    for tour, visits in got.items():
        assert visits[0] == (lines[tour][0], False) and visits[-1] == (customer[tour], True)
        assert sorted(s for s, end in visits if not end) == sorted(set(lines[tour]))


def test_two_opt_keeps_both_ends():
    """Against all orders of the stops between depot and destination no reversal is left that shortens the way."""
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 8):
        xy = np.column_stack([rng.uniform(40, 50, n), rng.uniform(0, 10, n)])
        order = rt._tour_order(xy, closed=True)
        length = lambda o: sum(rt._haversine(xy[a], xy[b]) for a, b in zip(o, o[1:]))
        assert order[0] == 0 and order[-1] == n - 1 and sorted(order) == list(range(n))
        turned = [order[:i] + order[i:k + 1][::-1] + order[k + 1:] for i in range(1, n - 1) for k in range(i + 1, n - 1)]
        assert all(length(o) >= length(order) - 1e-6 for o in turned)


def test_tours_without_end_or_stops(spark):
    """A tour without destination ends at its last stop; a destination without stops is no tour."""
    df = spark.createDataFrame([(1, 7, 10.0, 20.0, 1.0, 2), (1, 3, 11.0, 20.0, 1.0, None), (2, 5, 12.0, 20.0, 1.0, 1)],
                               "tour long, stop long, lat double, lon double, load double, line int")
    ends = spark.createDataFrame([(2, 5, 12.5, 20.0), (9, 4, 0.0, 0.0)], "tour long, stop long, lat double, lon double")
    out = rt.multi_stop_tours(df, "tour", "stop", "lat", "lon", "load", first="line", ends=ends)
    assert [(r.tour, r.stop, r.is_end) for r in out.orderBy("tour", "visit").collect()] == [
        (1, 7, False), (1, 3, False), (2, 5, False), (2, 5, True)]
