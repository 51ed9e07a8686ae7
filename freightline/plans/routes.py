"""Route replies, sections, schedules and multi-stop tours (GN14-GN19, PRJ16-18, PRJ21, AG10-11, CB13)."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import carbon as cb

# Schema of a routing reply (distance m, time ms, sections, instructions, tolls).
ROUTE_REPLY_SCHEMA = T.StructType([T.StructField("paths", T.ArrayType(T.StructType([
    T.StructField("distance", T.DoubleType()), T.StructField("time", T.LongType()), T.StructField("points", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("distance", T.DoubleType()),
        T.StructField("duration", T.DoubleType()), T.StructField("road_type", T.StringType()),
        T.StructField("speed_limit", T.DoubleType()), T.StructField("height_clearance", T.DoubleType()),
        T.StructField("weight_limit", T.DoubleType())]))),
    T.StructField("instructions", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("time", T.LongType())]))),
    T.StructField("tolls", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("cost", T.DoubleType())]))),
])))])

DEFAULT_BRIDGE_LIMIT_KG = 10000.0
TUNNEL_HEIGHT_LIMIT_M = 4.0
LOW_SPEED_KPH = 50.0
REPLAN_DELAY_S = 600.0
SHIFT_S, BREAK_S = 8 * 3600, 3600


def parse_reply(df: DataFrame, text_col: str) -> DataFrame:
    """GN15: JSON reply text -> one row per path (best first, with position)."""
    r = df.withColumn("_r", F.from_json(F.col(text_col), ROUTE_REPLY_SCHEMA))
    return r.select("*", F.posexplode("_r.paths").alias("path_rank", "path")).drop("_r")


def flatten_sections(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GN15: sections of each path as rows (``inline``), in order."""
    return paths.select(*keys, "path_rank", F.posexplode("path.sections").alias("section_no", "s")).select(
        *keys, "path_rank", "section_no", "s.*")


def low_speed_sections(sections: DataFrame) -> DataFrame:
    """PRJ16: sections with a speed limit below 50."""
    return sections.filter(F.col("speed_limit").isNotNull() & (F.col("speed_limit") < LOW_SPEED_KPH))


def height_restricted(sections: DataFrame, vehicle_height) -> DataFrame:
    """PRJ17: tunnels/bridges whose clearance is below the vehicle height."""
    h = F.col(vehicle_height) if isinstance(vehicle_height, str) else F.lit(vehicle_height)
    return sections.filter(F.col("road_type").isin("tunnel", "bridge") & (F.col("height_clearance") < h))


def route_validity(paths: DataFrame, vehicle_height: str, vehicle_weight: str) -> DataFrame:
    """PRJ18: a tunnel with vehicle height > 4.0, or a bridge with vehicle weight above its limit
    (default 10000), makes the route invalid; no sections = valid.  Judged inside each path's own
    section array, so no row moves."""
    def bad(s):
        return F.coalesce(((s["road_type"] == "tunnel") & (F.col(vehicle_height) > TUNNEL_HEIGHT_LIMIT_M)) | (
            (s["road_type"] == "bridge") & (F.col(vehicle_weight) > F.coalesce(s["weight_limit"], F.lit(DEFAULT_BRIDGE_LIMIT_KG)))),
            F.lit(False))
    return paths.withColumn("valid", ~F.coalesce(F.exists("path.sections", bad), F.lit(False)))


def compare_routes(routes: DataFrame, keys: Sequence[str], rank: str, metrics: Sequence[str]) -> DataFrame:
    """CB13: every alternative of a request (``rank`` > 0) against its first route (``rank`` 0): one
    ``<metric>_diff`` each, first minus alternative.  One sort per request; the first route is carried
    by a window, not by a self join."""
    w = Window.partitionBy(*keys).orderBy(rank)
    diffs = [(F.first(m).over(w) - F.col(m)).alias(f"{m}_diff") for m in metrics]
    return routes.select("*", *diffs).filter(F.col(rank) > 0)


def dispatch_payload(paths: DataFrame, shipment: str, driver: str, vehicle: str, departure: str) -> DataFrame:
    """GN17: one hand-over record per path as a struct ``payload`` (and its JSON text ``payload_json``):
    planned departure, estimated arrival, one checkpoint per section with its cumulative ETA,
    environmental impact and compliance."""
    def after(seconds):
        return F.col(departure) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(seconds).cast("decimal(18,6)"))

    sections = F.coalesce(F.col("path.sections"), F.array().cast(ROUTE_REPLY_SCHEMA["paths"].dataType.elementType["sections"].dataType))
    ends = F.aggregate(sections, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["duration"])))
    x = paths.withColumns({"_ends": F.slice(ends, 2, F.size(sections) + 1), "_impact": cb.route_impact("path.distance", vehicle)})
    passed = cb.route_compliance(F.col("_impact.co2_kg"), F.col("_impact.noise_impact"), F.col("path.distance"))
    stop = F.zip_with(sections, "_ends", lambda s, e: F.struct(s["start"].alias("section"), after(e).alias("eta")))
    payload = F.struct(
        F.col(shipment).cast("string").alias("shipment_id"),
        F.concat_ws("-", F.lit("route"), F.col(shipment), F.col("path_rank")).alias("route_id"),
        F.col(driver).alias("driver"), F.col(vehicle).alias("vehicle"), F.col(departure).alias("planned_departure"),
        after(F.col("path.time") / 1000.0).alias("estimated_arrival"), stop.alias("checkpoints"),
        F.col("_impact").alias("environmental_impact"),
        F.struct(passed["passed"].alias("passed"), passed["issues"].alias("issues")).alias("compliance_status"))
    return x.withColumn("payload", payload).withColumn("payload_json", F.to_json("payload")).drop("_ends", "_impact")


def toll_total(tolls) -> Column:
    """AG10: toll sum with missing cost as 0."""
    t = F.col(tolls) if isinstance(tolls, str) else tolls
    return F.aggregate(F.coalesce(t, F.array().cast("array<struct<name:string,cost:double>>")), F.lit(0.0),
                       lambda a, x: a + F.coalesce(x["cost"], F.lit(0.0)))


def total_cost(*parts: str) -> Column:
    """AG11: decimal sum of cost components (2 places)."""
    return sum((F.col(p).cast("decimal(18,2)") for p in parts), F.lit(0).cast("decimal(18,2)"))


def driver_schedule(df: DataFrame, total_ms: str, start_ts: str) -> DataFrame:
    """GN16: shifts of at most 8 h separated by a 1 h break; durations in whole minutes."""
    secs = F.col(total_ms) / 1000.0
    n = F.greatest(F.ceil(secs / SHIFT_S), F.lit(1)).cast("int")
    x = df.withColumn("_n", n).withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dur = F.least(F.lit(float(SHIFT_S)), secs - F.col("shift") * SHIFT_S)
    start = F.col(start_ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("shift") * (SHIFT_S + BREAK_S)).cast("decimal(18,6)"))
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), dur.cast("decimal(18,6)"))
    return x.withColumns({"shift_start": start, "shift_end": end, "duration_min": F.floor(dur / 60).cast("bigint")}).drop("_n")


def eta_slip(legs: DataFrame, keys: Sequence[str], planned: str, actual: str, tolerance_s: float = 7200) -> DataFrame:
    """GN18 (our definition): actual - planned per leg; max/avg per shipment and a deviation flag."""
    d = legs.withColumn("slip_s", F.unix_timestamp(F.col(actual).cast("timestamp")) - F.unix_timestamp(F.col(planned).cast("timestamp")))
    return d.groupBy(*keys).agg(F.max("slip_s").alias("max_slip_s"), F.avg("slip_s").alias("avg_slip_s"),
                                (F.max("slip_s") > tolerance_s).alias("deviated"))


def _tour_order(xy: np.ndarray, closed: bool = False) -> list[int]:
    """Nearest neighbour from stop 0, then 2-opt on the open path; if ``closed``, the last stop stays the last."""
    n = len(xy)
    free = n - 1 if closed else n  # stops before it may change places, the first apart
    if free <= 2:
        return list(range(n))
    lat, lon = np.radians(xy[:, 0]), np.radians(xy[:, 1])
    dlat = lat[:, None] - lat[None, :]
    dlon = lon[:, None] - lon[None, :]
    a = np.sin(dlat / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat)[None, :] * np.sin(dlon / 2) ** 2
    dm = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
    order, seen = [0], {0}
    while len(order) < free:
        last = order[-1]
        nxt = min((j for j in range(free) if j not in seen), key=lambda j: (dm[last, j], j))
        order.append(nxt)
        seen.add(nxt)
    order.extend(range(free, n))
    improved = True
    while improved:
        improved = False
        for i in range(1, free):
            for k in range(i + 1, free):
                a_, b_ = order[i - 1], order[i]
                c_ = order[k]
                d_ = order[k + 1] if k + 1 < n else None
                before = dm[a_, b_] + (dm[c_, d_] if d_ is not None else 0.0)
                after = dm[a_, c_] + (dm[b_, d_] if d_ is not None else 0.0)
                if after + 1e-9 < before:
                    order[i:k + 1] = order[i:k + 1][::-1]
                    improved = True
    return order


def _haversine(p, q) -> float:
    la1, lo1, la2, lo2 = map(math.radians, (p[0], p[1], q[0], q[1]))
    a = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


def _plan_tour(stops: list, max_duration_s: float, capacity: float, speed_kph: float, closed: bool = False) -> list:
    """stops: [(stop, lat, lon, load)], the depot first and, if ``closed``, the destination last
    -> [(visit, index of the stop, leg_km, trip)]."""
    order = _tour_order(np.array([[s[1], s[2]] for s in stops], dtype=float), closed) if len(stops) > 2 else list(range(len(stops)))
    out, trip, dur, ld, prev = [], 0, 0.0, 0.0, None
    for v, idx in enumerate(order):
        st = stops[idx]
        km = _haversine(prev, (st[1], st[2])) if prev is not None else 0.0
        t = km / speed_kph * 3600
        if prev is not None and (dur + t > max_duration_s or ld + st[3] > capacity):
            trip, dur, ld = trip + 1, 0.0, 0.0
        dur += t
        ld += st[3]
        out.append((v, idx, km, trip))
        prev = (st[1], st[2])
    return out


#: Rows of stops a planning task gets, about; the number of tasks follows the input.
TOUR_ROWS = 400_000


def multi_stop_tours(stops: DataFrame, tour: str, stop: str, lat: str, lon: str, load: str,
                     max_duration_s: float = 8 * 3600, capacity: float = 8000.0, speed_kph: float = 80.0,
                     n_rows: int | None = None, first: str | None = None, ends: DataFrame | None = None) -> DataFrame:
    """GN14: visiting order per tour (nearest neighbour + 2-opt from the depot), then trips split greedily
    when the running duration or load would exceed the limits.  Rows of one stop in a tour are one visit with
    the sum of their loads.  The depot is the stop with the least ``first`` (a column; nulls last), without it
    the least stop.  ``ends`` (tour, stop, lat, lon) names the destination of a tour: visited last, with no
    load; a tour without one ends at its last stop, an end without stops is no tour.  With ``ends`` each row
    says if it is the end (``is_end``), since the ids of both may be alike.

    The rows are shuffled by tour once, into partitions of about ``TOUR_ROWS`` whatever the input
    (``n_rows``: number of rows, ends among them, if known, else counted), so a task's memory does not grow with it.
    Each tour's stop list (bounded: one tour's stops) is gathered into one
    array row; ``mapInPandas`` then plans a whole Arrow batch of tours per
    call, so the Python cost is per tour, not per pandas group."""
    kf, sf = stops.schema[tour], stops.schema[stop]
    rows = stops.select(tour, stop, F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo"),
                        F.col(load).cast("double").alias("ld"), F.col(first or stop).alias("first"), F.lit(False).alias("is_end"))
    if ends is not None:
        rows = rows.unionByName(ends.select(
            F.col(tour).cast(kf.dataType).alias(tour), F.col(stop).cast(sf.dataType).alias(stop), F.col(lat).cast("double").alias("la"),
            F.col(lon).cast("double").alias("lo"), F.lit(0.0).alias("ld"), F.lit(None).cast(rows.schema["first"].dataType).alias("first"),
            F.lit(True).alias("is_end")))
    n = rows.count() if n_rows is None else n_rows
    rows = rows.repartition(max(1, -(-n // TOUR_ROWS)), tour).groupBy(tour, stop, "is_end").agg(
        F.first("la").alias("la"), F.first("lo").alias("lo"), F.sum("ld").alias("ld"), F.min("first").alias("first"))
    per = rows.groupBy(tour).agg(F.array_sort(F.collect_list(F.struct(
        "is_end", F.isnull("first").alias("late"), "first", F.col(stop).alias("s"), "la", "lo", "ld"))).alias("stops"))
    per = per.filter("NOT stops[0].is_end")
    plan_t = T.ArrayType(T.StructType([T.StructField("visit", T.IntegerType()), T.StructField(stop, sf.dataType),
                                       T.StructField("leg_km", T.DoubleType()), T.StructField("trip", T.IntegerType()),
                                       *([] if ends is None else [T.StructField("is_end", T.BooleanType())])]))
    schema = T.StructType([kf, T.StructField("plan", plan_t)])

    def run(it):
        for pdf in it:
            plans = []
            for arr in pdf["stops"]:
                st = [(r["s"], r["la"], r["lo"], r["ld"]) for r in arr]
                plans.append([{"visit": v, stop: st[i][0], "leg_km": km, "trip": tr, "is_end": arr[i]["is_end"]}
                              for v, i, km, tr in _plan_tour(st, max_duration_s, capacity, speed_kph, arr[-1]["is_end"])])
            yield pd.DataFrame({tour: pdf[tour], "plan": plans})
    out = per.mapInPandas(run, schema)
    return out.select(tour, F.inline("plan"))
