"""Ledger queries (LG rows, PRJ14, PRJ19, AG16, AG17, SS10) on the ``ledger`` view."""
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.text import from_unix_seconds
from ..operators.joins import split_by_grants
from ..plans import ledger as lg
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register

_PAIRS = ", ".join(f"'{a}>{b}'" for a, bs in lg.TRANSITIONS.items() for b in bs)
R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"


def _ledger(spark, sf):
    return view(spark, sf, "ledger")


@register("lg1_first_create_wins", view_sql("ledger") + """,
c AS (SELECT * FROM ledger WHERE status = 'CREATED'),
f AS (SELECT shipment_id, arg_min(seq, (ts, seq)) AS first_seq FROM c GROUP BY 1)
SELECT c.shipment_id, c.seq, c.ts, c.seq = f.first_seq AS accepted FROM c JOIN f ON c.shipment_id = f.shipment_id""")
def q_lg1(spark, sf):
    return lg.first_create(_ledger(spark, sf)).select("shipment_id", "seq", "ts", "accepted")


_LATEST_SQL = view_sql("ledger") + """,
latest AS (SELECT shipment_id, arg_max(struct_pack(status := status, value := value, ts := ts, seq := seq), (ts, seq)) AS s,
                  CAST(count(*) AS BIGINT) AS n_events FROM ledger GROUP BY 1)
"""


@register("lg2_latest_state", _LATEST_SQL + """
SELECT shipment_id, s.status AS status, round(s.value, 4) AS value, s.ts AS last_update, s.seq AS last_seq, n_events FROM latest""")
def q_lg2(spark, sf):
    s = lg.latest_state(_ledger(spark, sf), fields=["status", "value"])
    return s.select("shipment_id", "status", F.round("value", 4).alias("value"), "last_update", "last_seq", "n_events")


@register("prj14_shipments_by_status", _LATEST_SQL + "SELECT shipment_id, s.ts AS last_update FROM latest WHERE s.status = 'DELIVERED'")
def q_prj14(spark, sf):
    s = lg.latest_state(_ledger(spark, sf))
    return s.filter(F.col("status") == "DELIVERED").select("shipment_id", "last_update")


@register("lg3_pairwise_transition_check", view_sql("ledger") + f""",
p AS (SELECT shipment_id, seq, status, lag(status) OVER (PARTITION BY shipment_id ORDER BY ts, seq) AS prev_status FROM ledger)
SELECT shipment_id, seq, status, prev_status,
  CASE WHEN prev_status IS NULL THEN status = 'CREATED' ELSE (prev_status || '>' || status) IN ({_PAIRS}) END AS valid FROM p""")
def q_lg3p(spark, sf):
    return lg.pairwise_transitions(_ledger(spark, sf)).select("shipment_id", "seq", "status", "prev_status", "valid")


_OK = f"((r.state IS NULL AND e.status = 'CREATED') OR (r.state || '>' || e.status) IN ({_PAIRS}))"


LG3_FOLD_SQL = view_sql("ledger").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
e AS (SELECT shipment_id, seq, ts, status, row_number() OVER (PARTITION BY shipment_id ORDER BY ts, seq) AS rn FROM ledger),
r AS (SELECT shipment_id, rn, seq, status, status = 'CREATED' AS accepted,
             CASE WHEN status = 'CREATED' THEN status END AS state FROM e WHERE rn = 1
      UNION ALL
      SELECT e.shipment_id, e.rn, e.seq, e.status, coalesce({_OK}, false),
             CASE WHEN coalesce({_OK}, false) THEN e.status ELSE r.state END
      FROM r JOIN e ON e.shipment_id = r.shipment_id AND e.rn = r.rn + 1)
SELECT shipment_id, seq, status, accepted, state AS state_after FROM r"""


@register("lg3_exact_acceptance_fold", LG3_FOLD_SQL)
def q_lg3f(spark, sf):
    f = lg.exact_fold(_ledger(spark, sf))
    return f.select("shipment_id", "seq", "status", "accepted", "state_after")


@register("lg4_milestone_timestamps", view_sql("ledger") + """
SELECT shipment_id, max(ts) FILTER (WHERE status = 'DISPATCHED') AS dispatched_at,
  max(ts) FILTER (WHERE status = 'DELIVERED') AS delivered_at,
  max(ts) FILTER (WHERE status = 'CUSTOMS_CLEARED') AS customs_cleared_at FROM ledger GROUP BY 1""")
def q_lg4(spark, sf):
    return lg.milestones(_ledger(spark, sf))


@register("lg5_ordered_history", view_sql("ledger") + """
SELECT shipment_id, seq, status, CAST(row_number() OVER (PARTITION BY shipment_id ORDER BY ts, seq) AS INTEGER) AS position FROM ledger""")
def q_lg5(spark, sf):
    return lg.history(_ledger(spark, sf)).select("shipment_id", "seq", "status", "position")


@register("lg8_archive_delivered", _LATEST_SQL + "SELECT shipment_id, s.ts AS archived_at FROM latest WHERE s.status = 'DELIVERED'")
def q_lg8a(spark, sf):
    s = lg.latest_state(_ledger(spark, sf))
    return s.filter(F.col("status") == "DELIVERED").select("shipment_id", F.col("last_update").alias("archived_at"))


@register("lg8_listing_after_archive", _LATEST_SQL + """
SELECT l.shipment_id, l.seq FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM latest a WHERE a.shipment_id = l.shipment_id AND a.s.status = 'DELIVERED')""")
def q_lg8b(spark, sf):
    led = _ledger(spark, sf)
    arch = lg.latest_state(led).filter(F.col("status") == "DELIVERED").select("shipment_id")
    return led.join(arch, "shipment_id", "left_anti").select("shipment_id", "seq")


#: Binding of deletions: error events whose k is a multiple of five; all other events write.
_DELETES = "event_type = 'error' AND k % 5 = 0"
_TOMB_SQL = view_sql("ledger") + f""",
dead AS (SELECT shipment_id, max((ts, seq)) AS t FROM ledger WHERE {_DELETES} GROUP BY 1),
live AS (SELECT l.*, d.t IS NOT NULL AS recreated FROM ledger l LEFT JOIN dead d ON d.shipment_id = l.shipment_id
         WHERE NOT coalesce({_DELETES}, false) AND (d.t IS NULL OR (l.ts, l.seq) > d.t))"""


def _deletes_and_writes(spark, sf):
    led = _ledger(spark, sf)
    is_delete = F.coalesce(F.expr(_DELETES), F.lit(False))
    return led.filter(is_delete), led.filter(~is_delete)


@register("lg8_live_after_deletes", _TOMB_SQL + """
SELECT shipment_id, CAST(count(*) AS BIGINT) AS n_events, arg_max(status, (ts, seq)) AS status, any_value(recreated) AS recreated FROM live GROUP BY 1""")
def q_lg8t(spark, sf):
    """Shipments that live after deletions: events since the last one, latest status, and whether they were
    deleted before and created anew."""
    deletes, writes = _deletes_and_writes(spark, sf)
    live = lg.live_events(writes, lg.last_tombstones(deletes))
    return live.groupBy("shipment_id").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("status", F.struct("ts", "seq")).alias("status"),
                                           F.bool_or("recreated").alias("recreated"))


@register("lg8_compacted_log", _TOMB_SQL + """
SELECT shipment_id, seq, status, FALSE AS tombstone FROM live
UNION ALL SELECT shipment_id, t[2], NULL, TRUE FROM dead""")
def q_lg8c(spark, sf):
    """The compacted log: live events and the last tombstone of every deleted shipment."""
    deletes, writes = _deletes_and_writes(spark, sf)
    return lg.compacted(writes, deletes).select("shipment_id", "seq", "status", "tombstone")


_DOC_BY_EVENT = {"purchase": "commercial_invoice", "signup": "certificate_of_origin", "view": "packing_list"}


@register("lg9_customs_documents_missing", view_sql("ledger") + """,
d AS (SELECT shipment_id, CASE event_type WHEN 'purchase' THEN 'commercial_invoice' WHEN 'signup' THEN 'certificate_of_origin'
             WHEN 'view' THEN 'packing_list' END AS doc_type FROM ledger)
SELECT shipment_id, array_to_string(list_sort(list_filter(['commercial_invoice', 'certificate_of_origin'],
         lambda x: NOT list_contains(coalesce(list(doc_type) FILTER (WHERE doc_type IS NOT NULL), []), x))), ',') AS missing,
  len(list_filter(['commercial_invoice', 'certificate_of_origin'],
         lambda x: NOT list_contains(coalesce(list(doc_type) FILTER (WHERE doc_type IS NOT NULL), []), x))) = 0 AS compliant
FROM d GROUP BY 1""")
def q_lg9(spark, sf):
    led = _ledger(spark, sf)
    docs = led.select("shipment_id", F.create_map(*[F.lit(x) for kv in _DOC_BY_EVENT.items() for x in kv])[F.col("event_type")].alias("doc_type"))
    m = lg.missing_documents(docs, "shipment_id", "doc_type")
    return m.select("shipment_id", F.array_join("missing", ",").alias("missing"), "compliant")


_TEMP_SQL = """
readings AS (SELECT user_id AS shipment_id, event_id, value - 60 AS temp FROM events WHERE event_type = 'view'),
ranges AS (SELECT shipment_id, -20.0 + shipment_id % 5 AS lo, 25.0 + shipment_id % 7 AS hi FROM (SELECT DISTINCT user_id AS shipment_id FROM events)),
viol AS (SELECT r.shipment_id, CAST(count(*) FILTER (WHERE r.temp < g.lo OR r.temp > g.hi) AS BIGINT) AS n_violations,
                CAST(count(*) AS BIGINT) AS n_readings FROM readings r JOIN ranges g ON r.shipment_id = g.shipment_id GROUP BY 1)
"""


def temperature_violations(spark, sf):
    ev = table(spark, sf, "events")
    readings = ev.filter(F.col("event_type") == "view").select(F.col("user_id").alias("shipment_id"), (F.col("value") - 60).alias("temp"))
    lo = -20.0 + F.col("shipment_id") % 5
    hi = 25.0 + F.col("shipment_id") % 7
    r = readings.withColumns({"lo": lo, "hi": hi})
    return r.groupBy("shipment_id").agg(F.count_if((F.col("temp") < F.col("lo")) | (F.col("temp") > F.col("hi"))).alias("n_violations"),
                                        F.count(F.lit(1)).alias("n_readings"))


@register("lg10_temperature_compliance", "WITH " + _TEMP_SQL + """
SELECT shipment_id, n_violations, n_readings, n_violations = 0 AS compliant FROM viol""")
def q_lg10(spark, sf):
    v = temperature_violations(spark, sf)
    return v.withColumn("compliant", F.col("n_violations") == 0)


_APPROVALS_SQL = "ap AS (SELECT user_id AS shipment_id, 'AG' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS VARCHAR) AS agency, ts FROM events WHERE event_type = 'click')"


def approvals(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type") == "click")
    return ev.select(F.col("user_id").alias("shipment_id"),
                     F.concat(F.lit("AG"), (F.get_json_object("props", "$.k").cast("bigint") % 4).cast("string")).alias("agency"), "ts")


@register("ag16_lg11_customs_clearance", f"WITH {_APPROVALS_SQL} " + """
SELECT shipment_id, CAST(count(DISTINCT agency) AS BIGINT) AS n_agencies, CAST(count(*) AS BIGINT) AS n_approvals,
  count(DISTINCT agency) >= 2 AS cleared, CAST(count(*) - count(DISTINCT agency) AS BIGINT) AS repeated_rejected
FROM ap GROUP BY 1""")
def q_ag16(spark, sf):
    return lg.customs_cleared(approvals(spark, sf), "shipment_id", "agency", "ts")


@register("lg12_insurance_claims", view_sql("ledger") + """
SELECT seq, shipment_id, round(value, 4) AS amount, CAST(k * 5.0 AS DOUBLE) AS coverage,
  CASE WHEN value <= k * 5.0 THEN 'PENDING' ELSE 'REJECTED' END AS claim_status FROM ledger WHERE event_type = 'error'""")
def q_lg12(spark, sf):
    c = _ledger(spark, sf).filter(F.col("event_type") == "error").select(
        "seq", "shipment_id", F.col("value").alias("amount"), (F.col("k") * 5.0).alias("coverage"))
    return lg.claim_decision(c, "amount", "coverage").withColumn("amount", F.round("amount", 4))


@register("lg13_batch_on_first_matching_sku", """
WITH it AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem),
tgt AS (SELECT l_orderkey, min(l_partkey) AS sku FROM lineitem GROUP BY 1),
firstm AS (SELECT it.l_orderkey, min(pos) AS p FROM it JOIN tgt ON it.l_orderkey = tgt.l_orderkey AND it.l_partkey = tgt.sku GROUP BY 1)
SELECT it.l_orderkey AS order_key, CAST(it.pos AS BIGINT) AS pos, it.l_partkey AS sku,
  CASE WHEN it.pos = f.p THEN 'BATCH-' || CAST(it.l_orderkey AS VARCHAR) END AS batch_number
FROM it JOIN firstm f ON it.l_orderkey = f.l_orderkey""")
def q_lg13(spark, sf):
    """Set the batch number on the first item of the target SKU (here the
    smallest part key of the order); a missing SKU would be an error."""
    li = table(spark, sf, "lineitem")
    items = li.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("items"),
        F.min("l_partkey").alias("sku"))
    first_pos = F.array_position(F.transform("items", lambda i: i["l_partkey"]), F.col("sku"))
    upd = F.transform("items", lambda i, p: F.struct(i["l_partkey"].alias("sku"), (p + 1).alias("pos"),
                                                     F.when(p + 1 == first_pos, F.concat(F.lit("BATCH-"), F.col("order_key").cast("string"))).alias("batch_number")))
    x = items.select("order_key", F.inline(upd))
    return x.select("order_key", F.col("pos").cast("bigint").alias("pos"), "sku", "batch_number")


@register("lg17_invoice_payment_reconciliation", f"""
WITH pay AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS paid_cents
             FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT o.o_orderkey AS invoice, CAST(round(o.o_totalprice * 100) AS BIGINT) AS total_cents, coalesce(p.paid_cents, 0) AS paid_cents,
  CAST(round(o.o_totalprice * 100) AS BIGINT) - coalesce(p.paid_cents, 0) AS open_cents,
  CAST(round(o.o_totalprice * 100) AS BIGINT) - coalesce(p.paid_cents, 0) > 0 AND o.o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1999-01-01' AS overdue
FROM orders o LEFT JOIN pay p ON o.o_orderkey = p.l_orderkey""")
def q_lg17(spark, sf):
    """Invoices (orders) left-joined to summed payments (line amounts paid by
    the ship date) as of a date; integer cents keep the sums exact."""
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1999-01-01").cast("timestamp_ntz"))
    pay = li.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")).alias("paid_cents"))
    o = table(spark, sf, "orders")
    j = o.join(pay, o.o_orderkey == pay.l_orderkey, "left")
    total = F.round(F.col("o_totalprice") * 100).cast("bigint")
    open_ = total - F.coalesce(F.col("paid_cents"), F.lit(0))
    due = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return j.select(F.col("o_orderkey").alias("invoice"), total.alias("total_cents"),
                    F.coalesce(F.col("paid_cents"), F.lit(0)).cast("bigint").alias("paid_cents"), open_.alias("open_cents"),
                    ((open_ > 0) & (due < F.lit("1999-01-01").cast("timestamp_ntz"))).alias("overdue"))


_DEVICES_SQL = "devices AS (SELECT DISTINCT user_id AS device_id FROM events WHERE event_type = 'signup' AND value > 100)"


@register("lg18_device_registry_check", f"WITH {_DEVICES_SQL} " + """
SELECT e.event_id, e.user_id AS device_id, d.device_id IS NOT NULL AS registered FROM events e LEFT JOIN devices d ON e.user_id = d.device_id""")
def q_lg18(spark, sf):
    ev = table(spark, sf, "events")
    dev = ev.filter((F.col("event_type") == "signup") & (F.col("value") > 100)).select(F.col("user_id").alias("device_id")).distinct()
    r = ev.select("event_id", F.col("user_id").alias("device_id"))
    ok, bad = split_by_grants(r, dev, ["device_id"])
    return ok.withColumn("registered", F.lit(True)).unionByName(bad.withColumn("registered", F.lit(False)))


@register("lg19_temperature_series_per_day", """
SELECT user_id AS shipment_id, CAST(ts AS DATE) AS ds, CAST(count(*) AS BIGINT) AS n,
  round(arg_min(value - 60, (ts, event_id)), 4) AS first_temp, round(arg_max(value - 60, (ts, event_id)), 4) AS last_temp
FROM events WHERE event_type = 'view' GROUP BY 1, 2""")
def q_lg19(spark, sf):
    ev = table(spark, sf, "events").filter(F.col("event_type") == "view")
    t = F.col("value") - 60
    return ev.groupBy(F.col("user_id").alias("shipment_id"), F.to_date("ts").alias("ds")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min_by(t, F.struct("ts", "event_id")), 4).alias("first_temp"),
        F.round(F.max_by(t, F.struct("ts", "event_id")), 4).alias("last_temp"))


@register("lg20_route_log_integer_units", view_sql("legs") + """
SELECT order_key, line_no, CAST(round(distance_km * 1000) AS BIGINT) AS distance_m, CAST(round(load_kg * 1000) AS BIGINT) AS load_g FROM legs""")
def q_lg20(spark, sf):
    lgs = view(spark, sf, "legs")
    return lgs.select("order_key", "line_no", F.round(F.col("distance_km") * 1000).cast("bigint").alias("distance_m"),
                      F.round(F.col("load_kg") * 1000).cast("bigint").alias("load_g"))


@register("prj19_fn14_format_ledger_record", view_sql("ledger") + """
SELECT seq, 'SHP-' || CAST(shipment_id AS VARCHAR) AS id, status, CAST(k AS DOUBLE) / 10 - 5 AS lat,
  to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AS updated_at FROM ledger""")
def q_prj19(spark, sf):
    led = _ledger(spark, sf)
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rec = F.struct(F.concat(F.lit("SHP-"), F.col("shipment_id").cast("string")).alias("id"), F.col("status"),
                   F.struct((F.col("k").cast("double") / 10 - 5).alias("lat")).alias("currentLocation"),
                   from_unix_seconds(secs).alias("updated_at"))
    x = led.select("seq", rec.alias("r"))
    return x.select("seq", "r.id", "r.status", F.col("r.currentLocation.lat").alias("lat"), "r.updated_at")


@register("ag17_ledger_counts_per_carrier", _LATEST_SQL + """
SELECT 'CARRIER-' || CAST(shipment_id % 7 AS VARCHAR) AS carrier, CAST(count(*) AS BIGINT) AS n_shipments,
  CAST(sum(n_events) AS BIGINT) AS n_events FROM latest WHERE s.status <> 'DELIVERED' GROUP BY 1""")
def q_ag17(spark, sf):
    s = lg.latest_state(_ledger(spark, sf)).filter(F.col("status") != "DELIVERED")
    return s.groupBy(F.concat(F.lit("CARRIER-"), (F.col("shipment_id") % 7).cast("string")).alias("carrier")).agg(
        F.count(F.lit(1)).alias("n_shipments"), F.sum("n_events").cast("bigint").alias("n_events"))


@register("ag17_ledger_counts_total_and_supplier", _LATEST_SQL + """
SELECT 'SUPPLIER-' || CAST(shipment_id % 13 AS VARCHAR) AS supplier, CAST(count(*) AS BIGINT) AS n_shipments,
  CAST(sum(n_events) AS BIGINT) AS n_events FROM latest GROUP BY GROUPING SETS ((supplier), ())""")
def q_ag17t(spark, sf):
    """Shipments and events per supplier, and of the whole ledger (supplier null)."""
    s = lg.latest_state(_ledger(spark, sf)).withColumn("supplier", F.concat(F.lit("SUPPLIER-"), (F.col("shipment_id") % 13).cast("string")))
    return s.rollup("supplier").agg(F.count(F.lit(1)).alias("n_shipments"), F.sum("n_events").cast("bigint").alias("n_events"))


@register("ss10_notification_rules", _LATEST_SQL + "," + _TEMP_SQL + """
SELECT 'CUSTOMS_HOLD' AS type, shipment_id, 'WARNING' AS severity FROM latest WHERE s.status = 'CUSTOMS_HOLD'
UNION ALL SELECT 'DELAY_ALERT', shipment_id, 'WARNING' FROM latest WHERE s.status <> 'DELIVERED' AND s.ts < TIMESTAMP '2024-01-30'
UNION ALL SELECT 'TEMPERATURE_BREACH', shipment_id, CASE WHEN n_violations > 5 THEN 'CRITICAL' ELSE 'WARNING' END FROM viol WHERE n_violations > 0
UNION ALL SELECT 'DOCUMENT_EXPIRATION', shipment_id, CASE WHEN min(latest_doc) < TIMESTAMP '2024-01-10' THEN 'CRITICAL' ELSE 'WARNING' END
  FROM (SELECT shipment_id, event_type, max(ts) AS latest_doc FROM ledger WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1, 2)
  GROUP BY 2 HAVING min(latest_doc) < TIMESTAMP '2024-01-17'""")
def q_ss10(spark, sf):
    """Notification rows from state tables: one rule per type, unioned.  A document is valid for 20 days
    from its latest issue; its shipment is told a week before 30 January, or that it has expired."""
    s = lg.latest_state(_ledger(spark, sf))
    v = temperature_violations(spark, sf)
    hold = s.filter(F.col("status") == "CUSTOMS_HOLD").select(F.lit("CUSTOMS_HOLD").alias("type"), "shipment_id", F.lit("WARNING").alias("severity"))
    delay = s.filter((F.col("status") != "DELIVERED") & (F.col("last_update") < F.lit("2024-01-30").cast("timestamp_ntz"))) \
             .select(F.lit("DELAY_ALERT").alias("type"), "shipment_id", F.lit("WARNING").alias("severity"))
    temp = v.filter(F.col("n_violations") > 0).select(F.lit("TEMPERATURE_BREACH").alias("type"), "shipment_id",
                                                      F.when(F.col("n_violations") > 5, F.lit("CRITICAL")).otherwise(F.lit("WARNING")).alias("severity"))
    doc = _ledger(spark, sf).filter(F.col("event_type").isin(*_DOC_BY_EVENT)).groupBy("shipment_id", "event_type").agg(F.max("ts").alias("latest"))
    first = doc.groupBy("shipment_id").agg(F.min("latest").alias("first"))
    limit = lambda day: F.col("first") < F.lit(day).cast("timestamp_ntz")
    expiring = first.filter(limit("2024-01-17")).select(F.lit("DOCUMENT_EXPIRATION").alias("type"), "shipment_id",
                                                        F.when(limit("2024-01-10"), F.lit("CRITICAL")).otherwise(F.lit("WARNING")).alias("severity"))
    return hold.unionByName(delay).unionByName(temp).unionByName(expiring)


@register("lg16_hash_chain", view_sql("ledger").replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT shipment_id, seq, ts, sha256('{"seq":' || seq || ',"shipment_id":' || shipment_id || ',"status":"' || status || '","value":' || CAST(value AS VARCHAR) || '}') AS record_hash,
      row_number() OVER (PARTITION BY shipment_id ORDER BY ts, seq) AS rn FROM ledger),
r AS (SELECT shipment_id, rn, seq, ts, record_hash, sha256(record_hash) AS chain_hash FROM e WHERE rn = 1
      UNION ALL
      SELECT e.shipment_id, e.rn, e.seq, e.ts, e.record_hash, sha256(r.chain_hash || e.record_hash)
      FROM r JOIN e ON e.shipment_id = r.shipment_id AND e.rn = r.rn + 1)
SELECT shipment_id, seq, ts, record_hash, chain_hash FROM r""")
def q_lg16(spark, sf):
    return lg.hash_chain(_ledger(spark, sf), "shipment_id", "ts", "seq", ["shipment_id", "seq", "status", "value"])
