"""Data-quality queries (DQ rows) bound to the driver tables."""
from pyspark.sql import functions as F

from ..operators import quality as dq
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register


@register("dq1_st2_dataset_contract", """
SELECT 'required_column' AS "check", 'date' AS "column", CAST(1 AS BIGINT) AS failures
UNION ALL SELECT 'required_column', 'value', 1
UNION ALL SELECT 'numeric_type', 'l_returnflag', 1
UNION ALL SELECT 'date_parse', 'l_shipdate',
  CAST(count(*) FILTER (WHERE l_shipdate IS NOT NULL AND try_cast(CAST(l_shipdate AS VARCHAR) AS TIMESTAMP) IS NULL) AS BIGINT) FROM lineitem""")
def q_dq1(spark, sf):
    li = table(spark, sf, "lineitem")
    return dq.contract_report(li, required=["l_orderkey", "l_shipdate", "l_quantity", "date", "value"],
                              date_cols=["l_shipdate"], numeric_cols=["l_quantity", "l_returnflag"])


@register("dq2_duplicate_keys", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_dq2(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return dq.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


def _contacts(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey",
                    F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@"), F.lower("c_mktsegment"),
                             F.lit(".test")).alias("email"),
                    F.concat(F.lit("+"), F.col("c_custkey").cast("string")).alias("phone"),
                    F.col("c_name").alias("company"))


@register("dq3_contact_rules", r"""
WITH c AS (SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.test' AS email,
                  '+' || CAST(c_custkey AS VARCHAR) AS phone, c_name AS company FROM customer)
SELECT c_custkey, regexp_matches(email, '^[\w\.-]+@[\w\.-]+\.\w+$') AS email_ok,
       regexp_matches(phone, '^\+?[1-9]\d{1,14}$') AS phone_ok, length(company) <= 100 AS company_ok FROM c""")
def q_dq3(spark, sf):
    c = _contacts(spark, sf)
    return c.select("c_custkey", dq.valid_email("email").alias("email_ok"), dq.valid_phone("phone").alias("phone_ok"),
                    dq.max_length("company", 100).alias("company_ok"))


@register("dq4_coordinates_valid_rounded", view_sql("ledger") + """
SELECT seq, round(value - 100 + 0.1234567, 6) AS lat, round(k * 3.7 - 180, 6) AS lon,
       (value - 100 + 0.1234567 BETWEEN -90 AND 90) AND (k * 3.7 - 180 BETWEEN -180 AND 180) AS valid
FROM ledger""")
def q_dq4(spark, sf):
    lg = view(spark, sf, "ledger")
    lat = F.col("value") - 100 + 0.1234567
    lon = F.col("k") * 3.7 - 180
    return lg.select("seq", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"),
                     dq.valid_coordinates(lat, lon).alias("valid"))


_ITEMS_SQL = """
WITH it AS (SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, 'SKU-' || CAST(l.l_partkey AS VARCHAR) AS sku,
       l.l_quantity AS quantity, CAST(p.p_size AS DOUBLE) AS weight, l.l_extendedprice AS value,
       CAST(p.p_size % 10 - 5 AS DOUBLE) AS tmin, CAST(p.p_size % 7 AS DOUBLE) AS tmax
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
chk AS (SELECT *, length(sku) BETWEEN 4 AND 20 AND quantity > 0 AND weight > 0 AND value >= 0 AS basic_ok,
               tmin < tmax AS temp_ok FROM it)
"""


def _items(spark, sf):
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                    F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku"),
                    F.col("l_quantity").alias("quantity"), F.col("p_size").cast("double").alias("weight"),
                    F.col("l_extendedprice").alias("value"), (F.col("p_size") % 10 - 5).cast("double").alias("tmin"),
                    (F.col("p_size") % 7).cast("double").alias("tmax"))


@register("dq5_item_rules", _ITEMS_SQL + "SELECT l_orderkey, l_linenumber, basic_ok AND temp_ok AS item_ok FROM chk")
def q_dq5(spark, sf):
    it = _items(spark, sf)
    return it.select("l_orderkey", "l_linenumber",
                     dq.valid_item("sku", "quantity", "weight", "value", "tmin", "tmax").alias("item_ok"))


@register("dq14_bulk_result_summary", _ITEMS_SQL + """
SELECT CAST(count(*) FILTER (WHERE basic_ok AND temp_ok) AS BIGINT) AS success_count,
       CAST(count(*) FILTER (WHERE NOT (basic_ok AND temp_ok)) AS BIGINT) AS error_count,
       CAST(count(*) FILTER (WHERE NOT temp_ok) AS BIGINT) AS temperature_range_errors FROM chk""")
def q_dq14(spark, sf):
    it = _items(spark, sf)
    rep = dq.rule_report(it, {
        "item_basic": dq.valid_item("sku", "quantity", "weight", "value"),
        "temperature_range": F.col("tmin") < F.col("tmax"),
    })
    return dq.bulk_summary(rep, per_rule=["temperature_range"])


_SENSOR_TYPE_SQL = ("CASE event_type WHEN 'view' THEN 'TEMPERATURE' WHEN 'click' THEN 'HUMIDITY' WHEN 'purchase' "
                    "THEN 'SHOCK' WHEN 'signup' THEN 'LIGHT_EXPOSURE' ELSE 'LOCATION' END")
_UNIT_SQL = "['°C', '%', 'g', 'lux', 'degrees', 'm'][k % 6 + 1]"
SENSOR_TYPE_BY_EVENT = {"view": "TEMPERATURE", "click": "HUMIDITY", "purchase": "SHOCK", "signup": "LIGHT_EXPOSURE"}
UNITS = ["°C", "%", "g", "lux", "degrees", "m"]


def sensor_readings(spark, sf):
    """Sensor readings with type and unit derived from the event rows."""
    lg = view(spark, sf, "ledger")
    st = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SENSOR_TYPE_BY_EVENT.items() for x in kv]),
                                 F.col("event_type")), F.lit("LOCATION"))
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("k") % 6 + 1).cast("int"))
    return lg.select("seq", "shipment_id", "ts", "value", st.alias("sensor_type"), unit.alias("unit"))


@register("dq6_sensor_unit_rules", view_sql("ledger") + f"""
SELECT seq, {_SENSOR_TYPE_SQL} AS sensor_type, {_UNIT_SQL} AS unit,
  coalesce(CASE {_SENSOR_TYPE_SQL} WHEN 'TEMPERATURE' THEN '°C' WHEN 'HUMIDITY' THEN '%' WHEN 'SHOCK' THEN 'g'
    WHEN 'LIGHT_EXPOSURE' THEN 'lux' WHEN 'TILT' THEN 'degrees' END = {_UNIT_SQL}, false) AS unit_ok,
  coalesce(CASE {_SENSOR_TYPE_SQL} WHEN 'TEMPERATURE' THEN '°C' WHEN 'HUMIDITY' THEN '%' WHEN 'SHOCK' THEN 'g'
    WHEN 'LIGHT_EXPOSURE' THEN 'lux' WHEN 'TILT' THEN 'degrees' END = {_UNIT_SQL}, false)
    OR {_SENSOR_TYPE_SQL} = 'LOCATION' AS unit_ok_location_free
FROM ledger""")
def q_dq6(spark, sf):
    r = sensor_readings(spark, sf)
    return r.select("seq", "sensor_type", "unit", dq.unit_matches("sensor_type", "unit").alias("unit_ok"),
                    dq.unit_matches("sensor_type", "unit", location_needs_unit=False).alias("unit_ok_location_free"))


@register("dq7_arrival_after_departure", view_sql("shipments") + """
SELECT order_key, line_no, ship_date > order_date AS arrival_ok FROM shipments""")
def q_dq7(spark, sf):
    sh = view(spark, sf, "shipments")
    return sh.select("order_key", "line_no", dq.arrival_after_departure("ship_date", "order_date").alias("arrival_ok"))


@register("dq8_hazard_class_required", """
SELECT l.l_orderkey AS order_key,
  NOT bool_or(p.p_type = 'LARGE' AND p.p_size % 3 <> 0) AS hazard_ok
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def q_dq8(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    items = j.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_list(F.struct(
        (F.col("p_type") == "LARGE").alias("hazardous"),
        F.when(F.col("p_size") % 3 == 0, F.lit("CLASS_3")).alias("hazard_class"))).alias("items"))
    return items.select("order_key", dq.hazardous_declared("items").alias("hazard_ok"))


_INCOTERM_CHOICES = dq.INCOTERMS + ["XXX", "FOB "]


@register("dq9_incoterm_list", """
SELECT o_orderkey, ['EXW','FCA','FAS','FOB','CFR','CIF','CPT','CIP','DAT','DAP','DDP','XXX','FOB '][o_orderkey % 13 + 1] AS incoterm,
  ['EXW','FCA','FAS','FOB','CFR','CIF','CPT','CIP','DAT','DAP','DDP','XXX','FOB '][o_orderkey % 13 + 1]
    IN ('EXW','FCA','FAS','FOB','CFR','CIF','CPT','CIP','DAT','DAP','DDP') AS incoterm_ok FROM orders""")
def q_dq9(spark, sf):
    o = table(spark, sf, "orders")
    inc = F.element_at(F.array(*[F.lit(x) for x in _INCOTERM_CHOICES]), (F.col("o_orderkey") % 13 + 1).cast("int"))
    return o.select("o_orderkey", inc.alias("incoterm"), dq.valid_incoterm(inc).alias("incoterm_ok"))


@register("dq10_document_rules", """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN upper(sha256(CAST(o_orderkey AS VARCHAR)))
                   ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS hash_sha256,
           CAST(o_custkey * 997 AS VARCHAR) AS hs_code, 'DOC-' || CAST(o_orderkey AS VARCHAR) AS document_id FROM orders)
SELECT o_orderkey, regexp_matches(hash_sha256, '^[a-f0-9]{64}$') AS hash_ok,
       regexp_matches(hs_code, '^\\d{6,10}$') AS hs_code_ok, length(document_id) >= 10 AS document_id_ok FROM d""")
def q_dq10(spark, sf):
    o = table(spark, sf, "orders")
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    d = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.upper(h)).otherwise(h).alias("hash_sha256"),
                 (F.col("o_custkey") * 997).cast("string").alias("hs_code"),
                 F.concat(F.lit("DOC-"), F.col("o_orderkey").cast("string")).alias("document_id"))
    return d.select("o_orderkey", dq.valid_sha256("hash_sha256").alias("hash_ok"),
                    dq.valid_hs_code("hs_code").alias("hs_code_ok"),
                    dq.valid_document_id("document_id").alias("document_id_ok"))


@register("dq11_shipment_id_format", """
SELECT o_orderkey, printf('EIN-%04d-%04d-%04d', o_custkey, o_orderkey, o_orderkey % 7919) AS shipment_id,
       regexp_matches(printf('EIN-%04d-%04d-%04d', o_custkey, o_orderkey, o_orderkey % 7919), '^EIN-\\d{4}-\\d{4}-\\d{4}$') AS id_ok
FROM orders""")
def q_dq11(spark, sf):
    o = table(spark, sf, "orders")
    sid = F.format_string("EIN-%04d-%04d-%04d", "o_custkey", "o_orderkey", F.col("o_orderkey") % 7919)
    return o.select("o_orderkey", sid.alias("shipment_id"), dq.valid_shipment_id(sid).alias("id_ok"))


@register("dq12_temperature_readings_range", """
SELECT user_id AS device_id, bool_and(value - 60 BETWEEN -50 AND 100) AS readings_ok, CAST(count(*) AS BIGINT) AS n
FROM events WHERE event_type = 'view' GROUP BY 1""")
def q_dq12(spark, sf):
    """Per device: every temperature reading within [-50, 100] C.  The check is a
    per-row predicate folded by ``bool_and`` (distributed), not an array per device."""
    ev = table(spark, sf, "events").filter(F.col("event_type") == "view")
    lo, hi = dq.TEMPERATURE_RANGE_C
    return ev.groupBy(F.col("user_id").alias("device_id")).agg(
        F.bool_and((F.col("value") - 60).between(lo, hi)).alias("readings_ok"), F.count(F.lit(1)).alias("n"))


@register("dq13_ledger_shipment_validity", """
WITH it AS (SELECT l_orderkey, bool_and(l_quantity - 3 > 0) AS q_ok FROM lineitem GROUP BY 1)
SELECT o.o_orderkey AS order_key,
  coalesce(it.q_ok, false) AND c.c_acctbal >= 0 AS shipment_ok
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN it ON it.l_orderkey = o.o_orderkey""")
def q_dq13(spark, sf):
    li = table(spark, sf, "lineitem")
    items = li.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") - 3).alias("quantity"))).alias("items"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("coverage"))
    j = (o.join(c, o.o_custkey == c.c_custkey).join(items, o.o_orderkey == items.l_orderkey, "left")
          .withColumn("items", F.coalesce("items", F.array().cast("array<struct<quantity:double>>"))))
    return j.select(F.col("o_orderkey").alias("order_key"),
                    dq.ledger_shipment_valid(F.col("o_orderkey").cast("string"), "items", "coverage").alias("shipment_ok"))


_PROFILE_BY_SEGMENT = {"AUTOMOBILE": "car", "BUILDING": "construction", "FURNITURE": "van", "MACHINERY": "truck",
                       "HOUSEHOLD": "household"}


@register("dq15_routing_request_rules", view_sql("shipments") + """
SELECT order_key,
  CASE min(segment) WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'construction' WHEN 'FURNITURE' THEN 'van'
    WHEN 'MACHINERY' THEN 'truck' ELSE 'household' END IN ('truck','van','refrigerated_truck','construction','tanker','car')
  AND count(DISTINCT origin_nation) + 1 >= 2 AS request_ok
FROM shipments GROUP BY 1""")
def q_dq15(spark, sf):
    sh = view(spark, sf, "shipments")
    g = sh.groupBy("order_key").agg(F.min("segment").alias("segment"),
                                    F.collect_set("origin_nation").alias("stops"), F.first("dest_nation").alias("dest"))
    prof = F.element_at(F.create_map(*[F.lit(x) for kv in _PROFILE_BY_SEGMENT.items() for x in kv]), F.col("segment"))
    waypoints = F.concat("stops", F.array(F.lit(-1).cast("bigint")))  # origin stops + destination drop
    return g.select("order_key", dq.valid_routing_request(prof, waypoints).alias("request_ok"))


@register("dq17_latest_certificate_check", """
WITH c AS (SELECT user_id AS subject, event_type AS check_type, value > 10 AS passed, ts AS checked_at,
                  ts + INTERVAL 7 DAY AS valid_until, event_id FROM events),
l AS (SELECT subject, check_type, arg_max(struct_pack(passed := passed, valid_until := valid_until, checked_at := checked_at), checked_at) AS r
      FROM c GROUP BY 1, 2)
SELECT subject, check_type, r.checked_at AS checked_at, r.passed AS passed, r.valid_until AS valid_until,
       r.passed AND r.valid_until >= TIMESTAMP '2024-01-20' AS certified FROM l""")
def q_dq17(spark, sf):
    ev = table(spark, sf, "events")
    c = ev.select(F.col("user_id").alias("subject"), F.col("event_type").alias("check_type"),
                  (F.col("value") > 10).alias("passed"), F.col("ts").alias("checked_at"),
                  (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("valid_until"))
    return dq.latest_valid_checks(c, "subject", "check_type", "checked_at", "passed", "valid_until", "2024-01-20")


@register("dq18_sanction_screening", """
WITH parties AS (
  SELECT o.o_orderkey AS order_key, c.c_name AS party FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION ALL
  SELECT l.l_orderkey, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
sl AS (SELECT DISTINCT regexp_replace(upper(trim(name)), '[^A-Z0-9]', '', 'g') AS k FROM (
  SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 0)),
p AS (SELECT order_key, party, regexp_replace(upper(trim(party)), '[^A-Z0-9]', '', 'g') AS k FROM parties)
SELECT order_key, coalesce(bool_or(sl.k IS NOT NULL), false) AS match_found,
  coalesce(array_to_string(list_sort(list_distinct(list(party) FILTER (WHERE sl.k IS NOT NULL))), ','), '') AS matches
FROM p LEFT JOIN sl ON p.k = sl.k GROUP BY 1""")
def q_dq18(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf, "supplier")
    parties = (o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("order_key"), F.col("c_name").alias("party"))
                .unionByName(li.join(s, li.l_suppkey == s.s_suppkey)
                               .select(F.col("l_orderkey").alias("order_key"), F.col("s_name").alias("party"))))
    sanctions = (c.filter(F.col("c_acctbal") < 0).select(F.col("c_name").alias("name"))
                  .unionByName(s.filter(F.col("s_acctbal") < 0).select(F.col("s_name").alias("name"))))
    r = dq.screen_parties(parties, "order_key", "party", sanctions, "name")
    return r.select("order_key", "match_found", F.array_join("matches", ",").alias("matches"))
