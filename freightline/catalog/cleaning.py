"""Cleaning and projection queries (PRJ rows) bound to the driver tables."""
from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register
from .demand import _DAILY_SQL, daily_demand


@register("prj1_sentinel_to_null", """
SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders""")
def q_prj1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return cl.replace_sentinel(o, "4-NOT SPECIFIED", ["o_orderpriority"])


@register("prj2_fill_null_with_median", """
WITH m AS (SELECT quantile_cont(nullif(l_discount, 0.0), 0.5) AS med FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(coalesce(nullif(l_discount, 0.0), m.med), 4) AS discount FROM lineitem, m""")
def q_prj2(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"))
    return cl.fill_with_median(li, "discount").withColumn("discount", F.round("discount", 4))


@register("prj3_cast_types", """
SELECT l_orderkey, CAST(l_shipdate AS DATE) AS ship_date, l_returnflag AS return_flag,
       CAST(l_quantity AS BIGINT) AS quantity FROM lineitem""")
def q_prj3(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.to_date("l_shipdate").alias("ship_date"),
                     F.col("l_returnflag").alias("return_flag"), F.col("l_quantity").cast("bigint").alias("quantity"))


@register("prj4_transit_days", """
SELECT l.l_orderkey AS order_key, CAST(l.l_linenumber AS BIGINT) AS line_no,
       CAST(floor(epoch(l.l_shipdate - o.o_orderdate) / 86400) AS BIGINT) AS transit_days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_prj4(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("bigint").alias("line_no"),
                    cl.whole_days_between("l_shipdate", "o_orderdate").alias("transit_days"))


@register("prj5_weight_range_filter", view_sql("shipments") + """
SELECT order_key, line_no, round(weight, 4) AS weight FROM shipments WHERE weight > 0 AND weight < 1000""")
def q_prj5(spark, sf):
    sh = view(spark, sf, "shipments").select("order_key", "line_no", "weight")
    return cl.strict_range(sh, "weight", 0, 1000).withColumn("weight", F.round("weight", 4))


@register("prj6_remove_outliers", _DAILY_SQL + """,
st AS (SELECT series_id, avg(y) AS mu, stddev_samp(y) AS sd FROM daily GROUP BY 1)
SELECT d.series_id, d.ds, round(d.y, 4) AS y FROM daily d JOIN st ON d.series_id = st.series_id
WHERE abs(d.y - st.mu) <= 3 * st.sd OR st.sd IS NULL""")
def q_prj6(spark, sf):
    d = cl.remove_outliers(daily_demand(spark, sf), ["series_id"], "y", 3.0)
    return d.select("series_id", "ds", F.round("y", 4).alias("y"))


@register("prj7_prj8_rename_and_constants", _DAILY_SQL + """
SELECT series_id AS series, ds, round(y, 4) AS y, 1000.0 AS cap, 0.0 AS floor FROM daily""")
def q_prj78(spark, sf):
    d = daily_demand(spark, sf).select(F.col("series_id").alias("SERIES"), F.col("ds").alias("DS"), F.round("y", 4).alias("Y"))
    d = cl.rename_columns(d, str.lower)
    return cl.add_constants(d, cap=1000.0, floor=0.0)


_DELAY_SQL = view_sql("shipments") + """,
lab AS (SELECT order_key, line_no, CAST(ship_date - order_date AS BIGINT) AS delay_days FROM shipments)
"""


@register("prj10_binary_label", _DELAY_SQL + """
SELECT order_key, line_no, delay_days, CAST(delay_days > 0 AS INTEGER) AS label FROM lab""")
def q_prj10(spark, sf):
    sh = view(spark, sf, "shipments")
    d = sh.select("order_key", "line_no", F.datediff("ship_date", "order_date").cast("bigint").alias("delay_days"))
    return d.withColumn("label", (F.col("delay_days") > 0).cast("int"))


@register("prj11_text_predicate", _DELAY_SQL + "SELECT order_key, line_no, delay_days FROM lab WHERE delay_days > 0")
def q_prj11(spark, sf):
    sh = view(spark, sf, "shipments")
    d = sh.select("order_key", "line_no", F.datediff("ship_date", "order_date").cast("bigint").alias("delay_days"))
    return d.filter("delay_days > 0")


@register("prj12_shipment_search", view_sql("shipments") + """
SELECT order_key, line_no, order_status, origin_nation, order_date FROM shipments
WHERE order_status = 'F' AND origin_nation = 7 AND order_date >= DATE '1996-01-01' AND order_date <= DATE '1998-12-31'""")
def q_prj12(spark, sf):
    sh = view(spark, sf, "shipments").select("order_key", "line_no", "order_status", "origin_nation", "order_date",
                                             "dest_nation")
    out = cl.search_filter(sh, status="F", origin=7, destination=None, created_after="1996-01-01",
                           created_before="1998-12-31", carrier=None,
                           cols={"status": "order_status", "origin": "origin_nation", "destination": "dest_nation",
                                 "created": "order_date", "carrier": "order_status"})
    return out.drop("dest_nation")


@register("prj13_date_range", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_shipdate, l_quantity FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'""")
def q_prj13(spark, sf):
    li = table(spark, sf, "lineitem")
    return (li.filter(F.col("l_shipdate").between(F.lit("1997-01-01").cast("timestamp_ntz"),
                                                   F.lit("1997-03-31").cast("timestamp_ntz")))
              .select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_shipdate", "l_quantity"))


@register("prj15_expiring_items", """
SELECT l_orderkey AS order_key, CAST(count(*) AS BIGINT) AS n_expiring FROM lineitem
WHERE CAST(l_shipdate AS DATE) + INTERVAL 180 DAY < DATE '1998-01-01' + INTERVAL 30 DAY
GROUP BY 1""")
def q_prj15(spark, sf):
    """Orders holding any item whose expiry (ship date + 180 days) falls before as_of + 30 days.

    The items array per order is small (its lines), built by one grouped
    collect; ``exists`` then tests it."""
    li = table(spark, sf, "lineitem")
    items = li.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.collect_list(F.struct(F.date_add(F.to_date("l_shipdate"), 180).alias("expirationDate"))).alias("items"))
    cutoff = F.date_add(F.lit("1998-01-01").cast("date"), 30)
    exp = F.filter("items", lambda i: i["expirationDate"] < cutoff)
    return (items.filter(F.exists("items", lambda i: i["expirationDate"] < cutoff))
                 .select("order_key", F.size(exp).cast("bigint").alias("n_expiring")))


@register("prj22_retention_window", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 30 DAY""")
def q_prj22(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return cl.retention(ev, "ts", "2024-01-25", 30).select("event_id", "ts")
