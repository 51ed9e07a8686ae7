"""Demand slice: gap-filled daily series and ordered features (AG1, WN1-WN5, PRJ9)."""
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import windows as wn
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register

ORDER = ["ds"]
KEYS = ["series_id"]


def daily_demand(spark, sf):
    """Brand/day sums with empty days as 0, straight from lineitem x part."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    j = li.join(part, li.l_partkey == part.p_partkey)
    return ag.daily_resample_sum(j, KEYS, "l_shipdate", "l_quantity")


_DAILY_SQL = view_sql("demand") + """,
b AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM demand GROUP BY 1),
cal AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM b),
daily AS (SELECT cal.series_id, cal.ds, coalesce(d.y, 0.0) AS y FROM cal LEFT JOIN demand d
          ON cal.series_id = d.series_id AND cal.ds = d.ds)
"""


@register("ag1_daily_demand_gapfilled", _DAILY_SQL + "SELECT series_id, ds, round(y, 4) AS y FROM daily")
def q_ag1(spark, sf):
    return daily_demand(spark, sf).select("series_id", "ds", F.round("y", 4).alias("y"))


def demand_features(spark, sf):
    d = daily_demand(spark, sf)
    d = wn.add_lags(d, KEYS, ORDER, "y", [7])
    d = wn.rolling_mean(d, KEYS, ORDER, "y", 7)
    return d


_FEAT_SQL = _DAILY_SQL + """,
feat AS (SELECT series_id, ds, y, lag(y, 7) OVER w AS y_lag7,
  CASE WHEN count(*) OVER w7 = 7 THEN avg(y) OVER w7 END AS y_roll7
  FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ds),
  w7 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
"""


@register("wn1_wn2_lag_rolling_features",
          _FEAT_SQL + "SELECT series_id, ds, round(y,4) AS y, round(y_lag7,4) AS y_lag7, round(y_roll7,4) AS y_roll7 FROM feat")
def q_wn12(spark, sf):
    d = demand_features(spark, sf)
    return d.select("series_id", "ds", F.round("y", 4).alias("y"), F.round("y_lag7", 4).alias("y_lag7"),
                    F.round("y_roll7", 4).alias("y_roll7"))


@register("prj9_dropna_features",
          _FEAT_SQL + "SELECT series_id, ds, round(y,4) AS y, round(y_lag7,4) AS y_lag7, round(y_roll7,4) AS y_roll7 "
                      "FROM feat WHERE y_lag7 IS NOT NULL AND y_roll7 IS NOT NULL")
def q_prj9(spark, sf):
    return q_wn12(spark, sf).na.drop()


@register("wn3_days_since_previous_shipment", view_sql("demand") + """
SELECT series_id, ds, CAST(ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS BIGINT) AS days_since_prev
FROM demand""")
def q_wn3(spark, sf):
    d = view(spark, sf, "demand").select("series_id", "ds")
    return wn.days_since_previous(d, KEYS, "ds").withColumn("days_since_prev", F.col("days_since_prev").cast("bigint"))


@register("wn4_configured_lags", _DAILY_SQL + """
SELECT series_id, ds, round(lag(y,7) OVER w,4) AS y_lag7, round(lag(y,14) OVER w,4) AS y_lag14,
       round(lag(y,21) OVER w,4) AS y_lag21
FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ds)""")
def q_wn4(spark, sf):
    d = wn.add_lags(daily_demand(spark, sf), KEYS, ORDER, "y", [7, 14, 21])
    return d.select("series_id", "ds", *[F.round(f"y_lag{k}", 4).alias(f"y_lag{k}") for k in (7, 14, 21)])


@register("wn5_configured_rolling", _DAILY_SQL + """
SELECT series_id, ds,
  round(CASE WHEN count(*) OVER w7 = 7 THEN avg(y) OVER w7 END, 4) AS y_mean7,
  round(CASE WHEN count(*) OVER w14 = 14 THEN stddev_samp(y) OVER w14 END, 4) AS y_std14
FROM daily WINDOW w7 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w14 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def q_wn5(spark, sf):
    d = wn.rolling_mean(daily_demand(spark, sf), KEYS, ORDER, "y", 7, "y_mean7")
    d = wn.rolling_stddev(d, KEYS, ORDER, "y", 14, "y_std14")
    return d.select("series_id", "ds", F.round("y_mean7", 4).alias("y_mean7"), F.round("y_std14", 4).alias("y_std14"))
