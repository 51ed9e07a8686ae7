"""Calendar queries (FN1-FN7)."""
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register


@register("fn1_datetime_parts", """
SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
       CAST(quarter(ts) AS BIGINT) AS quarter, CAST(dayofyear(ts) AS BIGINT) AS day_of_year,
       CAST(month(ts) AS BIGINT) AS month FROM events""")
def q_fn1(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", *[c.cast("bigint").alias(k) for k, c in cal.datetime_parts("ts").items()])


def _ship_days(spark, sf):
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("ds")).distinct()


@register("fn2_custom_holiday_flag", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds,
  (month(l_shipdate) = 1 AND day(l_shipdate) = 1) OR (month(l_shipdate) = 12 AND day(l_shipdate) = 25)
  OR (month(l_shipdate) = 10 AND day(l_shipdate) = 20) AS is_holiday FROM lineitem""")
def q_fn2(spark, sf):
    return _ship_days(spark, sf).select("ds", cal.is_custom_holiday("ds").alias("is_holiday"))


@register("fn3_country_holidays_join", view_sql("demand") + """,
yrs AS (SELECT CAST(unnest(range(min(year(ds)), max(year(ds)) + 2)) AS INTEGER) AS y FROM demand),
hol AS (SELECT CAST(ds AS DATE) AS ds, holiday FROM (
  SELECT (CASE dayofweek(make_date(y, 1, 1)) WHEN 6 THEN make_date(y, 1, 1) - 1 WHEN 0 THEN make_date(y, 1, 1) + 1 ELSE make_date(y, 1, 1) END) AS ds, 'New Year''s Day' AS holiday FROM yrs
  UNION ALL SELECT (make_date(y, 1, 1) + CAST((1 - dayofweek(make_date(y, 1, 1)) + 7) % 7 + 14 AS INTEGER)) AS ds, 'Martin Luther King Jr. Day' AS holiday FROM yrs
  UNION ALL SELECT (make_date(y, 2, 1) + CAST((1 - dayofweek(make_date(y, 2, 1)) + 7) % 7 + 14 AS INTEGER)) AS ds, 'Washington''s Birthday' AS holiday FROM yrs
  UNION ALL SELECT (last_day(make_date(y, 5, 1)) - CAST((dayofweek(last_day(make_date(y, 5, 1))) - 1 + 7) % 7 AS INTEGER)) AS ds, 'Memorial Day' AS holiday FROM yrs
  UNION ALL SELECT CASE WHEN y >= 2021 THEN (CASE dayofweek(make_date(y, 6, 19)) WHEN 6 THEN make_date(y, 6, 19) - 1 WHEN 0 THEN make_date(y, 6, 19) + 1 ELSE make_date(y, 6, 19) END) END AS ds, 'Juneteenth National Independence Day' AS holiday FROM yrs
  UNION ALL SELECT (CASE dayofweek(make_date(y, 7, 4)) WHEN 6 THEN make_date(y, 7, 4) - 1 WHEN 0 THEN make_date(y, 7, 4) + 1 ELSE make_date(y, 7, 4) END) AS ds, 'Independence Day' AS holiday FROM yrs
  UNION ALL SELECT (make_date(y, 9, 1) + CAST((1 - dayofweek(make_date(y, 9, 1)) + 7) % 7 + 0 AS INTEGER)) AS ds, 'Labor Day' AS holiday FROM yrs
  UNION ALL SELECT (make_date(y, 10, 1) + CAST((1 - dayofweek(make_date(y, 10, 1)) + 7) % 7 + 7 AS INTEGER)) AS ds, 'Columbus Day' AS holiday FROM yrs
  UNION ALL SELECT (CASE dayofweek(make_date(y, 11, 11)) WHEN 6 THEN make_date(y, 11, 11) - 1 WHEN 0 THEN make_date(y, 11, 11) + 1 ELSE make_date(y, 11, 11) END) AS ds, 'Veterans Day' AS holiday FROM yrs
  UNION ALL SELECT (make_date(y, 11, 1) + CAST((4 - dayofweek(make_date(y, 11, 1)) + 7) % 7 + 21 AS INTEGER)) AS ds, 'Thanksgiving' AS holiday FROM yrs
  UNION ALL SELECT (CASE dayofweek(make_date(y, 12, 25)) WHEN 6 THEN make_date(y, 12, 25) - 1 WHEN 0 THEN make_date(y, 12, 25) + 1 ELSE make_date(y, 12, 25) END) AS ds, 'Christmas Day' AS holiday FROM yrs
  UNION ALL SELECT last_day(make_date(y, 3, 1)) AS ds, 'inventory_day' AS holiday FROM yrs
  UNION ALL SELECT last_day(make_date(y, 6, 1)) AS ds, 'inventory_day' AS holiday FROM yrs
  UNION ALL SELECT last_day(make_date(y, 9, 1)) AS ds, 'inventory_day' AS holiday FROM yrs
  UNION ALL SELECT last_day(make_date(y, 12, 1)) AS ds, 'inventory_day' AS holiday FROM yrs
) WHERE ds IS NOT NULL)
SELECT d.ds, h.holiday, round(sum(d.y), 4) AS y FROM demand d LEFT JOIN hol h ON d.ds = h.ds GROUP BY 1, 2""")
def q_fn3(spark, sf):
    """Daily demand joined to the generated holiday table for the years in the data and the next one,
    whose New Year's Day may be observed on 31 December."""
    d = view(spark, sf, "demand")
    years = d.agg(F.min(F.year("ds")).alias("lo"), F.max(F.year("ds")).alias("hi"))
    hol = cal.holidays_of_years(years.select(F.explode(F.sequence("lo", F.col("hi") + 1)).alias("y")))
    return (d.join(hol, "ds", "left")
             .groupBy("ds", "holiday").agg(F.sum("y").alias("y"))
             .select("ds", "holiday", F.round("y", 4).alias("y")))


@register("fn4_period_end_flags", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds, CAST(l_shipdate AS DATE) = last_day(l_shipdate) AS is_month_end,
  CAST(l_shipdate AS DATE) = last_day(l_shipdate) AND month(l_shipdate) % 3 = 0 AS is_quarter_end FROM lineitem""")
def q_fn4(spark, sf):
    return _ship_days(spark, sf).select("ds", *[c.alias(k) for k, c in cal.period_end_flags("ds").items()])


@register("fn5_fourier_terms", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds,
  round(sin(dayofyear(l_shipdate) * 2 * 1 * pi() / 365.25), 6) AS yearly_sin1,
  round(cos(dayofyear(l_shipdate) * 2 * 1 * pi() / 365.25), 6) AS yearly_cos1,
  round(sin(dayofyear(l_shipdate) * 2 * 2 * pi() / 365.25), 6) AS yearly_sin2,
  round(cos(dayofyear(l_shipdate) * 2 * 2 * pi() / 365.25), 6) AS yearly_cos2,
  round(sin(dayofyear(l_shipdate) * 2 * 1 * pi() / 7), 6) AS weekly_sin1,
  round(cos(dayofyear(l_shipdate) * 2 * 1 * pi() / 7), 6) AS weekly_cos1
FROM lineitem""")
def q_fn5(spark, sf):
    d = _ship_days(spark, sf)
    cols = {**cal.fourier_terms("ds", 365.25, (1, 2), prefix="yearly"), **cal.fourier_terms("ds", 7.0, (1,), prefix="weekly")}
    return d.select("ds", *[F.round(c, 6).alias(k) for k, c in cols.items()])


@register("fn6_fiscal_week_of_sundays", """
WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds FROM lineitem),
s AS (SELECT ds, make_date(CASE WHEN month(ds) >= 4 THEN year(ds) ELSE year(ds) - 1 END, 4, 1) AS fy_start FROM d
      WHERE dayofweek(ds) = 0),
f AS (SELECT ds, fy_start, fy_start + CAST((7 - dayofweek(fy_start)) % 7 AS INTEGER) AS first_sunday FROM s)
SELECT ds, CAST((ds - first_sunday) // 7 + 1 AS BIGINT) AS fiscal_week FROM f
WHERE ds >= first_sunday AND ds <= least(make_date(year(fy_start) + 1, 3, 30), last_day(make_date(year(fy_start) + 1, 3, 1)))""")
def q_fn6(spark, sf):
    d = _ship_days(spark, sf).filter(F.dayofweek("ds") == 1)
    return d.select("ds", cal.fiscal_week("ds", 4).cast("bigint").alias("fiscal_week")).filter(F.col("fiscal_week").isNotNull())


@register("fn7_business_day_lead_time", view_sql("shipments") + """,
pairs AS (SELECT DISTINCT order_date AS a, ship_date AS b FROM shipments),
cnt AS (SELECT a, b, CASE WHEN a <= b THEN
            (SELECT count(*) FROM range(0, b - a) t(i) WHERE isodow(a + CAST(i AS INTEGER)) <= 5)
          ELSE -(SELECT count(*) FROM range(1, a - b + 1) t(i) WHERE isodow(b + CAST(i AS INTEGER)) <= 5) END AS n
        FROM pairs)
SELECT s.order_key, s.line_no, CAST(c.n AS BIGINT) AS lead_time_days
FROM shipments s JOIN cnt c ON s.order_date = c.a AND s.ship_date = c.b""")
def q_fn7(spark, sf):
    sh = view(spark, sf, "shipments")
    return sh.select("order_key", "line_no", cal.business_days("order_date", "ship_date").alias("lead_time_days"))
