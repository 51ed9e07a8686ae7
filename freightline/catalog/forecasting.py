"""Forecasting, metrics, ordered features and scaling queries (AG6-8, FC, WN6-14, ML1-4, ML14)."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, round_significant, round_significant_sql
from ..operators import aggregates as ag
from ..operators import windows as wn
from ..plans import crossval as cv
from ..plans import forecast as fc
from ..plans import scaling as sc
from ..plans import windowmodel as wm
from ..session import scratch_path, stored
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register
from .demand import _DAILY_SQL, daily_demand

R = "CAST(round(CAST({} AS DECIMAL(38,8)), 4) AS DOUBLE)"
K = ["series_id"]

_PAIRS_SQL = _DAILY_SQL + """,
pairs AS (SELECT t.series_id, t.ds, t.y, f.y AS yhat, f.y - 10 AS yhat_lower, f.y + 10 AS yhat_upper
          FROM daily t JOIN daily f ON t.series_id = f.series_id AND t.ds = f.ds + 7)
"""


def truth_vs_naive(spark, sf):
    d = daily_demand(spark, sf)
    f = d.select("series_id", F.date_add("ds", 7).alias("ds"), F.col("y").alias("yhat"))
    j = d.join(f, ["series_id", "ds"])
    return j.withColumns({"yhat_lower": F.col("yhat") - 10, "yhat_upper": F.col("yhat") + 10})


_METRICS_SQL = _PAIRS_SQL + """,
m AS (SELECT series_id, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
        avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
        avg(CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 1.0 ELSE 0.0 END) AS coverage,
        CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY 1)
"""


@register("ag6_forecast_accuracy", _METRICS_SQL + f"""
SELECT series_id, {R.format('mae')} AS mae, {R.format('rmse')} AS rmse, {round_significant_sql('mape')} AS mape,
       {R.format('coverage')} AS coverage, n FROM m""")
def q_ag6(spark, sf):
    m = ag.forecast_accuracy(truth_vs_naive(spark, sf), K)
    return m.select("series_id", *[round_half_up(c, 4).alias(c) for c in ("mae", "rmse", "coverage")],
                    round_significant("mape").alias("mape"), "n")


@register("ag7_pinball_loss", _PAIRS_SQL + f"""
SELECT series_id, {R.format('avg(greatest(0.1 * (y - yhat * 0.8), (0.1 - 1) * (y - yhat * 0.8)))')} AS pinball_10,
  {R.format('avg(greatest(0.5 * (y - yhat), (0.5 - 1) * (y - yhat)))')} AS pinball_50,
  {R.format('avg(greatest(0.9 * (y - yhat * 1.2), (0.9 - 1) * (y - yhat * 1.2)))')} AS pinball_90 FROM pairs GROUP BY 1""")
def q_ag7(spark, sf):
    p = truth_vs_naive(spark, sf).withColumns({"q10": F.col("yhat") * 0.8, "q50": F.col("yhat"), "q90": F.col("yhat") * 1.2})
    r = ag.pinball_loss(p, K, "y", {0.1: "q10", 0.5: "q50", 0.9: "q90"})
    return r.select("series_id", *[round_half_up(c, 4).alias(c) for c in ("pinball_10", "pinball_50", "pinball_90")])


# Acceptance thresholds for forecast metrics (MAPE in percent).
THRESHOLDS = {"mae": 15.0, "rmse": 20.0, "mape": 10.0}


@register("ag8_metric_thresholds", _METRICS_SQL + """
SELECT series_id, mae <= 15.0 AS mae_ok, rmse <= 20.0 AS rmse_ok, mape * 100 <= 10.0 AS mape_ok,
  mae <= 15.0 AND rmse <= 20.0 AND mape * 100 <= 10.0 AS passed FROM m""")
def q_ag8(spark, sf):
    m = ag.forecast_accuracy(truth_vs_naive(spark, sf), K)
    ok = {"mae_ok": F.col("mae") <= THRESHOLDS["mae"], "rmse_ok": F.col("rmse") <= THRESHOLDS["rmse"],
          "mape_ok": F.col("mape") * 100 <= THRESHOLDS["mape"]}
    return m.select("series_id", *[v.alias(k) for k, v in ok.items()],
                    (ok["mae_ok"] & ok["rmse_ok"] & ok["mape_ok"]).alias("passed"))


_GAPPY_SQL = view_sql("demand") + """,
bnd AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM demand GROUP BY 1),
grid AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM bnd),
gappy AS (SELECT g.series_id, g.ds, d.y FROM grid g LEFT JOIN demand d ON g.series_id = d.series_id AND g.ds = d.ds)
"""


def gappy_demand(spark, sf):
    d = view(spark, sf, "demand")
    cal = ag.calendar(d, K, "ds")
    return cal.join(d, K + ["ds"], "left")


@register("fc1_wn6_calendar_ffill_bfill", _GAPPY_SQL + """
SELECT series_id, ds, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS y FROM gappy""")
def q_fc1(spark, sf):
    g = wn.forward_back_fill(gappy_demand(spark, sf), K, ["ds"], ["y"])
    return g.select("series_id", "ds", F.round("y", 4).alias("y"))


@register("fc1_weekly_monthly_grid_ffill", _GAPPY_SQL + """,
ext AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM gappy GROUP BY 1),
pgrid AS (SELECT series_id, 'W' AS freq, CAST(unnest(generate_series(lo + CAST((7 - isodow(lo)) % 7 AS INTEGER), hi, INTERVAL 7 DAY)) AS DATE) AS ds FROM ext
  UNION ALL SELECT series_id, 'M', ds FROM (SELECT series_id, hi, last_day(CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE)) AS ds FROM ext)
  WHERE ds <= hi)
SELECT g.series_id, g.freq, g.ds, round(last_value(y.y IGNORE NULLS) OVER (PARTITION BY g.series_id, g.freq ORDER BY g.ds
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS y FROM pgrid g LEFT JOIN gappy y ON y.series_id = g.series_id AND y.ds = g.ds""")
def q_fc1_grid(spark, sf):
    """Missing dates at weekly and monthly frequency: the series on the grid, last known value carried on."""
    g = gappy_demand(spark, sf)
    grids = [ag.period_grid(g, K, "ds", f).withColumn("freq", F.lit(f)) for f in ("W", "M")]
    on = grids[0].unionByName(grids[1]).join(g, K + ["ds"], "left")
    w = Window.partitionBy(*K, "freq").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return on.select(*K, "freq", "ds", F.round(F.last("y", ignorenulls=True).over(w), 4).alias("y"))


@register("wn7_time_interpolation", _GAPPY_SQL + """,
nb AS (SELECT series_id, ds, y,
  last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
  last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
  first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM gappy)
SELECT series_id, ds, round(CASE WHEN y IS NOT NULL THEN y WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
  ELSE pv + (nv - pv) * (ds - pt) / (nt - pt) END, 4) AS y FROM nb""")
def q_wn7(spark, sf):
    g = wn.time_interpolate(gappy_demand(spark, sf), K, "ds", "y")
    return g.select("series_id", "ds", F.round("y", 4).alias("y"))


@register("wn8_sliding_sequences", _DAILY_SQL + """,
w AS (SELECT series_id, ds, y, count(*) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS nx,
  sum(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x_sum,
  count(*) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ny,
  lead(y, 1) OVER (PARTITION BY series_id ORDER BY ds) AS y_first,
  sum(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y_sum FROM daily)
SELECT series_id, ds, round(x_sum, 4) AS x_sum, round(y, 4) AS x_last, round(y_first, 4) AS y_first, round(y_sum, 4) AS y_sum
FROM w WHERE nx = 7 AND ny = 3""")
def q_wn8(spark, sf):
    s = wn.sliding_sequences(daily_demand(spark, sf), K, ["ds"], "y", 7, 3)
    return s.select("series_id", "ds", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("x_sum"),
                    F.round(F.element_at("x", -1), 4).alias("x_last"), F.round(F.element_at("y_future", 1), 4).alias("y_first"),
                    F.round(F.aggregate("y_future", F.lit(0.0), lambda a, v: a + v), 4).alias("y_sum"))


@register("wn9_sample_weights_by_change", _DAILY_SQL + """,
w AS (SELECT series_id, ds, count(*) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS nx,
  count(*) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS ny, lead(y, 1) OVER o AS f1, lead(y, 2) OVER o AS f2, lead(y, 3) OVER o AS f3, lead(y, 4) OVER o AS f4, lead(y, 5) OVER o AS f5, lead(y, 6) OVER o AS f6, lead(y, 7) OVER o AS f7
  FROM daily WINDOW o AS (PARTITION BY series_id ORDER BY ds)),
c AS (SELECT series_id, ds, (abs(f2 - f1) + abs(f3 - f2) + abs(f4 - f3) + abs(f5 - f4) + abs(f6 - f5) + abs(f7 - f6)) / 6 AS change FROM w WHERE nx = 30 AND ny = 7),
bk AS (SELECT *, CAST(floor(change / 5) AS BIGINT) AS bucket FROM c),
nb AS (SELECT bucket, count(*) AS n FROM bk GROUP BY 1)
SELECT bk.series_id, bk.ds, CAST(round(CAST(bk.change AS DECIMAL(38,8)), 6) AS DOUBLE) AS change, bk.bucket,
  CAST(round(CAST((SELECT count(*) FROM bk) / ((SELECT count(*) FROM nb) * nb.n) AS DECIMAL(38,8)), 6) AS DOUBLE) AS weight
FROM bk JOIN nb ON bk.bucket = nb.bucket""")
def q_wn9(spark, sf):
    """Mean absolute step of each horizon window, bucketed to steps of 5 units,
    then balanced (inverse-frequency) weights per bucket."""
    s = wn.sliding_sequences(daily_demand(spark, sf), K, ["ds"], "y", 30, 7)
    s = s.withColumn("change", wn.mean_abs_step(F.col("y_future")))
    s = s.withColumn("bucket", F.floor(F.col("change") / 5))
    cnt = s.groupBy("bucket").agg(F.count(F.lit(1)).alias("_nb"))
    total = s.agg(F.count(F.lit(1))).scalar()
    nbuckets = cnt.agg(F.count(F.lit(1))).scalar()
    w = s.join(cnt, "bucket").withColumn("weight", total / (nbuckets * F.col("_nb")))
    return w.select("series_id", "ds", F.round(F.col("change").cast("decimal(38,8)"), 6).cast("double").alias("change"),
                    F.col("bucket").cast("bigint").alias("bucket"),
                    F.round(F.col("weight").cast("decimal(38,8)"), 6).cast("double").alias("weight"))


@register("wn10_chronological_split", _DAILY_SQL + """
SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) <= floor(count(*) OVER (PARTITION BY series_id) * 0.8) AS is_train FROM daily""")
def q_wn10(spark, sf):
    return wn.chronological_split(daily_demand(spark, sf), K, ["ds"], 0.2).select("series_id", "ds", "is_train")


@register("wn11_expanding_time_folds", _DAILY_SQL + """,
r AS (SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM daily),
f AS (SELECT r.*, CAST(floor(n / 6) AS BIGINT) AS ts, fold FROM r, range(0, 5) t(fold)),
g AS (SELECT series_id, ds, rn, fold, CASE WHEN rn < n - 5 * ts + fold * ts THEN 'train'
        WHEN rn < n - 5 * ts + fold * ts + ts THEN 'test' END AS role FROM f)
SELECT series_id, ds, CAST(rn AS INTEGER) AS row_idx, CAST(fold AS INTEGER) AS fold, role FROM g WHERE role IS NOT NULL""")
def q_wn11(spark, sf):
    f = wn.expanding_folds(daily_demand(spark, sf), K, ["ds"], 5)
    return f.select("series_id", "ds", F.col("row_idx").cast("int").alias("row_idx"), F.col("fold").cast("int").alias("fold"), "role")


@register("wn12_rolling_origin_cutoffs", _DAILY_SQL + """,
c AS (SELECT series_id, CAST(unnest(generate_series(min(ds) + 365, max(ds) - 30, INTERVAL 30 DAY)) AS DATE) AS cutoff FROM daily GROUP BY 1)
SELECT c.series_id, c.cutoff, CAST(count(*) FILTER (WHERE d.ds <= c.cutoff) AS BIGINT) AS n_train,
  CAST(count(*) FILTER (WHERE d.ds > c.cutoff AND d.ds <= c.cutoff + 30) AS BIGINT) AS n_test
FROM c JOIN daily d ON c.series_id = d.series_id GROUP BY 1, 2""")
def q_wn12(spark, sf):
    """Cutoffs per series every 30 days, then each history row is tagged with the
    cutoffs it trains or tests (rows x cutoffs of its series), then counted."""
    d = daily_demand(spark, sf)
    c = fc.cutoffs(d, K, "ds", 365, 30, 30)
    cs = c.groupBy(*K).agg(F.collect_list("cutoff").alias("cuts"))  # <= span/period cutoffs per series
    x = d.join(cs, K).select(*K, "ds", F.explode("cuts").alias("cutoff"))
    return x.groupBy(*K, "cutoff").agg(F.count_if(F.col("ds") <= F.col("cutoff")).alias("n_train"),
                                       F.count_if((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.date_add("cutoff", 30))).alias("n_test"))


@register("wn13_cumulative_eta", view_sql("legs") + """
SELECT order_key, line_no, round(sum(distance_km / 80.0) OVER (PARTITION BY order_key ORDER BY line_no, distance_km, load_kg, value
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS eta_hours FROM legs""")
def q_wn13(spark, sf):
    lg = view(spark, sf, "legs").withColumn("hours", F.col("distance_km") / 80.0)
    r = wn.running_sum(lg, ["order_key"], ["line_no", "distance_km", "load_kg", "value"], "hours", "eta_hours")
    return r.select("order_key", "line_no", F.round("eta_hours", 4).alias("eta_hours"))


@register("wn14_profile_spacing", view_sql("legs") + """,
t AS (SELECT order_key, sum(distance_km) AS total, count(*) AS n FROM legs GROUP BY 1)
SELECT order_key, CAST(p AS INTEGER) AS pos, round(CASE WHEN n > 1 THEN p * total / (n - 1) ELSE 0 END, 4) AS offset_km
FROM t, range(0, 1000) r(p) WHERE p < n""")
def q_wn14(spark, sf):
    """``linspace(0, distance, n)`` positions for an order's n sampled points."""
    t = view(spark, sf, "legs").groupBy("order_key").agg(F.sum("distance_km").alias("total"), F.count(F.lit(1)).alias("n"))
    x = t.select("order_key", "total", "n", F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("pos", "_v"))
    off = F.when(F.col("n") > 1, F.col("pos") * F.col("total") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return x.select("order_key", F.col("pos").cast("int").alias("pos"), F.round(off, 4).alias("offset_km"))


@register("fc2_fc3_additive_forecast_30d")
def q_fc2(spark, sf):
    spec = fc.supply_chain_spec(growth="linear", seasonality_mode="additive")
    m = fc.fit_forecaster(daily_demand(spark, sf), K, spec=spec)
    return fc.predict(m, K, periods=30, spec=spec)


@register("fc2_multiplicative_logistic_variants")
def q_fc2b(spark, sf):
    """Both growth variants; the logistic ceiling is each series' own."""
    d = daily_demand(spark, sf)
    mult = fc.supply_chain_spec(growth="linear")
    logi = fc.supply_chain_spec()
    a = fc.predict(fc.fit_forecaster(d, K, spec=mult), K, periods=14, spec=mult).withColumn("variant", F.lit("multiplicative"))
    b = fc.predict(fc.fit_forecaster(d, K, spec=logi), K, periods=14, spec=logi).withColumn("variant", F.lit("logistic"))
    return a.unionByName(b)


@register("fc4_future_regressor_default", _DAILY_SQL + "SELECT series_id, ds, CAST(month(ds) * 2 + 10 AS BIGINT) AS regressor FROM daily")
def q_fc4(spark, sf):
    return daily_demand(spark, sf).select("series_id", "ds", (F.month("ds") * 2 + 10).cast("bigint").alias("regressor"))


@register("fc5_cross_validated_metrics")
def q_fc5(spark, sf):
    """Rolling-origin cross-validation (30-day horizon and period) in the production settings."""
    u = cv.cross_validate(daily_demand(spark, sf), K, spec=fc.supply_chain_spec())
    per_cut = ag.forecast_accuracy(u, K + ["cutoff"])
    return per_cut.groupBy(*K).agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "mape", "coverage")])


_T = "((d.ds - c.t0) / CAST(c.span AS DOUBLE))"
_HINGE = [f"greatest(0.0, {_T} - {0.8 * (k + 1) / 6!r})" for k in range(5)]


@register("fc5_gram_cells", _DAILY_SQL + f""",
ext AS (SELECT series_id, min(ds) AS t0, max(ds) AS t1 FROM daily GROUP BY 1),
cuts AS (SELECT series_id, t0, CAST(unnest(generate_series(t0 + INTERVAL 365 DAY, t1 - INTERVAL 30 DAY, INTERVAL 30 DAY)) AS DATE) AS cutoff FROM ext),
c AS (SELECT *, cutoff - t0 AS span FROM cuts)
SELECT c.series_id, c.cutoff, {R.format(f'sum({_T})')} AS intercept_trend, {R.format(f'sum({_T} * {_T})')} AS trend_trend,
  {R.format(f'sum({_HINGE[0]} * {_HINGE[0]})')} AS cp0_cp0, {R.format(f'sum({_HINGE[1]} * {_HINGE[3]})')} AS cp1_cp3,
  {R.format(f'sum({_T} * {_HINGE[4]})')} AS trend_cp4, {R.format(f'sum({_HINGE[2]})')} AS intercept_cp2,
  {R.format(f'sum(d.y * {_T})')} AS rhs_trend, {R.format(f'sum(d.y * {_HINGE[1]})')} AS rhs_cp1, TRUE AS solved
FROM c JOIN daily d ON d.series_id = c.series_id AND d.ds <= c.cutoff GROUP BY c.series_id, c.cutoff""")
def q_fc5_cells(spark, sf):
    """Cells of the Gram matrix of every series and cutoff as the prefix sums give them, and whether the
    solution satisfies the normal equations."""
    g = cv.gram_cells(daily_demand(spark, sf), K)
    cells = [c for c in g.columns if c not in (*K, "cutoff", "residual")]
    return g.select(*K, "cutoff", *[round_half_up(c, 4).alias(c) for c in cells], (F.col("residual") < 1e-8).alias("solved"))


@register("fc6_hyperparameter_search")
def q_fc6(spark, sf):
    """Guided search over 100 seeded log-uniform draws of the three prior scales, both seasonality modes, by
    successive halving on rolling-origin cutoffs; best by RMSE over all cutoffs."""
    import random
    rng = random.Random(42)
    candidates = {}
    for i in range(100):
        scales = [math.exp(rng.uniform(-5, 0)) for _ in range(3)]
        mode = ("additive", "multiplicative")[i % 2]
        candidates[f"{mode}_{i:02d}_" + "_".join(f"{x:.4f}" for x in scales)] = (mode, scales)
    return cv.search(daily_demand(spark, sf), K, candidates, spec=fc.supply_chain_spec(growth="linear"))


LOOKBACK, PRICE_LAGS, HORIZON = 30, 7, 7
#: 1, four calendar values, the demand's past, the price's past.
WIDTH = 5 + LOOKBACK + PRICE_LAGS


def priced_demand(spark, sf):
    """Daily demand with the day's mean unit price (null on days without sales)."""
    li = table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("ds"), "l_quantity", "l_extendedprice")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    price = li.join(part, li.l_partkey == part.p_partkey).groupBy("series_id", "ds").agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    return daily_demand(spark, sf).select(*K, "ds", F.col("y").cast("double").alias("y")).join(price, K + ["ds"], "left")


def demand_windows(spark, sf):
    return stored(wm.windows(priced_demand(spark, sf), K, "ds", "y", ["price"], LOOKBACK, PRICE_LAGS, HORIZON), "windows")


def _window_model(rows):
    return stored(wm.fit_windows(rows.filter(F.size("target") == HORIZON), K, WIDTH, HORIZON), "window-model")


@register("fc7_multi_horizon_window_regression")
def q_fc7(spark, sf):
    """Direct multi-horizon forecaster: 30 days of demand, 7 of price and the calendar, robustly scaled per
    series, all seven horizons from one Gram matrix; each series is forecast from its latest window."""
    rows = demand_windows(spark, sf)
    model = _window_model(rows)
    latest = rows.join(rows.groupBy(*K).agg(F.max("ds").alias("ds")), K + ["ds"])
    out = wm.apply_windows(latest, model, K, "ds", "y")
    return out.select(*K, F.date_add("ds", F.col("horizon")).alias("ds"), "horizon", "yhat")


def _gram(i, j):
    return F.col("gram")[i * WIDTH + j]


def _rhs(i, h):
    return F.col("gram")[WIDTH * WIDTH + i * HORIZON + h - 1]


@register("fc7_gram_cells", _DAILY_SQL + f""",
pr AS (SELECT p.p_brand AS series_id, CAST(l.l_shipdate AS DATE) AS ds, sum(l.l_extendedprice) / sum(l.l_quantity) AS price
       FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2),
dp AS (SELECT d.series_id, d.ds, CAST(d.y AS DOUBLE) AS y, CAST(pr.price AS DOUBLE) AS price FROM daily d LEFT JOIN pr ON pr.series_id = d.series_id AND pr.ds = d.ds),
q AS (SELECT series_id, quantile_cont(y, [0.25, 0.5, 0.75]) AS qy, quantile_cont(price, [0.25, 0.5, 0.75]) AS qp FROM dp GROUP BY 1),
s AS (SELECT dp.series_id, dp.ds, (y - qy[2]) / CASE WHEN qy[3] = qy[1] THEN 1 ELSE qy[3] - qy[1] END AS ys,
        coalesce((price - qp[2]) / CASE WHEN qp[3] = qp[1] THEN 1 ELSE qp[3] - qp[1] END, 0) AS ps FROM dp JOIN q USING (series_id)),
w AS (SELECT series_id, ds, ys, lag(ys, 29) OVER o AS y29, lag(ys, 1) OVER o AS y1, ps, lag(ps, 6) OVER o AS p6, lead(ys, 1) OVER o AS t1,
        lead(ys, 3) OVER o AS t3, lead(ys, 7) OVER o AS t7 FROM s WINDOW o AS (PARTITION BY series_id ORDER BY ds))
SELECT series_id, CAST(count(*) AS BIGINT) AS n, {R.format('sum(ys)')} AS one_last, {R.format('sum(y29 * ys)')} AS first_last,
  {R.format('sum(ys * p6)')} AS last_price6, {R.format('sum(sin((isodow(ds) - 1) * (2 * pi() / 7)) * ps)')} AS weekday_price,
  {R.format('sum(ys * t1)')} AS last_t1, {R.format('sum(y1 * t3)')} AS before_t3, {R.format('sum(p6 * t7)')} AS price6_t7, TRUE AS solved
FROM w WHERE y29 IS NOT NULL AND t7 IS NOT NULL GROUP BY 1""")
def q_fc7_cells(spark, sf):
    """Sums behind the window models: cells of X'X and X'Y per series, and whether the solution satisfies the
    normal equations of all horizons."""
    last = 5 + LOOKBACK - 1
    price = 5 + LOOKBACK
    m = _window_model(demand_windows(spark, sf))
    cells = {"one_last": _gram(0, last), "first_last": _gram(5, last), "last_price6": _gram(last, price),
             "weekday_price": _gram(1, price + PRICE_LAGS - 1), "last_t1": _rhs(last, 1), "before_t3": _rhs(last - 1, 3), "price6_t7": _rhs(price, 7)}
    return m.select(*K, "n", *[round_half_up(c, 4).alias(n) for n, c in cells.items()], (F.col("residual") < 1e-8).alias("solved"))


@register("fc8_window_residual_quantiles")
def q_fc8w(spark, sf):
    """Exact residual quantiles of the window models per series and horizon."""
    rows = demand_windows(spark, sf)
    q = wm.horizon_quantiles(wm.apply_windows(rows, _window_model(rows), K, "ds", "y"), K)
    return q.select(*K, "horizon", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@register("fc8_residual_quantiles", _PAIRS_SQL + f"""
SELECT series_id, CAST(isodow(ds) - 1 AS INTEGER) AS horizon, {R.format('quantile_cont(y - yhat, 0.1)')} AS q10,
  {R.format('quantile_cont(y - yhat, 0.5)')} AS q50, {R.format('quantile_cont(y - yhat, 0.9)')} AS q90,
  {R.format('avg(y - yhat)')} AS mean, {R.format('stddev_samp(y - yhat)')} AS sd FROM pairs GROUP BY 1, 2""")
def q_fc8(spark, sf):
    """Empirical residual quantiles per (series, horizon) (weekday as the horizon
    of a weekly cycle), exact interpolated percentiles."""
    p = truth_vs_naive(spark, sf).withColumn("e", F.col("y") - F.col("yhat"))
    q = F.percentile("e", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = p.groupBy(*K, F.weekday("ds").alias("horizon")).agg(q.alias("q"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"))
    return g.select(*K, "horizon", round_half_up(F.col("q")[0], 4).alias("q10"), round_half_up(F.col("q")[1], 4).alias("q50"),
                    round_half_up(F.col("q")[2], 4).alias("q90"), round_half_up("mean", 4).alias("mean"), round_half_up("sd", 4).alias("sd"))


@register("fc9_weighted_ensemble", _DAILY_SQL + f""",
fab AS (SELECT series_id, ds, max(f7) AS f7, max(f14) AS f14 FROM (
  SELECT series_id, ds + 7 AS ds, y AS f7, NULL AS f14 FROM daily UNION ALL SELECT series_id, ds + 14, NULL, y FROM daily) GROUP BY 1, 2)
SELECT series_id, ds,
  {R.format("(coalesce(f7 * 0.4, 0) + coalesce(f14 * 0.6, 0)) / (CASE WHEN f7 IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN f14 IS NOT NULL THEN 0.6 ELSE 0 END)")} AS ensemble
FROM fab""")
def q_fc9(spark, sf):
    d = daily_demand(spark, sf)
    a = d.select("series_id", F.date_add("ds", 7).alias("ds"), F.col("y").alias("f7"))
    b = d.select("series_id", F.date_add("ds", 14).alias("ds"), F.col("y").alias("f14"))
    j = a.join(b, ["series_id", "ds"], "full")
    return j.select("series_id", "ds", round_half_up(fc.ensemble_mean(["f7", "f14"], [0.4, 0.6]), 4).alias("ensemble"))


@register("fc10_band_95", _PAIRS_SQL + f""",
sd AS (SELECT series_id, stddev_samp(y - yhat) AS s FROM pairs GROUP BY 1)
SELECT p.series_id, p.ds, {R.format('p.yhat - 1.96 * sd.s')} AS lower_95, {R.format('p.yhat + 1.96 * sd.s')} AS upper_95
FROM pairs p JOIN sd ON p.series_id = sd.series_id""")
def q_fc10(spark, sf):
    p = truth_vs_naive(spark, sf)
    sd = p.groupBy(*K).agg(F.stddev_samp(F.col("y") - F.col("yhat")).alias("s"))
    j = p.join(sd, K)
    return j.select(*K, "ds", round_half_up(F.col("yhat") - 1.96 * F.col("s"), 4).alias("lower_95"),
                    round_half_up(F.col("yhat") + 1.96 * F.col("s"), 4).alias("upper_95"))


@register("fc11_inventory_demand_forecast")
def q_fc11(spark, sf):
    """All products at once: history window of the last 365 days of each
    series, then a 14-day look-ahead."""
    d = daily_demand(spark, sf)
    last = d.groupBy(*K).agg(F.max("ds").alias("_last"))
    h = d.join(last, K).filter(F.col("ds") > F.date_sub("_last", 365)).drop("_last")
    spec = fc.ForecastSpec(n_changepoints=3, yearly_order=2)
    return fc.predict(fc.fit_forecaster(h, K, spec=spec), K, periods=14, spec=spec)


@register("fc12_linear_trend_weekday_baseline", _DAILY_SQL + f""",
t AS (SELECT series_id, ds, y, CAST(ds - min(ds) OVER (PARTITION BY series_id) AS DOUBLE) AS t FROM daily),
fit AS (SELECT series_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM t GROUP BY 1),
res AS (SELECT t.series_id, t.ds, t.y - (fit.intercept + fit.slope * t.t) AS r FROM t JOIN fit ON t.series_id = fit.series_id)
SELECT f.series_id, CAST(isodow(res.ds) - 1 AS INTEGER) AS weekday, CAST(round(CAST(any_value(f.slope) AS DECIMAL(38,12)), 6) AS DOUBLE) AS slope,
  {R.format('any_value(f.intercept)')} AS intercept, {R.format('avg(res.r)')} AS weekday_effect
FROM fit f JOIN res ON f.series_id = res.series_id GROUP BY 1, 2""")
def q_fc12(spark, sf):
    d = daily_demand(spark, sf)
    t0 = d.groupBy(*K).agg(F.min("ds").alias("_t0"))
    d = d.join(t0, K).withColumn("t", F.datediff("ds", "_t0").cast("double"))
    fit = d.groupBy(*K).agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"))
    r = d.join(fit, K).withColumn("r", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("t")))
    g = r.groupBy(*K, F.weekday("ds").alias("weekday")).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
                                                            F.avg("r").alias("weekday_effect"))
    return g.select(*K, "weekday", F.round(F.col("slope").cast("decimal(38,12)"), 6).cast("double").alias("slope"),
                    round_half_up("intercept", 4).alias("intercept"), round_half_up("weekday_effect", 4).alias("weekday_effect"))


_SCALE_SQL = view_sql("shipments")


@register("ml1_standard_scaling", _SCALE_SQL + f"""
SELECT order_key, line_no, {R.format('(weight - (SELECT avg(weight) FROM shipments)) / (SELECT CASE WHEN stddev_pop(weight) = 0 THEN 1 ELSE stddev_pop(weight) END FROM shipments)')} AS weight_std
FROM shipments""")
def q_ml1(spark, sf):
    sh = view(spark, sf, "shipments").select("order_key", "line_no", "weight")
    return sc.standard_scale(sh, ["weight"]).select("order_key", "line_no", round_half_up("weight_std", 4).alias("weight_std"))


@register("ml2_robust_scaling", _SCALE_SQL + f""",
q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q75 FROM shipments)
SELECT order_key, line_no, {R.format('(value - q.med) / CASE WHEN q.q75 = q.q25 THEN 1 ELSE q.q75 - q.q25 END')} AS value_robust FROM shipments, q""")
def q_ml2(spark, sf):
    sh = view(spark, sf, "shipments").select("order_key", "line_no", "value")
    return sc.robust_scale(sh, ["value"]).select("order_key", "line_no", round_half_up("value_robust", 4).alias("value_robust"))


@register("ml3_minmax_scaling_roundtrip", _SCALE_SQL + f"""
SELECT order_key, line_no, {R.format('(quantity - (SELECT min(quantity) FROM shipments)) / ((SELECT max(quantity) FROM shipments) - (SELECT min(quantity) FROM shipments))')} AS quantity_mm,
  round(quantity, 4) AS quantity_back FROM shipments""")
def q_ml3(spark, sf):
    sh = view(spark, sf, "shipments").select("order_key", "line_no", "quantity")
    params = sc.fit_minmax(sh, ["quantity"])
    s = sc.apply_minmax(sh, params, "quantity", "quantity_mm")
    back = sc.apply_minmax(s.select("order_key", "line_no", F.col("quantity_mm").alias("quantity"), "quantity_mm"), params,
                           "quantity", "quantity_back", inverse=True)
    return back.select("order_key", "line_no", round_half_up("quantity_mm", 4).alias("quantity_mm"), F.round("quantity_back", 4).alias("quantity_back"))


@register("ml4_persisted_scaler", _SCALE_SQL + f"""
SELECT order_key, line_no, {R.format('(weight - (SELECT min(weight) FROM shipments)) / CASE WHEN (SELECT max(weight) FROM shipments) = (SELECT min(weight) FROM shipments) THEN 1.0 ELSE (SELECT max(weight) FROM shipments) - (SELECT min(weight) FROM shipments) END')} AS weight_mm
FROM shipments""")
def q_ml4(spark, sf):
    """Fit once, write the parameter table to the shared checkpoint folder,
    read it back and apply (the hand-off between two jobs)."""
    sh = view(spark, sf, "shipments").select("order_key", "line_no", "weight")
    path = sc.save_params(sc.fit_minmax(sh, ["weight"]), scratch_path(spark, "scaler"))
    out = sc.apply_minmax(sh, sc.load_params(spark, path), "weight", "weight_mm")
    return out.select("order_key", "line_no", round_half_up("weight_mm", 4).alias("weight_mm"))


@register("ml14_best_run_by_rmse", _DAILY_SQL + f""",
runs AS (SELECT 'naive7' AS version, t.series_id, sqrt(avg((t.y - f.y) * (t.y - f.y))) AS rmse FROM daily t JOIN daily f ON t.series_id = f.series_id AND t.ds = f.ds + 7 GROUP BY 2
  UNION ALL SELECT 'naive14', t.series_id, sqrt(avg((t.y - f.y) * (t.y - f.y))) FROM daily t JOIN daily f ON t.series_id = f.series_id AND t.ds = f.ds + 14 GROUP BY 2)
SELECT series_id, arg_min(version, (rmse, version)) AS best_version, {R.format('min(rmse)')} AS best_rmse FROM runs GROUP BY 1""")
def q_ml14(spark, sf):
    d = daily_demand(spark, sf)
    runs = None
    for lag in (7, 14):
        f = d.select("series_id", F.date_add("ds", lag).alias("ds"), F.col("y").alias("yhat"))
        r = d.join(f, ["series_id", "ds"]).groupBy("series_id").agg(
            F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("rmse")).withColumn("version", F.lit(f"naive{lag}"))
        runs = r if runs is None else runs.unionByName(r)
    return runs.groupBy("series_id").agg(F.min_by("version", F.struct("rmse", "version")).alias("best_version"),
                                         round_half_up(F.min("rmse"), 4).alias("best_rmse"))
