"""Forecasting for many series at once (FC rows)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ensemble_mean(cols: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Mean of the available forecasts, nulls skipped; with weights, the weights
    are renormalised over the models present (FC9)."""
    w = list(weights) if weights else [1.0] * len(cols)
    num = sum((F.coalesce(F.col(c) * wi, F.lit(0.0)) for c, wi in zip(cols, w)), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(wi)).otherwise(F.lit(0.0)) for c, wi in zip(cols, w)), F.lit(0.0))
    return F.when(den > 0, num / den)


# --------------------------------------------------------------------------
# Regularised additive regression forecaster (FC2/FC3), fitted for every
# series at once.  The only data-sized work is a grouped sum of x_i*x_j
# (the Gram matrix) -- a partial aggregate in the JVM.  The K x K solve runs
# per series in ``mapInPandas`` on the one-row Gram table.
# --------------------------------------------------------------------------
import math as _math
from dataclasses import dataclass, field

import numpy as _np
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as _T


@dataclass
class ForecastSpec:
    growth: str = "linear"                 # linear | logistic
    seasonality_mode: str = "additive"     # additive | multiplicative
    n_changepoints: int = 5
    changepoint_range: float = 0.8
    yearly_order: int = 4
    weekly_order: int = 3
    monthly_order: int = 0
    quarterly_order: int = 0
    ridge: float = 1.0
    changepoint_prior: float = 1.0         # prior scales: a feature's penalty is ridge / prior^2
    seasonality_prior: float = 1.0
    holidays_prior: float = 1.0
    interval_width: float = 0.8
    cap: float | None = None               # logistic ceiling; None: cap_headroom times each series' maximum
    cap_headroom: float = 1.5
    floor: float = 0.0
    regressors: list = field(default_factory=list)
    holidays: str = "grouped"              # none | grouped (holiday, inventory day) | per_name


def supply_chain_spec(**changes) -> ForecastSpec:
    """The forecaster's production settings; ``changes`` replace single fields."""
    # Growth, seasonality mode, seasonal orders and prior scales.
    return ForecastSpec(**{"growth": "logistic", "seasonality_mode": "multiplicative", "yearly_order": 8, "weekly_order": 3,
                           "monthly_order": 5, "quarterly_order": 8, "changepoint_prior": 0.05, "seasonality_prior": 10.0,
                           "holidays_prior": 10.0} | changes)


def _penalties(names: Sequence[str], spec: ForecastSpec, priors: Sequence[float] | None = None) -> list[float]:
    """Ridge of each feature; ``priors``: change point, seasonality and holiday scales in place of the spec's.
    The intercept is not shrunk; trend and regressors have scale 1."""
    changepoint, seasonality, holidays = priors or (spec.changepoint_prior, spec.seasonality_prior, spec.holidays_prior)

    def scale(name: str) -> float:
        if name.startswith("cp"):
            return changepoint
        if name.startswith(("yearly_", "weekly_", "monthly_", "quarterly_")):
            return seasonality
        return holidays if name in ("holiday", "inventory_day") or name.startswith("h_") else 1.0
    return [0.0 if n == "intercept" else spec.ridge / (1.0 if n in spec.regressors else scale(n)) ** 2 for n in names]


def _feature_columns(ds: Column, t0: Column, span: Column, spec: ForecastSpec) -> list[tuple[str, Column]]:
    t = F.datediff(ds, t0).cast("double") / F.greatest(span.cast("double"), F.lit(1.0))
    cols = [("intercept", F.lit(1.0)), ("trend", t)]
    for k in range(spec.n_changepoints):
        c = spec.changepoint_range * (k + 1) / (spec.n_changepoints + 1)
        cols.append((f"cp{k}", F.greatest(F.lit(0.0), t - c)))
    day = F.unix_date(ds).cast("double")
    for name, period, order in (("yearly", 365.25, spec.yearly_order), ("weekly", 7.0, spec.weekly_order),
                                ("monthly", 30.5, spec.monthly_order), ("quarterly", 91.25, spec.quarterly_order)):
        for i in range(1, order + 1):
            arg = day * (2.0 * _math.pi * i / period)
            cols += [(f"{name}_s{i}", F.sin(arg)), (f"{name}_c{i}", F.cos(arg))]
    if spec.holidays == "grouped":
        cols.append(("holiday", F.when(F.col("_holiday").isNotNull() & (F.col("_holiday") != "inventory_day"), 1.0).otherwise(0.0)))
        cols.append(("inventory_day", F.when(F.col("_holiday") == "inventory_day", 1.0).otherwise(0.0)))
    elif spec.holidays == "per_name":
        for name in HOLIDAY_NAMES:
            cols.append((f"h_{name}", F.when(F.col("_holiday") == name, 1.0).otherwise(0.0)))
    for r in spec.regressors:
        cols.append((r, F.col(r).cast("double")))
    return cols


# Holiday names of the generated calendar (FN3), in calendar order.
HOLIDAY_NAMES = ["New Year's Day", "Martin Luther King Jr. Day", "Washington's Birthday", "Memorial Day",
                 "Juneteenth National Independence Day", "Independence Day", "Labor Day", "Columbus Day",
                 "Veterans Day", "Thanksgiving", "Christmas Day", "inventory_day"]


def _with_holidays(df: DataFrame, ds: str, spec: ForecastSpec) -> DataFrame:
    """Attach the holiday name of each date (null if none), a column expression for any year."""
    if spec.holidays == "none":
        return df
    from ..functions.calendar import us_holiday_name
    return df.withColumn("_holiday", us_holiday_name(ds))


def _transform_y(y: Column, spec: ForecastSpec) -> Column:
    if spec.growth == "logistic":
        p = (y - spec.floor) / (F.col("cap") - spec.floor)
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))
    if spec.seasonality_mode == "multiplicative":
        return F.log1p(F.greatest(y, F.lit(0.0)))
    return y


def _inverse_y(z: Column, spec: ForecastSpec) -> Column:
    if spec.growth == "logistic":
        return spec.floor + (F.col("cap") - spec.floor) / (1 + F.exp(-z))
    if spec.seasonality_mode == "multiplicative":
        return F.expm1(z)
    return z


def _solve_batches(it, k: int, penalties: dict[str | None, list[float]], columns: list[str]):
    """Solve each Gram matrix once per entry of ``penalties`` (candidate name: ridge of each feature)."""
    iu = _np.triu_indices(k)
    for pdf in it:
        grams = []
        for xtx_u, xty, n, yty in zip(pdf["xtx"], pdf["xty"], pdf["n"], pdf["yty"]):
            a = _np.zeros((k, k))
            a[iu] = _np.asarray(xtx_u, dtype=float)
            grams.append((a + _np.triu(a, 1).T, _np.asarray(xty, dtype=float), n, yty))
        for name, penalty in penalties.items():
            reg = _np.diag(_np.asarray(penalty) + 1e-9)
            betas, sds = [], []
            for a, b, n, yty in grams:
                beta = _np.linalg.solve(a + reg, b)
                sse = float(yty - 2 * beta @ b + beta @ a @ beta)
                sds.append(_math.sqrt(max(sse, 0.0) / max(n - 1, 1)))
                betas.append(beta.tolist())
            yield pdf.assign(beta=betas, resid_sd=sds, candidate=name)[columns]


#: Keys whose partial sums one task holds at a time.
HELD_KEYS = 1000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys`` that adaptive execution does not merge by size: the work after it is in
    arithmetic, not in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def gram_matrices(d: DataFrame, keys: list[str], x: str, y: str, k: int) -> DataFrame:
    """Per key: upper triangle of X'X, X'y, n and y'y.

    Each task folds its rows into one partial Gram per key with numpy
    (``mapInPandas`` over Arrow batches); the partials are exploded to
    ``(key, cell, value)`` and summed by an ordinary grouped aggregate, so a
    long series is spread over all tasks and no group collects its rows."""
    iu = np.triu_indices(k)
    ncell = len(iu[0]) + k + 2
    key_fields = [f for f in d.schema.fields if f.name in keys]
    part_schema = _T.StructType(key_fields + [_T.StructField("_cells", _T.ArrayType(_T.DoubleType()))])

    def table(held):
        return pd.DataFrame([[*kv, cells.tolist()] for kv, cells in held.items()], columns=keys + ["_cells"])

    def partial(it):
        held = {}  # sums of the task so far; written out beyond HELD_KEYS, so memory stays bounded
        for pdf in it:
            for kv, g in pdf.groupby(keys, sort=False, dropna=False):
                X = np.stack(g[x].to_numpy()).astype(float)
                yy = g[y].to_numpy(dtype=float)
                cells = np.concatenate([(X.T @ X)[iu], X.T @ yy, [float(len(g)), float(yy @ yy)]])
                kv = kv if isinstance(kv, tuple) else (kv,)
                held[kv] = held[kv] + cells if kv in held else cells
            if len(held) > HELD_KEYS:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    parts = d.select(*keys, x, y).mapInPandas(partial, part_schema)
    cells = parts.select(*keys, F.posexplode("_cells").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    per = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_c"))  # ncell entries per key
    v = F.transform("_c", lambda c: c["_v"])
    nt = len(iu[0])
    return per.select(*keys, F.slice(v, 1, nt).alias("xtx"), F.slice(v, nt + 1, k).alias("xty"),
                      F.element_at(v, nt + k + 1).cast("long").alias("n"), F.element_at(v, ncell).alias("yty"))


def fit_forecaster(df: DataFrame, keys: list[str], ds: str = "ds", y: str = "y", spec: ForecastSpec | None = None,
                   priors: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Fit one regularised regression per key.  Returns ``keys, t0, span, last_ds, n, beta, resid_sd`` (one
    small row per series), with the series' ``cap`` when growth is logistic.  ``priors`` (candidate name:
    change point, seasonality and holiday scales) solves the same Gram matrices once per candidate; its
    name is then a further column ``candidate``."""
    spec = spec or ForecastSpec()
    extent = [F.min(ds).alias("t0"), F.max(ds).alias("last_ds")]
    if spec.growth == "logistic":
        top = F.lit(float(spec.cap)) if spec.cap is not None else F.max(y) * spec.cap_headroom
        extent.append(F.greatest(top.cast("double"), F.lit(spec.floor + 1.0)).alias("cap"))
    bounds = df.groupBy(*keys).agg(*extent)
    bounds = bounds.withColumn("span", F.datediff("last_ds", "t0"))
    per_series = [c for c in bounds.columns if c not in keys]
    d = _with_holidays(df.drop(*per_series).join(bounds, keys), ds, spec)
    feats = _feature_columns(F.col(ds), F.col("t0"), F.col("span"), spec)
    names = [n for n, _ in feats]
    d = d.select(*keys, *per_series, _transform_y(F.col(y), spec).alias("_y"),
                 F.array(*[c.cast("double") for _, c in feats]).alias("_x"))
    gram = gram_matrices(d, [*keys, *per_series], "_x", "_y", len(names))
    schema = _T.StructType([f for f in gram.schema.fields if f.name not in ("xtx", "xty", "yty")] + [
        _T.StructField("beta", _T.ArrayType(_T.DoubleType())), _T.StructField("resid_sd", _T.DoubleType())])
    penalties = {None: _penalties(names, spec)}
    if priors:
        schema = schema.add("candidate", _T.StringType())
        penalties = {name: _penalties(names, spec, scales) for name, scales in priors.items()}
    return spread(gram, *keys).mapInPandas(lambda it: _solve_batches(it, len(names), penalties, schema.names), schema)


def predict(model: DataFrame, keys: list[str], periods: int | None = None, future: DataFrame | None = None,
            spec: ForecastSpec | None = None, freq_days: int = 1) -> DataFrame:
    """Forecast ``periods`` steps after each series' last date (or the given
    ``future`` rows): ``keys, ds, yhat, yhat_lower, yhat_upper``, and ``candidate`` if the model has it."""
    spec = spec or ForecastSpec()
    if future is None:
        fut = model.select("*", F.explode(F.sequence(F.date_add("last_ds", freq_days),
                                                     F.date_add("last_ds", freq_days * periods),
                                                     F.expr(f"INTERVAL {freq_days} DAYS"))).alias("ds"))
    else:
        fut = future.join(model, keys)
    fut = _with_holidays(fut, "ds", spec)
    feats = _feature_columns(F.col("ds"), F.col("t0"), F.col("span"), spec)
    x = F.array(*[c.cast("double") for _, c in feats])
    z = F.aggregate(F.zip_with("beta", x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    zq = NormalDist().inv_cdf((1.0 + spec.interval_width) / 2.0)
    fut = fut.withColumn("_z", z)
    named = [c for c in ("candidate",) if c in model.columns]
    return fut.select(*keys, *named, "ds", _inverse_y(F.col("_z"), spec).alias("yhat"),
                      _inverse_y(F.col("_z") - zq * F.col("resid_sd"), spec).alias("yhat_lower"),
                      _inverse_y(F.col("_z") + zq * F.col("resid_sd"), spec).alias("yhat_upper"))


def cutoffs(df: DataFrame, keys: list[str], ds: str, initial_days: int, period_days: int, horizon_days: int) -> DataFrame:
    """Rolling-origin cutoffs per series (WN12): from first + initial to
    last - horizon, every ``period`` days."""
    b = df.groupBy(*keys).agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    first = F.date_add("_lo", initial_days)
    last = F.date_sub("_hi", horizon_days)
    return (b.filter(first <= last)
             .select(*keys, F.explode(F.sequence(first, last, F.expr(f"INTERVAL {period_days} DAYS"))).alias("cutoff")))


def linear_baseline(df: DataFrame, keys: list[str], ds: str = "ds", y: str = "y") -> DataFrame:
    """FC12: per series linear trend (least squares on the day number) plus the
    mean residual of each weekday, and the residual sd."""
    d = df.withColumn("_t", F.unix_date(ds).cast("double"))
    fit = d.groupBy(*keys).agg(F.regr_slope(y, "_t").alias("slope"), F.regr_intercept(y, "_t").alias("intercept"))
    r = d.join(fit, keys).withColumn("_res", F.col(y) - (F.col("intercept") + F.col("slope") * F.col("_t")))
    wk = r.groupBy(*keys, F.weekday(ds).alias("weekday")).agg(F.avg("_res").alias("weekday_effect"))
    sd = r.groupBy(*keys).agg(F.stddev_samp("_res").alias("resid_sd"))
    return fit.join(wk, keys).join(sd, keys)
