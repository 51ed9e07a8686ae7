"""Direct multi-horizon forecasts from sliding windows of several scaled inputs (FC7, FC8).

All horizons of a series share one Gram matrix and are solved together: one pass over the windows folds
X'X, X'Y and Y'Y into partial sums per task, which a grouped aggregate adds up.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import exact_quantiles
from .forecast import spread


def robust_series(df: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    """Append per series (x - median) / (q75 - q25) of every column as ``<c>_s``, with ``<c>_m`` and ``<c>_w``; a
    width of 0 divides by 1, a missing value becomes the median."""
    for c in cols:
        q = exact_quantiles(df, c, [0.25, 0.5, 0.75], keys)
        width = F.col("q")[2] - F.col("q")[0]
        q = q.select(*keys, F.col("q")[1].alias(f"{c}_m"), F.when(width == 0, 1.0).otherwise(width).alias(f"{c}_w"))
        df = df.join(q, keys, "left").withColumn(f"{c}_s", F.coalesce((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_w"), F.lit(0.0)))
    return df


def windows(df: DataFrame, keys: list[str], ds: str, y: str, inputs: Sequence[str], lookback: int, input_lags: int, horizon: int) -> DataFrame:
    """One row per anchor date with a full past: keys, ds, scale columns of ``y``, ``x`` (1, calendar of the anchor,
    ``lookback`` scaled values of y, ``input_lags`` of every input) and ``target`` (the next scaled values of y)."""
    d = robust_series(df, keys, [y, *inputs])
    w = Window.partitionBy(*keys).orderBy(ds)
    past = lambda c, n: F.collect_list(f"{c}_s").over(w.rowsBetween(-(n - 1), 0))
    turn = lambda v, period: [F.sin(v * (2 * math.pi / period)), F.cos(v * (2 * math.pi / period))]
    calendar = F.array(F.lit(1.0), *turn(F.weekday(ds), 7), *turn(F.dayofyear(ds), 365.25))
    d = d.select(*keys, ds, f"{y}_m", f"{y}_w", F.size(past(y, lookback)).alias("n_past"),
                 F.concat(calendar, past(y, lookback), *[past(c, input_lags) for c in inputs]).alias("x"),
                 F.collect_list(f"{y}_s").over(w.rowsBetween(1, horizon)).alias("target"))
    return d.filter(F.col("n_past") == lookback).drop("n_past")


def fit_windows(full: DataFrame, keys: list[str], k: int, horizon: int, ridge: float = 1.0) -> DataFrame:
    """Solve (X'X + ridge) B = X'Y per key for all horizons at once from windows with a full target: keys, n,
    ``betas`` (one array per horizon), ``resid_sd``, some ``cells`` of the sums, and the relative ``residual`` of
    the normal equations.  The intercept is not shrunk."""
    iu = np.triu_indices(k)
    fields = [f for f in full.schema.fields if f.name in keys]

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                x, v = np.stack(g["x"].to_numpy()), np.stack(g["target"].to_numpy())
                cells = np.concatenate([(x.T @ x)[iu], (x.T @ v).ravel(), (v * v).sum(0), [float(len(g))]])
                held[key] = held[key] + cells if key in held else cells
            if len(held) > 1000:
                yield pd.DataFrame([[*key, c.tolist()] for key, c in held.items()], columns=[*keys, "cells"])
                held = {}
        if held:
            yield pd.DataFrame([[*key, c.tolist()] for key, c in held.items()], columns=[*keys, "cells"])

    parts = full.select(*keys, "x", "target").mapInPandas(partial, T.StructType([*fields, T.StructField("cells", T.ArrayType(T.DoubleType()))]))
    cells = parts.select(*keys, F.posexplode("cells").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    sums = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))  # a fixed number per key
    sums = spread(sums.select(*keys, F.transform("c", lambda s: s["v"]).alias("sums")), *keys)
    schema = T.StructType([*fields, *T.StructType.fromDDL(
        "n long, betas array<array<double>>, resid_sd array<double>, gram array<double>, residual double").fields])

    def solve(batches):
        reg = np.diag([1e-9, *[ridge] * (k - 1)])
        for pdf in batches:
            rows = []
            for s in pdf["sums"]:
                s = np.asarray(s, float)
                a = np.zeros((k, k))
                a[iu] = s[:len(iu[0])]
                a = a + np.triu(a, 1).T
                b = s[len(iu[0]):len(iu[0]) + k * horizon].reshape(k, horizon)
                yy, n = s[-1 - horizon:-1], int(s[-1])
                beta = np.linalg.solve(a + reg, b)
                sse = yy - 2 * (beta * b).sum(0) + (beta * (a @ beta)).sum(0)
                off = np.abs((a + reg) @ beta - b).max() / max(1.0, np.abs(b).max())
                rows.append((n, beta.T.tolist(), np.sqrt(np.maximum(sse, 0) / max(n - 1, 1)).tolist(), np.concatenate([a.ravel(), b.ravel()]).tolist(), off))
            out = pd.DataFrame(rows, columns=["n", "betas", "resid_sd", "gram", "residual"])
            yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)[schema.names]

    return sums.mapInPandas(solve, schema)


def apply_windows(rows: DataFrame, model: DataFrame, keys: list[str], ds: str, y: str) -> DataFrame:
    """Forecasts of every window: keys, ds (the anchor), horizon, yhat in the units of ``y``, and the truth where known."""
    j = rows.join(model.select(*keys, "betas"), keys)
    j = j.select(*keys, ds, f"{y}_m", f"{y}_w", "x", "target", F.posexplode("betas").alias("h", "beta"))
    z = F.aggregate(F.zip_with("beta", "x", lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    restored = lambda v: v * F.col(f"{y}_w") + F.col(f"{y}_m")
    return j.select(*keys, ds, (F.col("h") + 1).alias("horizon"), restored(z).alias("yhat"),
                    restored(F.get("target", F.col("h"))).alias("truth"))


def horizon_quantiles(forecasts: DataFrame, keys: list[str], probabilities: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """FC8: exact quantiles of the residuals per series and horizon: keys, horizon, q."""
    e = forecasts.filter("truth IS NOT NULL").withColumn("e", F.col("truth") - F.col("yhat"))
    return exact_quantiles(e, "e", probabilities, [*keys, "horizon"])
