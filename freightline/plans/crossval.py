"""Rolling-origin cross-validation and hyper-parameter search without a copy of the history per cutoff.

The Gram matrix of a history that ends at a cutoff is a difference of prefix sums.  Per series the products
z z' of the features that do not depend on the cutoff (1, day, seasons, holidays, regressors) are summed
over the blocks of days between cutoffs and knots, once.  The trend is the day divided by the history's
span; a hinge at a knot is (day - knot) / span beyond it; so every cell of a cutoff's Gram matrix follows
from two prefix sums.  Candidates share them: a prior only enters the solve.

A task holds one series at a time, that is, one row per calendar day; series are spread over all tasks.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forecast import ForecastSpec, _feature_columns, _penalties, _with_holidays, spread


class Rolling:
    """One series: days since its first, base features (1, day, others) and values, in order of days."""

    def __init__(self, day: np.ndarray, z: np.ndarray, y: np.ndarray, spec: ForecastSpec, horizon: int, initial: int, period: int):
        self.day, self.z, self.y, self.spec, self.horizon = day, z, y, spec, horizon
        self.cutoffs = list(range(initial, int(day[-1]) - horizon + 1, period)) if len(day) else []
        self.ends = {c: int(np.searchsorted(day, c, "right")) for c in self.cutoffs}
        self.spans = {c: max(int(day[self.ends[c] - 1]), 1) for c in self.cutoffs}
        share = [spec.changepoint_range * (k + 1) / (spec.n_changepoints + 1) for k in range(spec.n_changepoints)]
        self.knots = {c: [f * self.spans[c] for f in share] for c in self.cutoffs}
        bounds = sorted({0, *self.ends.values(), *(self.after(k) for ks in self.knots.values() for k in ks)})
        self.prefix = {0: np.zeros((z.shape[1],) * 2)}
        for a, b in zip(bounds, bounds[1:]):
            self.prefix[b] = self.prefix[a] + z[a:b].T @ z[a:b]

    def after(self, knot: float) -> int:
        return int(np.searchsorted(self.day, knot, "right"))

    def gram(self, c: int) -> np.ndarray:
        """X'X of the history up to cutoff ``c``: 1, trend, hinges, others."""
        span, total, n = self.spans[c], self.prefix[self.ends[c]], len(self.knots[c])
        size = self.z.shape[1] + n
        at = [0, 1, *range(2 + n, size)]  # places of 1, day and the others
        out = np.zeros((size, size))
        out[np.ix_(at, at)] = total
        out[1] /= span
        out[:, 1] /= span
        for k, knot in enumerate(self.knots[c]):
            beyond = total - self.prefix[self.after(knot)]
            row = (beyond[1] - knot * beyond[0]) / span
            row[1] /= span
            out[2 + k, at] = out[at, 2 + k] = row
            for j, lower in enumerate(self.knots[c][:k + 1]):
                both = (beyond[1, 1] - (lower + knot) * beyond[0, 1] + lower * knot * beyond[0, 0]) / span**2
                out[2 + k, 2 + j] = out[2 + j, 2 + k] = both
        return out

    def features(self, c: int, a: int, b: int) -> np.ndarray:
        """The features of rows ``a`` to ``b`` as the model of cutoff ``c`` sees them."""
        t = self.day[a:b] / self.spans[c]
        hinges = [np.maximum(0.0, t - k / self.spans[c]) for k in self.knots[c]]
        return np.column_stack([np.ones(b - a), t, *hinges, self.z[a:b, 2:]])

    def cap(self, c: int) -> float | None:
        if self.spec.growth != "logistic":
            return None
        top = self.spec.cap if self.spec.cap is not None else self.y[:self.ends[c]].max() * self.spec.cap_headroom
        return max(float(top), self.spec.floor + 1.0)

    def transformed(self, y: np.ndarray, cap: float | None, mode: str) -> np.ndarray:
        if cap is not None:
            p = np.clip((y - self.spec.floor) / (cap - self.spec.floor), 1e-6, 1 - 1e-6)
            return np.log(p / (1 - p))
        return np.log1p(np.maximum(y, 0.0)) if mode == "multiplicative" else y

    def restored(self, v: np.ndarray, cap: float | None, mode: str) -> np.ndarray:
        if cap is not None:
            return self.spec.floor + (cap - self.spec.floor) / (1 + np.exp(-v))
        return np.expm1(v) if mode == "multiplicative" else v

    def right_side(self, c: int, v: np.ndarray) -> np.ndarray:
        """X'v of the history up to ``c``."""
        e, span = self.ends[c], self.spans[c]
        base = self.z[:e].T @ v
        hinges = []
        for k in self.knots[c]:
            i = self.after(k)
            hinges.append(((self.day[i:e] - k) @ v[i:]) / span)
        return np.concatenate([[base[0], base[1] / span], hinges, base[2:]])

    def forecasts(self, c: int, candidates: dict[str, tuple[str, list[float]]]) -> Iterator[tuple[str, int, int, tuple]]:
        """Per candidate (name: seasonality mode, ridge of each feature) the rows of the horizon after ``c``:
        (name, first row, end row, (yhat, lower, upper))."""
        e, cap = self.ends[c], self.cap(c)
        b = int(np.searchsorted(self.day, c + self.horizon, "right"))
        gram, ahead = self.gram(c), self.features(c, e, b)
        width = NormalDist().inv_cdf((1.0 + self.spec.interval_width) / 2.0)
        sides = {}
        for name, (mode, ridge) in candidates.items():
            if mode not in sides:
                v = self.transformed(self.y[:e], cap, mode)
                sides[mode] = self.right_side(c, v), float(v @ v)
            side, vv = sides[mode]
            beta = np.linalg.solve(gram + np.diag(np.asarray(ridge) + 1e-9), side)
            sse = vv - 2 * beta @ side + beta @ gram @ beta
            sd = math.sqrt(max(sse, 0.0) / max(e - 1, 1))
            at = ahead @ beta
            yield name, e, b, tuple(self.restored(x, cap, mode) for x in (at, at - width * sd, at + width * sd))


def _base(df: DataFrame, keys: Sequence[str], ds: str, y: str, spec: ForecastSpec) -> tuple[DataFrame, list[str]]:
    """Rows (keys, _ds, _day, _z, _y) with the cutoff-free features, and the names of a model's features."""
    first = df.groupBy(*keys).agg(F.min(ds).alias("_t0"))
    d = _with_holidays(df.join(first, list(keys)), ds, spec)
    free = ForecastSpec(**{**spec.__dict__, "n_changepoints": 0})
    z = [c.cast("double") for _, c in _feature_columns(F.col(ds), F.col("_t0"), F.lit(1), free)]
    names = [n for n, _ in _feature_columns(F.col(ds), F.col("_t0"), F.lit(1), spec)]
    d = d.select(*keys, F.col(ds).alias("_ds"), F.datediff(ds, "_t0").cast("double").alias("_day"),
                 F.array(*z).alias("_z"), F.col(y).cast("double").alias("_y"))
    return spread(d, *keys), names


def _per_series(df: DataFrame, keys: list[str], fn, spec: ForecastSpec, horizon: int, initial: int, period: int,
                schema: T.StructType) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_day", kind="stable")
        series = Rolling(pdf["_day"].to_numpy(float), np.stack(pdf["_z"].to_numpy()).astype(float), pdf["_y"].to_numpy(float),
                         spec, horizon, initial, period)
        out = fn(series, pd.to_datetime(pdf["_ds"]).dt.date.to_numpy())
        out = pd.DataFrame(out, columns=[f.name for f in schema.fields if f.name not in keys])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[schema.names]

    return df.groupBy(*keys).applyInPandas(run, schema)


def _schema(df: DataFrame, keys: Sequence[str], spec: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name in keys), *T.StructType.fromDDL(spec).fields])


def cross_validate(df: DataFrame, keys: list[str], ds: str = "ds", y: str = "y", spec: ForecastSpec | None = None,
                   priors: dict[str, Sequence[float]] | None = None, horizon: int = 30, initial: int = 365,
                   period: int = 30) -> DataFrame:
    """Forecasts and truth of every series and cutoff: keys, cutoff, ds, y, yhat, yhat_lower, yhat_upper, and
    ``candidate`` with ``priors`` (name: change point, seasonality and holiday scales).  Cutoffs run from
    the first day + ``initial`` every ``period`` days to the last day - ``horizon``."""
    spec = spec or ForecastSpec()
    base, names = _base(df, keys, ds, y, spec)
    ridge = {n: (spec.seasonality_mode, _penalties(names, spec, p)) for n, p in (priors or {"": None}).items()}

    def run(series: Rolling, dates):
        for c in series.cutoffs:
            cutoff = dates[0] + pd.Timedelta(days=c)
            for name, a, b, bands in series.forecasts(c, ridge):
                yield from zip([name] * (b - a), [cutoff] * (b - a), dates[a:b], series.y[a:b], *bands)

    schema = _schema(df, keys, "candidate string, cutoff date, ds date, y double, yhat double, yhat_lower double, yhat_upper double")
    out = _per_series(base, keys, lambda *x: list(run(*x)), spec, horizon, initial, period, schema)
    return out if priors else out.drop("candidate")


def search(df: DataFrame, keys: list[str], candidates: dict[str, tuple[str, Sequence[float]]], ds: str = "ds", y: str = "y",
           spec: ForecastSpec | None = None, horizon: int = 30, initial: int = 365, period: int = 30, keep: float = 1 / 3,
           start: float = 1 / 8) -> DataFrame:
    """Guided search by successive halving, per series: all ``candidates`` (name: seasonality mode, prior
    scales) are judged on a share ``start`` of the cutoffs, evenly spaced; the best third goes on with twice
    as many, and so on; the survivors are judged on all cutoffs.  Ties go to the lower name.  Returns keys,
    best_candidate, best_rmse (over all cutoffs), n_fits."""
    spec = spec or ForecastSpec(growth="linear")
    base, names = _base(df, keys, ds, y, spec)
    ridge = {n: (mode, _penalties(names, spec, p)) for n, (mode, p) in candidates.items()}

    def run(series: Rolling, dates):
        if not series.cutoffs:
            return []
        left, share, errors, fits = sorted(ridge), start, {}, 0
        while True:
            wanted = max(1, round(len(series.cutoffs) * min(share, 1.0)))
            chosen = [series.cutoffs[i * len(series.cutoffs) // wanted] for i in range(wanted)]
            for c in chosen:
                open_ = {n: ridge[n] for n in left if (n, c) not in errors}  # what a survivor has done stays done
                for name, a, b, (yhat, _, _) in series.forecasts(c, open_):
                    errors[name, c] = float(((series.y[a:b] - yhat) ** 2).sum()), b - a
                    fits += 1
            score = {n: math.sqrt(sum(errors[n, c][0] for c in chosen) / max(1, sum(errors[n, c][1] for c in chosen))) for n in left}
            left = sorted(left, key=lambda n: (score[n], n))
            if share >= 1:
                return [(left[0], score[left[0]], fits)]
            left, share = left[:max(1, math.ceil(len(left) * keep))], 2 * share

    schema = _schema(df, keys, "best_candidate string, best_rmse double, n_fits long")
    return _per_series(base, keys, run, spec, horizon, initial, period, schema)


#: Cells of a Gram matrix that the check query shows, by feature names.
CELLS = (("intercept", "trend"), ("trend", "trend"), ("cp0", "cp0"), ("cp1", "cp3"), ("trend", "cp4"), ("intercept", "cp2"))


def gram_cells(df: DataFrame, keys: list[str], ds: str = "ds", y: str = "y", spec: ForecastSpec | None = None,
               horizon: int = 30, initial: int = 365, period: int = 30) -> DataFrame:
    """Per series and cutoff some cells of X'X and X'y, and the residual of the normal equations at the solution
    (largest entry, relative): keys, cutoff, the cells, rhs_trend, rhs_cp1, residual."""
    spec = spec or ForecastSpec()
    base, names = _base(df, keys, ds, y, spec)
    ridge = np.asarray(_penalties(names, spec)) + 1e-9
    at = {n: i for i, n in enumerate(names)}

    def run(series: Rolling, dates):
        out = []
        for c in series.cutoffs:
            gram = series.gram(c)
            v = series.transformed(series.y[:series.ends[c]], series.cap(c), spec.seasonality_mode)
            side = series.right_side(c, v)
            beta = np.linalg.solve(gram + np.diag(ridge), side)
            left = np.abs((gram + np.diag(ridge)) @ beta - side).max() / max(1.0, np.abs(side).max())
            out.append((dates[0] + pd.Timedelta(days=c), *(gram[at[a], at[b]] for a, b in CELLS), side[at["trend"]], side[at["cp1"]], left))
        return out

    cells = ", ".join(f"{a}_{b} double" for a, b in CELLS)
    return _per_series(base, keys, run, spec, horizon, initial, period, _schema(df, keys, f"cutoff date, {cells}, rhs_trend double, rhs_cp1 double, residual double"))
