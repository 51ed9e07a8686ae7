"""Cross-validation by prefix sums against a fit per copied history."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightline.operators import aggregates as ag
from freightline.plans import crossval as cv
from freightline.plans import forecast as fc

K = ["series_id"]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(6)
    first = dt.date(2020, 1, 1)
    rows = [(k, first + dt.timedelta(days=int(d)), float(20 + 0.05 * d + 6 * np.sin(d / 7 * 2 * np.pi) + rng.normal() + 5 * (k == "b")))
            for k, n in (("a", 560), ("b", 480), ("short", 100)) for d in range(n) if k != "b" or d % 11]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def by_copies(df, spec, priors=None, horizon=30, initial=365, period=30):
    c = fc.cutoffs(df, K, "ds", initial, period, horizon)
    hist = df.join(c, K).filter(F.col("ds") <= F.col("cutoff"))
    truth = df.join(c, K).filter((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.date_add("cutoff", horizon)))
    m = fc.fit_forecaster(hist, K + ["cutoff"], spec=spec, priors=priors)
    p = fc.predict(m, K + ["cutoff"], future=truth.select(*K, "cutoff", "ds"), spec=spec)
    return p.join(truth, K + ["cutoff", "ds"])


def rows(df, *names):
    return {tuple(r[n] for n in names): (r.y, r.yhat, r.yhat_lower, r.yhat_upper) for r in df.collect()}


@pytest.mark.parametrize("spec", [fc.supply_chain_spec(), fc.supply_chain_spec(growth="linear"), fc.ForecastSpec(n_changepoints=3)],
                         ids=["logistic", "multiplicative", "linear"])
def test_same_forecasts_as_a_fit_per_cutoff(series, spec):
    got = rows(cv.cross_validate(series, K, spec=spec), "series_id", "cutoff", "ds")
    want = rows(by_copies(series, spec), "series_id", "cutoff", "ds")
    assert got.keys() == want.keys() and {k[0] for k in got} == {"a", "b"}
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-5, abs=1e-5)


def test_candidates_share_the_sums(series):
    spec = fc.supply_chain_spec(growth="linear")
    priors = {"low": (0.01, 0.1, 0.1), "high": (0.5, 10.0, 10.0)}
    got = rows(cv.cross_validate(series, K, spec=spec, priors=priors), "candidate", "series_id", "cutoff", "ds")
    want = rows(by_copies(series, spec, priors), "candidate", "series_id", "cutoff", "ds")
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-5, abs=1e-5) for k in want)


def test_search_names_a_winner_with_its_full_error(series):
    spec = fc.ForecastSpec(growth="linear", n_changepoints=3)
    candidates = {f"c{i:02d}": ("additive", (0.02 * (i + 1), 0.5 * (i + 1), 1.0)) for i in range(12)}
    got = {r.series_id: r for r in cv.search(series, K, candidates, spec=spec).collect()}
    every = cv.cross_validate(series, K, spec=spec, priors={n: p for n, (_, p) in candidates.items()})
    rmse = {(r.series_id, r.candidate): r.rmse for r in ag.forecast_accuracy(every, K + ["candidate"]).collect()}
    assert set(got) == {"a", "b"}
    for k, r in got.items():
        assert r.best_rmse == pytest.approx(rmse[k, r.best_candidate])
        assert r.best_rmse <= sorted(rmse[k, n] for n in candidates)[3]  # among the best four of twelve
        assert r.n_fits < 12 * len({x for x in every.filter(F.col("series_id") == k).select("cutoff").distinct().collect()}) or k == "b"


def test_empty_table(series):
    assert cv.cross_validate(series.limit(0), K).count() == 0
    assert cv.search(series.limit(0), K, {"a": ("additive", (1, 1, 1))}).count() == 0
