"""Window models against a direct least-squares fit of every horizon."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightline.plans import windowmodel as wm

K = ["series_id"]


def test_all_horizons_match_a_direct_solve(spark):
    rng = np.random.default_rng(7)
    first = dt.date(2022, 3, 1)
    rows = [(s, first + dt.timedelta(days=d), float(50 + 9 * np.sin(d / 7 * 2 * np.pi) + rng.normal()), None if d % 9 == 0 else float(5 + rng.normal()))
            for s, n in (("a", 90), ("b", 70), ("short", 8)) for d in range(n)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double, price double")
    w = wm.windows(df, K, "ds", "y", ["price"], 10, 3, 4)
    k = 5 + 10 + 3
    full = w.filter(F.size("target") == 4)
    model = {r.series_id: r for r in wm.fit_windows(full, K, k, 4).collect()}
    assert set(model) == {"a", "b"}
    for s, m in model.items():
        got = full.filter(F.col("series_id") == s).orderBy("ds").collect()
        x, v = np.array([r.x for r in got]), np.array([r.target for r in got])
        assert m.n == len(got) and x.shape[1] == k
        beta = np.linalg.solve(x.T @ x + np.diag([1e-9, *[1.0] * (k - 1)]), x.T @ v)
        assert np.allclose(np.array(m.betas).T, beta, atol=1e-7) and m.residual < 1e-9
        assert np.allclose(m.resid_sd, np.sqrt(((v - x @ beta) ** 2).sum(0) / (m.n - 1)), rtol=1e-6)
        ys = [r[2] for r in rows if r[0] == s]
        q1, q2, q3 = np.quantile(ys, [0.25, 0.5, 0.75])
        assert got[0].x[5:15] == pytest.approx([(t - q2) / (q3 - q1) for t in ys[:10]])
    out = wm.apply_windows(w, wm.fit_windows(full, K, k, 4), K, "ds", "y")
    row = out.filter("series_id = 'a' AND horizon = 2").orderBy("ds").first()
    r = full.filter("series_id = 'a'").orderBy("ds").first()
    q1, q2, q3 = np.quantile([x[2] for x in rows if x[0] == "a"], [0.25, 0.5, 0.75])
    assert row.yhat == pytest.approx(float(np.dot(model["a"].betas[1], r.x)) * (q3 - q1) + q2)
    assert row.truth == pytest.approx([x[2] for x in rows if x[0] == "a"][11])
    q = {(x.series_id, x.horizon): x.q for x in wm.horizon_quantiles(out, K, [0.5]).collect()}
    e = [x.truth - x.yhat for x in out.filter("series_id = 'b' AND horizon = 3 AND truth IS NOT NULL").collect()]
    assert q["b", 3][0] == pytest.approx(float(np.median(e)))
