"""Exact quantiles by selection against numpy."""
import random

import numpy as np
import pytest

from freightline.operators.quantiles import exact_quantiles, order_statistics


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_groups_match_numpy(spark, bins, monkeypatch):
    from freightline.operators import quantiles
    monkeypatch.setattr(quantiles.order_statistics, "__defaults__", (bins,))
    rng = random.Random(bins)
    data = {"ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(301)], "one": [4.25], "same": [3.0] * 50,
            "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(200)], "even": [float(i) for i in range(100)],
            "huge": [-1.7e308, 1.7e308, 0.0, 1.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("none", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.k: r.q for r in exact_quantiles(df, "v", p, ["k"]).collect()}
    assert set(got) == set(data)
    for k in set(data) - {"huge"}:
        assert got[k] == pytest.approx(list(np.quantile(np.array(data[k]), p)), rel=1e-12)
    assert got["huge"][0] == -1.7e308 and got["huge"][3] == 0.5 and got["huge"][-1] == 1.7e308


def test_without_groups_and_without_rows(spark):
    df = spark.range(10_001).selectExpr("CAST(id AS DOUBLE) * id AS v")
    assert exact_quantiles(df, "v", [0.5]).collect()[0].q == [25_000_000.0]
    assert exact_quantiles(df.limit(0), "v", [0.5]).collect() == []


def test_ranks_of_a_skewed_column(spark):
    """A third of all rows share one value, a few are far out."""
    df = spark.range(3000).selectExpr("0 AS g", "CASE WHEN id % 3 = 0 THEN 5.0 WHEN id = 1 THEN 1e12 ELSE id END AS v")
    values = sorted(5.0 if i % 3 == 0 else 1e12 if i == 1 else float(i) for i in range(3000))
    wanted = spark.createDataFrame([(0, r) for r in (0, 1, 2, 500, 1001, 1500, 2998, 2999)], "g int, rank long")
    got = {r["rank"]: r["value"] for r in order_statistics(df, wanted, ["g"]).collect()}
    assert got == {r: values[r] for r in got} and len(got) == 8
