"""Distance clusters against all pairs, at the antimeridian, the poles and in dense neighbouring cells."""
import math
import random

import pytest

from freightline.plans import clusters


def brute(points, eps):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))
    for i, a in enumerate(points):
        for j in range(i):
            if km(a, points[j]) <= eps:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {points[i][0]: points[find(i)][0] for i in range(len(points))}


def check(spark, points, eps, **options):
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    rows = clusters.eps_clusters(df, "id", "lat", "lon", eps, **options).collect()
    assert len(rows) == len(points) and {r.id: r.cluster for r in rows} == brute(points, eps)


@pytest.mark.parametrize("a,b,eps", [((0.01, 179.65), (0.01, -179.64), 100), ((89.95, 0.0), (89.95, 90.0), 20), ((-89.99, 10.0), (-89.99, -170.0), 5),
                                     ((90.0, 0.0), (89.9, 123.0), 12), ((60.0, 179.99), (60.05, -179.99), 7), ((0.0, 0.0), (0.0, 180.0), 21_000)])
def test_links_at_the_seams(spark, a, b, eps):
    check(spark, [(1, *a), (2, *b)], eps)


@pytest.mark.parametrize("center,spread,eps", [((0, 180), 3, 60), ((89.5, 0), 0.6, 15), ((-89.9, 40), 0.3, 6), ((45, -179.9), 2, 40), ((0, 0), 80, 900)])
def test_random_points(spark, center, spread, eps):
    rng = random.Random(repr((center, eps)))
    points = []
    for i in range(220):
        lat = max(-90.0, min(90.0, center[0] + rng.uniform(-spread, spread)))
        width = spread / max(0.02, math.cos(math.radians(lat)))
        lon = (center[1] + rng.uniform(-width, width) + 180) % 360 - 180
        points.append((i, lat, lon))
    check(spark, points, eps)
    check(spark, points, eps, direct=1)


def test_dense_neighbouring_cells_are_divided(spark):
    """Two clouds of 600 points each a little under, and a little over, eps apart: the same clusters whether
    parts are tested directly or divided down to single points."""
    rng = random.Random(8)
    for gap in (0.448, 0.452):  # 49.8 and 50.3 km between the facing edges
        points = [(i, rng.uniform(0, 0.2), rng.uniform(-0.2, 0)) for i in range(600)]
        points += [(600 + i, rng.uniform(0, 0.2), gap + rng.uniform(0, 0.2)) for i in range(600)]
        points += [(2000, 0.1, 0.0), (2001, 0.1, gap)] + [(3000 + i, 0.1, 0.0) for i in range(50)]
        check(spark, points, 50.0, direct=16)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0)], "id long, lat double, lon double")
    assert [tuple(r) for r in clusters.eps_clusters(df, "id", "lat", "lon", 10.0).collect()] == [(2, 2)]
    assert clusters.eps_clusters(df.limit(0), "id", "lat", "lon", 10.0).count() == 0
