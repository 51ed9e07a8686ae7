"""Property tests: operators against brute force / pandas / numpy on small inputs."""
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightline.functions.geo import geohash, haversine_km
from freightline.operators import joins as jn
from freightline.operators import windows as wn
from freightline.plans import network as nw


def _hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def _points(n, seed, spread=3.0):
    rnd = random.Random(seed)
    centres = [(rnd.uniform(-60, 60), rnd.uniform(-179, 179)) for _ in range(6)] + [(10.0, 179.8)]
    out = []
    for i in range(n):
        c = centres[i % len(centres)]
        out.append((i, c[0] + rnd.uniform(-spread, spread) / 10, ((c[1] + rnd.uniform(-spread, spread) / 10 + 180) % 360) - 180))
    return out


def test_haversine_symmetry_and_triangle(spark):
    pts = _points(12, 1, 200)
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    a = df.select(F.col("id").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = df.select(F.col("id").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    d = {(r.a, r.b): r.d for r in a.join(b, how="cross").select("a", "b", haversine_km("alat", "alon", "blat", "blon").alias("d")).collect()}
    for (i, j), v in d.items():
        assert v == pytest.approx(d[(j, i)], abs=1e-9)
        assert v == pytest.approx(_hav(pts[i][1:], pts[j][1:]), rel=1e-9, abs=1e-9)
        for k in range(12):
            assert d[(i, j)] <= d[(i, k)] + d[(k, j)] + 1e-6


def _union_find_clusters(pts, eps):
    parent = list(range(len(pts)))

    def f(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(pts)):
        for j in range(i + 1, len(pts)):
            if _hav(pts[i][1:], pts[j][1:]) <= eps:
                parent[f(i)] = f(j)
    groups = {}
    for i in range(len(pts)):
        groups.setdefault(f(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_eps_clusters_match_union_find(spark):
    pts = _points(160, 7)
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {r.id: r.cluster for r in nw.eps_clusters(df, "id", "lat", "lon", 20.0).collect()}
    assert got == _union_find_clusters(pts, 20.0)


def test_nearest_neighbor_matches_brute_force(spark):
    q = _points(60, 3, 50)
    c = _points(25, 4, 80)
    qd = spark.createDataFrame(q, "qid int, lat double, lon double")
    cd = spark.createDataFrame(c, "cid int, lat double, lon double")
    got = {r.qid: (r.cid, r.distance) for r in jn.nearest_neighbor(qd, cd, "qid", "lat", "lon", "cid", "lat", "lon").collect()}
    for i, la, lo in q:
        best = min(((_hav((la, lo), (cla, clo)), cid) for cid, cla, clo in c))
        assert got[i][0] == best[1]
        assert got[i][1] == pytest.approx(best[0], abs=1e-6)


def test_nearest_neighbor_at_poles_and_antimeridian(spark):
    rnd = random.Random(12)
    q = [(0, 89.95, 10.0), (1, -89.99, 0.0), (2, 0.0, 180.0), (3, 10.0, -180.0)]
    q += [(4 + i, rnd.uniform(80, 90) * rnd.choice([-1, 1]), rnd.uniform(-180, 180)) for i in range(30)]
    q += [(40 + i, rnd.uniform(-60, 60), rnd.choice([-1, 1]) * rnd.uniform(177, 180)) for i in range(30)]
    c = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(200)]
    qd = spark.createDataFrame(q, "qid int, lat double, lon double")
    cd = spark.createDataFrame(c, "cid int, lat double, lon double")
    for cell in (None, 7.0):
        got = {r.qid: r.cid for r in jn.nearest_neighbor(qd, cd, "qid", "lat", "lon", "cid", "lat", "lon", start_cell_deg=cell).collect()}
        assert got == {i: min((_hav((la, lo), x[1:]), x[0]) for x in c)[1] for i, la, lo in q}


def test_radius_join_matches_brute_force(spark):
    p = _points(200, 5, 30)
    c = _points(7, 6, 1)
    pd_ = spark.createDataFrame(p, "pid int, lat double, lon double")
    cd = spark.createDataFrame(c, "cid int, clat double, clon double")
    got = {(r.pid, r.cid) for r in jn.radius_join(pd_, cd, "lat", "lon", "clat", "clon", 250.0).collect()}
    want = {(i, j) for i, la, lo in p for j, cla, clo in c if _hav((la, lo), (cla, clo)) <= 250.0}
    assert got == want


@pytest.mark.parametrize("where", ["antimeridian", "north pole", "south pole", "anywhere"])
@pytest.mark.parametrize("km", [100.0, 300.0, 2500.0])
def test_radius_join_wraps_and_reaches_the_poles(spark, where, km):
    rnd = random.Random(9)
    lat = {"antimeridian": (-3, 3), "north pole": (85, 90), "south pole": (-90, -85), "anywhere": (-90, 90)}[where]
    lon = lambda: rnd.choice((-1, 1)) * rnd.uniform(178, 180) if where == "antimeridian" else rnd.uniform(-180, 180)
    p = [(i, rnd.uniform(*lat), lon()) for i in range(150)]
    c = [(i, rnd.uniform(*lat), lon()) for i in range(20)] + [(98, 89.9, 0.0), (99, 0.0, 180.0)]
    got = jn.radius_join(spark.createDataFrame(p, "pid int, lat double, lon double"),
                         spark.createDataFrame(c, "cid int, clat double, clon double"), "lat", "lon", "clat", "clon", km)
    got = sorted((r.pid, r.cid) for r in got.collect())
    assert got == sorted((i, j) for i, la, lo in p for j, cla, clo in c if _hav((la, lo), (cla, clo)) <= km)


def test_asof_join_matches_pandas(spark):
    rnd = random.Random(11)
    left = pd.DataFrame({"k": [rnd.randint(0, 4) for _ in range(300)],
                         "t": pd.to_datetime("2024-01-01") + pd.to_timedelta([rnd.randint(0, 40 * 86400) for _ in range(300)], unit="s"),
                         "lid": range(300)})
    right = pd.DataFrame({"k": [rnd.randint(0, 4) for _ in range(120)],
                          "rt": pd.to_datetime("2024-01-01") + pd.to_timedelta([rnd.randint(0, 40 * 86400) for _ in range(120)], unit="s"),
                          "v": [float(i) for i in range(120)]})
    right = right.drop_duplicates(["k", "rt"])
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("rt"), left_on="t", right_on="rt", by="k",
                         tolerance=pd.Timedelta("3D"), direction="backward")
    ls = spark.createDataFrame(left).withColumn("t", F.col("t").cast("timestamp_ntz"))
    rs = spark.createDataFrame(right).withColumn("rt", F.col("rt").cast("timestamp_ntz"))
    got = jn.asof_join(ls, rs, ["k"], "t", "rt", 3 * 86400, ["v"]).toPandas().set_index("lid")["v"]
    w = want.set_index("lid")["v"]
    for lid in range(300):
        a, b = got.loc[lid], w.loc[lid]
        assert (pd.isna(a) and pd.isna(b)) or a == b, lid


def test_time_interpolation_matches_pandas(spark):
    rnd = random.Random(3)
    ts = sorted(pd.to_datetime("2024-01-01") + pd.to_timedelta(rnd.sample(range(0, 10**6), 200), unit="s"))
    vals = [rnd.random() * 100 if rnd.random() < 0.6 else None for _ in ts]
    vals[0] = None
    vals[-1] = None
    pdf = pd.DataFrame({"k": 1, "ts": ts, "y": vals})
    want = pdf.set_index("ts")["y"].astype(float).interpolate(method="time", limit_direction="both").to_numpy()
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = wn.time_interpolate(df, ["k"], "ts", "y").orderBy("ts").toPandas()["y"].to_numpy()
    assert np.allclose(got, want, atol=1e-9)


def _dijkstra(n, edges, src):
    import heapq
    dist = {src: 0.0}
    pq = [(0.0, src)]
    while pq:
        d, u = heapq.heappop(pq)
        if d > dist.get(u, math.inf):
            continue
        for a, b, w in edges:
            if a == u and d + w < dist.get(b, math.inf):
                dist[b] = d + w
                heapq.heappush(pq, (d + w, b))
    return dist


def test_shortest_paths_match_dijkstra(spark):
    rnd = random.Random(9)
    n = 30
    edges = list({(i, rnd.randrange(n), round(rnd.uniform(1, 10), 3)) for i in range(n) for _ in range(3)})
    edges = [(a, b, w) for a, b, w in edges if a != b]
    ed = spark.createDataFrame(edges, "src long, dst long, w double")
    srcs = spark.createDataFrame([(s,) for s in range(0, n, 7)], "source long")
    got = {(r.source, r.node): r.cost for r in nw.shortest_paths(ed, srcs, "w").collect()}
    for s in range(0, n, 7):
        want = _dijkstra(n, edges, s)
        assert {k[1] for k in got if k[0] == s} == set(want)
        for node, d in want.items():
            assert got[(s, node)] == pytest.approx(d, abs=1e-9)


def _py_geohash(lat, lon, precision):
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"
    lat_r, lon_r = [-90.0, 90.0], [-180.0, 180.0]
    bits, out, even, ch, bit = [16, 8, 4, 2, 1], [], True, 0, 0
    while len(out) < precision:
        rng, v = (lon_r, lon) if even else (lat_r, lat)
        mid = (rng[0] + rng[1]) / 2
        if v >= mid:
            ch |= bits[bit]
            rng[0] = mid
        else:
            rng[1] = mid
        even = not even
        bit += 1
        if bit == 5:
            out.append(alphabet[ch])
            bit, ch = 0, 0
    return "".join(out)


def test_geohash_matches_bisection(spark):
    pts = _points(50, 2, 500)
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    for r in df.select("id", "lat", "lon", geohash("lat", "lon", 9).alias("g")).collect():
        assert r.g == _py_geohash(r.lat, r.lon, 9)


def test_geometric_medians_match_numpy(spark):
    rnd = random.Random(4)
    pts = [(k, rnd.gauss(k, 1.0), rnd.gauss(-k, 2.0)) for k in range(3) for _ in range(40)] + [(3, 5.0, 6.0)]
    df = spark.createDataFrame(pts, "cluster int, lat double, lon double")
    got = {r.cluster: (r.lat, r.lon, r.n_points) for r in nw.geometric_medians(df, "cluster").collect()}
    for k in range(4):
        at = np.array([p[1:] for p in pts if p[0] == k])
        median = at.mean(0)
        for _ in range(100):
            weight = 1 / np.maximum(np.hypot(*(at - median).T), 1e-5)
            step = (weight[:, None] * at).sum(0) / weight.sum()
            if np.hypot(*(step - median)) < 1e-5:
                break
            median = step
        assert got[k][:2] == pytest.approx(tuple(median), abs=1e-9) and got[k][2] == len(at)


def test_minmax_scaler_roundtrip(spark):
    from freightline.plans import scaling as sc
    df = spark.createDataFrame([(float(i * 3 + 1),) for i in range(20)], "x double")
    p = sc.fit_minmax(df, ["x"])
    s = sc.apply_minmax(df, p, "x", "x_mm")
    back = sc.apply_minmax(s.select(F.col("x_mm").alias("x"), F.col("x").alias("orig")), p, "x", "x_back", inverse=True)
    for r in back.collect():
        assert r.x_back == pytest.approx(r.orig)


def test_distributed_running_sum_equals_cumsum(spark):
    from freightline.operators.aggregates import distributed_running_sum
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "k int, v double")
    got = {r.k: r.v_before for r in distributed_running_sum(df, "k", ["v"], 5).collect()}
    acc = 0.0
    for i in range(500):
        assert got[i] == pytest.approx(acc)
        acc += i % 7


def test_roc_auc_matches_rank_formula(spark):
    from freightline.operators.aggregates import roc_auc
    rnd = random.Random(8)
    rows = [(float(rnd.randint(0, 20)), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = roc_auc(df, "s", "y").first().auc
    s = pd.Series([r[0] for r in rows]).rank()
    y = np.array([r[1] for r in rows])
    p, n = y.sum(), len(y) - y.sum()
    want = (s[y == 1].sum() - p * (p + 1) / 2) / (p * n)
    assert got == pytest.approx(want)


def _dijkstra_paths(edges, src):
    import heapq
    dist, prev = {src: 0.0}, {src: None}
    pq = [(0.0, src)]
    while pq:
        d, u = heapq.heappop(pq)
        if d > dist[u]:
            continue
        for a, b, w in edges:
            if a == u and d + w < dist.get(b, math.inf):
                dist[b], prev[b] = d + w, u
                heapq.heappush(pq, (d + w, b))
    return prev


def test_betweenness_matches_path_counts(spark):
    rnd = random.Random(21)
    n = 15
    edges = [(i, j, rnd.uniform(1, 10)) for i in range(n) for j in {rnd.randrange(n) for _ in range(3)} if i != j]
    want = {}
    for s in range(n):
        prev = _dijkstra_paths(edges, s)
        for t in prev:
            v = prev[t]
            while v is not None and v != s:
                want[v] = want.get(v, 0) + 1
                v = prev[v]
    ed = spark.createDataFrame(edges, "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    got = {r.node_id: r.betweenness for r in nw.betweenness(ed, nodes, "w").collect()}
    assert got == {k: float(v) for k, v in want.items()}
    sampled = nw.betweenness(ed, nodes, "w", pivots=5).collect()
    assert all(r.betweenness > 0 for r in sampled)


def test_convex_hulls_merge_over_blocks(spark):
    """Hulls of 3,000 points from blocks of 100 equal those from one block; a circle of corners ends too."""
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, 500, endpoint=False)
    rows = [("a", float(x), float(y)) for x, y in rng.normal(size=(3000, 2))] + [("b", float(np.cos(t)), float(np.sin(t))) for t in angle]
    df = spark.createDataFrame(rows, "key string, lat double, lon double")
    one = {r.key: json.loads(r.polygon)["coordinates"][0] for r in nw.convex_hulls(df, ["key"]).collect()}
    many = {r.key: json.loads(r.polygon)["coordinates"][0] for r in nw.convex_hulls(df, ["key"], block=100).collect()}
    assert one == many


def test_convex_hulls_contain_all_points(spark):
    import json
    rnd = random.Random(5)
    pts = [(k, rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for k in range(3) for _ in range(40)]
    df = spark.createDataFrame(pts, "key int, lat double, lon double")
    hulls = {r.key: json.loads(r.polygon)["coordinates"][0] for r in nw.convex_hulls(df, ["key"]).collect()}
    for k, ring in hulls.items():
        ring = ring[:-1]
        assert len(ring) >= 3
        for _, la, lo in [p for p in pts if p[0] == k]:
            # every point lies on the inner side of every counter-clockwise edge
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                assert (x2 - x1) * (la - y1) - (y2 - y1) * (lo - x1) >= -1e-9
        # every hull vertex is an input point
        inputs = {(lo, la) for kk, la, lo in pts if kk == k}
        assert all((x, y) in inputs for x, y in ring)


def _two_scales(spark):
    days = pd.date_range("2022-01-01", periods=400, freq="D").date
    wave = 50 + 20 * np.sin(np.arange(400) * 2 * math.pi / 7)
    return spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": name, "ds": days, "y": wave * scale})
                                            for name, scale in (("small", 1.0), ("large", 1000.0))]))


def test_logistic_ceiling_follows_each_series(spark):
    from freightline.plans import forecast as fc
    spec = fc.supply_chain_spec()
    p = fc.predict(fc.fit_forecaster(_two_scales(spark), ["series_id"], spec=spec), ["series_id"], periods=14, spec=spec).toPandas()
    by = {k: g.sort_values("ds")["yhat"].to_numpy() for k, g in p.groupby("series_id")}
    assert by["large"].max() > 60_000
    np.testing.assert_allclose(by["large"] / 1000, by["small"], rtol=0.02)


def test_candidates_on_one_gram_equal_separate_fits(spark):
    from freightline.plans import forecast as fc
    d = _two_scales(spark)
    spec = fc.supply_chain_spec(growth="linear")
    priors = {"a": (0.01, 0.5, 1.0), "b": (0.5, 0.1, 0.2)}
    m = fc.fit_forecaster(d, ["series_id"], spec=spec, priors=priors)
    got = fc.predict(m, ["series_id"], periods=7, spec=spec).toPandas()
    for name, (c, s, h) in priors.items():
        one = fc.supply_chain_spec(growth="linear", changepoint_prior=c, seasonality_prior=s, holidays_prior=h)
        want = fc.predict(fc.fit_forecaster(d, ["series_id"], spec=one), ["series_id"], periods=7, spec=one).toPandas()
        j = got[got.candidate == name].merge(want, on=["series_id", "ds"])
        assert len(j) == 14
        np.testing.assert_allclose(j.yhat_x, j.yhat_y, rtol=1e-6)


def test_clearance_as_of_a_day(spark):
    from freightline.plans.ledger import customs_cleared
    a = spark.sql("SELECT * FROM VALUES (1, 'A', TIMESTAMP'2024-01-01'), (1, 'B', TIMESTAMP'2024-01-03'), (2, 'A', TIMESTAMP'2024-01-01'), "
                  "(2, 'A', TIMESTAMP'2024-01-02') t(id, agency, ts)")
    cleared = lambda day: {r.id: (r.cleared, r.repeated_rejected) for r in customs_cleared(a, "id", "agency", "ts", day).collect()}
    assert cleared(None) == {1: (True, 0), 2: (False, 1)}
    assert cleared("2024-01-03") == {1: (False, 0), 2: (False, 1)}


def test_restricted_edges_are_counted_when_kept(spark):
    nodes = spark.createDataFrame([(i, 0.0, float(i), 0.0) for i in range(3)], "node_id long, lat double, lon double, elevation double")
    edges = spark.createDataFrame([(0, 1, 1.0, "primary", 50.0, 1.0, 99.0, False), (1, 2, 1.0, "primary", 50.0, 9.0, 99.0, False)],
                                  "src long, dst long, length_km double, highway string, speed_kph double, maxheight double, "
                                  "maxweight double, hazmat_prohibited boolean")
    prepared = nw.prepare_edges(edges, nodes)
    assert nw.constrained_edges(prepared).filter("src = 0").isEmpty()
    e = nw.constrained_edges(prepared, keep_restricted=True).filter("profile = 'van'")
    start = spark.createDataFrame([("van", 0)], "profile string, source long")
    sp = nw.shortest_paths(e, start, "length", groups=["profile"])
    got = {r.node: r.num_restrictions for r in nw.route_metrics(sp, e, ["profile"]).collect()}
    assert got == {1: 1, 2: 1}


def test_tombstones_end_a_history(spark):
    from freightline.plans import ledger as lg
    rows = [("a", 1, 1, "CREATED"), ("a", 2, 2, "DISPATCHED"), ("a", 5, 6, "CREATED"), ("b", 1, 3, "CREATED"), ("c", 1, 4, "CREATED"),
            ("c", 1, 5, "DISPATCHED"), ("d", 3, 9, "CREATED")]
    events = spark.createDataFrame(rows, "shipment_id string, ts int, seq int, status string")
    deletes = spark.createDataFrame([("a", 3, 7), ("a", 2, 8), ("b", 4, 10), ("c", 1, 4), ("x", 1, 11)], "shipment_id string, ts int, seq int")
    live = lg.live_events(events, lg.last_tombstones(deletes)).collect()
    assert sorted((r.shipment_id, r.seq, r.recreated) for r in live) == [("a", 6, True), ("c", 5, True), ("d", 9, False)]
    once = lg.compacted(events, deletes)
    kept, marks = once.filter("NOT tombstone").drop("tombstone"), once.filter("tombstone").select("shipment_id", "ts", "seq")
    assert sorted((r.shipment_id, r.seq) for r in marks.collect()) == [("a", 7), ("b", 10), ("c", 4), ("x", 11)]
    late = spark.createDataFrame([("b", 2, 12, "DISPATCHED")], kept.schema.simpleString()[7:-1].replace(":", " "))
    twice = lg.compacted(kept.unionByName(late), marks)
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
