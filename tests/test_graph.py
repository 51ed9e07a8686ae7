"""Graph search against plain Python: paths with predecessors, betweenness with ties, bridges."""
import heapq
import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from freightline.plans import graph
from freightline.plans import network as nw


def random_graph(seed, n=30, m=60, weights=(1, 2, 3)):
    rng = random.Random(seed)
    edges = {(u, v) for u, v in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if u != v}
    edges |= {(v, u) for u, v in edges}
    w = {}
    for u, v in sorted(edges):
        w[u, v] = w.get((v, u)) or float(rng.choice(weights))
    return w


def dijkstra(w, s):
    adj = defaultdict(list)
    for (u, v), c in w.items():
        adj[u].append((v, c))
    dist, heap = {}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, c in adj[u]:
            heapq.heappush(heap, (d + c, v))
    return dist


def counts_of_paths(w, dist, s):
    sigma = defaultdict(float, {s: 1.0})
    for v in sorted(dist, key=dist.get):
        if v != s:
            sigma[v] = sum(sigma[u] for (u, x), c in w.items() if x == v and u in dist and dist[u] + c == dist[v])
    return sigma


def brute_betweenness(w, nodes, sources=None):
    dist = {s: dijkstra(w, s) for s in nodes}
    sigma = {s: counts_of_paths(w, dist[s], s) for s in nodes}
    out = defaultdict(float)
    for s in sources or nodes:
        for t in dist[s]:
            for v in dist[s]:
                if v not in (s, t) and t != s and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    out[v] += sigma[s][v] * sigma[v][t] / sigma[s][t]
    return {v: x for v, x in out.items() if x}


def edge_df(spark, w):
    return spark.createDataFrame([(u, v, c) for (u, v), c in w.items()], "src long, dst long, w double")


@pytest.mark.parametrize("bucket", [None, 0.5, 100.0])
def test_labels_and_paths(spark, bucket):
    w = random_graph(1)
    sources = spark.createDataFrame([(0,), (5,), (999,)], "source long")
    labels = graph.shortest_path_labels(edge_df(spark, w), sources, "w", bucket=bucket)
    got = {(r.source, r.node): r.cost for r in labels.collect()}
    want = {(s, v): d for s in (0, 5) for v, d in dijkstra(w, s).items()} | {(999, 999): 0.0}
    assert got == want
    paths = {(r.source, r.node): (r.cost, r.path) for r in graph.path_arrays(labels).collect()}
    assert paths.keys() == want.keys()
    for (s, v), (cost, path) in paths.items():
        assert path[0] == s and path[-1] == v and sum(w[x] for x in zip(path, path[1:])) == cost


def test_search_ends_when_targets_are_settled(spark):
    line = {(i, i + 1): 1.0 for i in range(40)}
    sources = spark.createDataFrame([(0,)], "source long")
    targets = spark.createDataFrame([(0, 3)], "source long, node long")
    labels = graph.shortest_path_labels(edge_df(spark, line), sources, "w", targets=targets, bucket=1.0)
    got = {r.node: r.cost for r in labels.collect()}
    assert got[3] == 3.0 and max(got) < 10
    steps = graph.path_steps(labels, targets=targets).orderBy("pos").collect()
    assert [r.step for r in steps] == [0, 1, 2, 3]


def test_max_cost_and_negative_weights(spark):
    line = {(i, i + 1): 1.0 for i in range(10)}
    sources = spark.createDataFrame([(0,)], "source long")
    assert graph.shortest_path_labels(edge_df(spark, line), sources, "w", max_cost=4.0).count() == 5
    with pytest.raises(ValueError):
        graph.shortest_path_labels(edge_df(spark, {(0, 1): -1.0}), sources, "w")


@pytest.mark.parametrize("seed", [2, 3])
def test_betweenness_shares_tied_paths(spark, seed):
    w = random_graph(seed, 16, 24, (1, 2))
    nodes = sorted({x for e in w for x in e})
    table = spark.createDataFrame([(n,) for n in nodes], "node_id long")
    got = {r.node_id: r.betweenness for r in graph.betweenness(edge_df(spark, w), table, "w").collect()}
    want = brute_betweenness(w, nodes)
    assert {v for v, x in got.items() if x > 1e-9} == set(want)
    assert all(got[v] == pytest.approx(x) for v, x in want.items())


def test_pivots_estimate_the_exact_values(spark):
    """The error against the exact run falls with the number of pivots and is nil with all nodes."""
    w = random_graph(4, 40, 70)
    nodes = sorted({x for e in w for x in e})
    table = spark.createDataFrame([(n,) for n in nodes], "node_id long")
    want = brute_betweenness(w, nodes)
    error = {}
    for k in (4, 16, len(nodes)):
        got = {r.node_id: r.betweenness for r in graph.betweenness(edge_df(spark, w), table, "w", pivots=k).collect()}
        error[k] = sum(abs(got.get(v, 0) - want.get(v, 0)) for v in nodes) / sum(want.values())
        pivots = [r.source for r in graph.pivot_nodes(table, k).collect()]
        scaled = {v: x * len(nodes) / k for v, x in brute_betweenness(w, nodes, pivots).items()}
        assert all(got.get(v, 0) == pytest.approx(x) for v, x in scaled.items())
    assert error[len(nodes)] < 1e-9 < error[16] < error[4] < 1.5


def brute_bridges(pairs):
    def parts(edges):
        root = {x: x for e in pairs for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        return len({find(x) for x in root})
    whole = parts(pairs)
    return {e for e in pairs if parts(pairs - {e}) > whole}


@pytest.mark.parametrize("seed,n,m", [(5, 40, 38), (6, 30, 45), (7, 60, 50), (8, 3, 2)])
def test_bridges(spark, seed, n, m):
    rng = random.Random(seed)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    edges = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in pairs for _ in range(rng.choice((1, 2)))]
                                  + [(0, 0)], "src long, dst long")
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    out = graph.bridges(edges, nw.connected_components(nodes, edges)).collect()
    assert {(r.a, r.b) for r in out} == brute_bridges(pairs) and len(out) == len({(r.a, r.b) for r in out})


def test_graph_without_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long, w double")
    nodes = spark.range(3).withColumnRenamed("id", "node_id")
    assert graph.bridges(edges, nodes.withColumn("component", F.col("node_id"))).count() == 0
    assert graph.betweenness(edges, nodes, "w").count() == 0
    assert graph.shortest_path_labels(edges, nodes.withColumnRenamed("node_id", "source"), "w").count() == 3


def test_targets_are_made_once(spark, tmp_path):
    """What the targets are made of runs once, not in every round."""
    line = {(i, i + 1): 1.0 for i in range(12)}

    def told(batches):  # a file per run: an accumulator misses tasks that a limit ends early
        for pdf in batches:
            (tmp_path / uuid.uuid4().hex).touch()
            yield pdf

    targets = spark.createDataFrame([(0, 9)], "source long, node long").mapInPandas(told, "source long, node long")
    sources = spark.createDataFrame([(0,)], "source long")
    labels = graph.shortest_path_labels(edge_df(spark, line), sources, "w", targets=targets, bucket=1.0)
    assert labels.filter("node = 9").first().cost == 9.0
    assert len(list(tmp_path.iterdir())) == 1


def test_shipment_lines_are_joined_once(spark, sf_small, monkeypatch):
    from freightline.catalog import network
    read = []
    monkeypatch.setattr(network, "stored", lambda df, name: read.append(name) or graph.stored(df, name))
    out = network.q_gn4(spark, sf_small)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert read == ["od-pairs"] and "l_orderkey" not in plan


def test_bridges_of_a_deep_graph(spark, monkeypatch):
    """A long chain with loops: the sums below its edges take rounds like the logarithm of its depth, and the
    tables of the forest meet fewer edges the further it has grown."""
    pairs = {(i, i + 1) for i in range(40)} | {(8, 11), (20, 24), (39, 37)} | {(50, 51), (51, 52), (50, 52)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {99})], "node_id long")
    written, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or stored(df, name))
    out = graph.bridges(edges, nw.connected_components(nodes, edges)).collect()
    assert {(r.a, r.b) for r in out} == brute_bridges(pairs)
    assert written.count("br-sums") <= 8 and written.count("forest-edges") >= 3


#: Bounds of the core (edges in memory, edges of a removed node): contracted and searched in memory; contracted as far
#: as chains go, the rest by rounds; by rounds alone.
CORES = [(8, 6), (0, 3), (0, 2)]


def bounded_core(monkeypatch, core, most):
    from freightline.plans import contraction as ct
    monkeypatch.setattr(ct, "CORE", core)
    monkeypatch.setattr(ct, "MOST", most)
    monkeypatch.setattr(graph, "WALKED", 5)


@pytest.mark.parametrize("core,most", CORES)
def test_contracted_labels_and_walked_paths(spark, monkeypatch, core, most):
    """Two groups of edges, one with ways of one direction and a part out of reach; every path is walked to its start."""
    bounded_core(monkeypatch, core, most)
    one, two = random_graph(11, 40, 50), random_graph(12, 60, 75)
    two = {e: c for i, (e, c) in enumerate(two.items()) if i % 9}
    rows = [(g, u, v, c) for g, w in (("a", one), ("b", two)) for (u, v), c in w.items()] + [("a", 3, 3, 1.0), ("b", 5, 5, 1.0)]
    edges = spark.createDataFrame(rows, "g string, src long, dst long, w double")
    sources = spark.createDataFrame([(g, s) for g in "ab" for s in (0, 5, 999)], "g string, source long")
    labels = graph.shortest_path_labels(edges, sources, "w", ["g"])
    got = {(r.g, r.source, r.node): (r.cost, r.pred) for r in labels.collect()}
    want = {(g, s, v): d for g, w in (("a", one), ("b", two)) for s in (0, 5) for v, d in dijkstra(w, s).items()}
    want |= {(g, 999, 999): 0.0 for g in "ab"}
    assert {k: c for k, (c, _) in got.items()} == want and labels.count() == len(want)
    for (g, s, v), (cost, pred) in got.items():
        assert pred is None if v == s else got[g, s, pred][0] + {"a": one, "b": two}[g][pred, v] == cost
    walked = graph.path_steps(labels, ["g"], weights=graph.cheapest_edges(edges, "w", ["g"])).collect()
    assert {(r.g, r.source, r.node): (r.total, r.start) for r in walked} == {k: (c, k[1]) for k, c in want.items()}


@pytest.mark.parametrize("core,most", CORES)
def test_contracted_betweenness_shares_tied_paths(spark, monkeypatch, core, most):
    bounded_core(monkeypatch, core, most)
    w = random_graph(13, 40, 55, (1, 2))
    nodes = sorted({x for e in w for x in e})
    table = spark.createDataFrame([(n,) for n in nodes], "node_id long")
    got = {r.node_id: r.betweenness for r in graph.betweenness(edge_df(spark, w), table, "w", pivots=3).collect()}
    pivots = [r.source for r in graph.pivot_nodes(table, 3).collect()]
    want = {v: x * len(nodes) / 3 for v, x in brute_betweenness(w, nodes, pivots).items()}
    assert {v for v, x in got.items() if x > 1e-9} == set(want)
    assert all(got[v] == pytest.approx(x) for v, x in want.items())


def test_rounds_of_a_deep_graph_are_few(spark, monkeypatch):
    """A chain of 120 nodes: rounds follow the logarithm of its length, not the length."""
    from freightline.plans import contraction as ct
    bounded_core(monkeypatch, 16, 6)
    written, stored = [], graph.stored
    for module in (graph, ct):
        monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or stored(df, name))
    n = 120
    w = {(a, b): 1.0 for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))}
    table = spark.range(n).withColumnRenamed("id", "node_id")
    got = {r.node_id: r.betweenness for r in graph.betweenness(edge_df(spark, w), table, "w", pivots=2).collect()}
    pivots = [r.source for r in graph.pivot_nodes(table, 2).collect()]
    assert got == pytest.approx({v: x * n / 2 for v, x in brute_betweenness(w, range(n), pivots).items()})
    assert len(written) < 100
