"""Graph search on edge tables of any size: shortest paths, betweenness, bridges.

Searches of the whole graph go by :mod:`~freightline.plans.contraction`.  Bounded ones (by cost or targets)
go by rounds: state is kept in small written tables, and a round expands only its frontier.  All sources
and groups (vehicle profiles) run together.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightline.plans import contraction as ct
from freightline.session import discard, stored

#: Rows of paths below which they are walked by pointer doubling alone.
WALKED = 200_000
#: Label tables are merged into one beyond this number.
MERGE = 8


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def cheapest_edges(edges: DataFrame, weight: str, groups: Sequence[str] = (), undirected: bool = False) -> DataFrame:
    """(groups, src, dst, w): of parallel edges the cheapest; both directions if ``undirected``."""
    e = edges.select(*groups, "src", "dst", F.col(weight).alias("w"))
    if undirected:
        e = e.unionByName(e.select(*groups, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return e.groupBy(*groups, "src", "dst").agg(F.min("w").alias("w"))


def shortest_path_labels(edges: DataFrame, sources: DataFrame, weight: str, groups: Sequence[str] = (),
                         undirected: bool = False, max_cost: float | None = None, targets: DataFrame | None = None,
                         bucket: float | None = None) -> DataFrame:
    """(groups, source, node, cost, pred) for every node within reach of each (groups, source).

    Without bounds the graph is contracted to a core (:mod:`~freightline.plans.contraction`).  With them, or where
    weights are zero or vanish beside the sum of all, by bucketed frontier: a round expands the open labels whose cost lies within ``bucket`` (default: eight
    times the mean weight) of the lowest open one, so few are expanded before they are final.  A label names its
    predecessor (null at the source), no path.  ``max_cost`` bounds the search.  With ``targets`` (groups,
    source, node) the search ends when each is settled or out of reach; then labels above the last settled
    cost may be missing.  Weights must not be negative."""
    g = list(groups)
    e = stored(cheapest_edges(edges, weight, g, undirected), "sp-edges")
    low, mean, whole = e.agg(F.min("w"), F.avg("w"), F.sum("w")).first()
    if low is not None and low < 0:
        raise ValueError("negative weights")
    node_type = e.schema["dst"].dataType
    sources = sources.select(*g, F.col("source").cast(node_type).alias("source")).distinct()
    if targets is None and max_cost is None and bucket is None and (low is None or low > 1e-13 * whole):
        c, tables = _contracted(e, sources, g, False)
        discard(*c.owned, e)
        return _union(tables).drop("paths")
    out = _labels_by_rounds(e.withColumn("last", F.col("src")), sources, g, 8 * float(mean or 1.0) if bucket is None else bucket, max_cost, targets)
    discard(e)
    return out


def _contracted(e: DataFrame, sources: DataFrame, g: Sequence[str], trace: bool) -> tuple[ct.Contracted, list[DataFrame]]:
    """The contracted graph of ``e`` (groups, src, dst, w) and its tables of labels."""
    node_type = e.schema["dst"].dataType
    sources = stored(sources.select(*g, F.col("source").cast(node_type).alias("source")).distinct(), "sp-sources")
    c = ct.contract(e, sources.withColumnRenamed("source", "node"), g, trace)
    if c.size <= ct.CORE:
        first = stored(ct.core_labels(c, sources, g, node_type), "sp-core")
    else:
        mean = c.core.agg(F.avg("w")).first()[0]
        first = _labels_by_rounds(c.core, sources, g, 8 * float(mean)).withColumn("paths", F.lit(None).cast("double"))
        if trace:
            first = _counted(first, _tight(c, first, g), g)
    tables = ct.expand(c, first, g, trace)
    discard(sources)
    return c, tables


def _labels_by_rounds(e: DataFrame, sources: DataFrame, g: Sequence[str], bucket: float, max_cost: float | None = None,
                      targets: DataFrame | None = None) -> DataFrame:
    """Labels over ``e`` (groups, src, dst, w, last) by bucketed frontier; ``last`` becomes the predecessor."""
    g, key = list(g), [*g, "source", "node"]
    node_type = e.schema["dst"].dataType
    e = e.select(*g, "src", "dst", "w", "last")
    start = sources.select(*g, "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(node_type).alias("pred"))
    labels = [stored(start, "sp-labels")]
    opened, owned = labels[0], [*labels]
    if targets is not None:  # read every round: whatever they are made of runs once
        targets = stored(targets.select(*key).distinct(), "sp-targets")
    while (lowest := opened.agg(F.min("cost")).first()[0]) is not None:
        if targets is not None:
            known = _union(labels).filter(F.col("cost") <= lowest)
            if targets.join(known, key, "left_anti").isEmpty():
                break
        near = opened.filter(F.col("cost") < lowest + bucket)
        far = opened.filter(F.col("cost") >= lowest + bucket)
        steps = near.join(e.withColumnRenamed("src", "node"), [*g, "node"])
        steps = steps.select(*g, "source", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"),
                             F.col("last").alias("pred"))
        if max_cost is not None:
            steps = steps.filter(F.col("cost") <= max_cost)
        steps = steps.groupBy(*key).agg(F.min(F.struct("cost", "pred")).alias("b")).select(*key, "b.*")
        old = _union(labels).select(*key, F.col("cost").alias("held"))
        same = [steps[c].eqNullSafe(old[c]) for c in key]
        better = steps.join(old, reduce(lambda x, y: x & y, same) & (old["held"] <= steps["cost"]), "left_anti")
        # a far label that has been improved stays open and, when its turn comes, improves nothing
        opened = stored(far.withColumn("fresh", F.lit(False)).unionByName(better.withColumn("fresh", F.lit(True))), "sp-labels")
        owned.append(opened)
        labels.append(opened.filter("fresh").drop("fresh"))
        opened = opened.drop("fresh")
        if len(labels) > MERGE:
            merged = stored(_best(labels, key), "sp-labels")
            discard(*owned[:-1])
            labels, owned = [merged], [merged, owned[-1]]
    out = stored(_best(labels, key), "sp-paths")
    discard(*owned, *([targets] if targets is not None else []))
    return out


def _best(labels: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    return _union(labels).groupBy(*key).agg(F.min(F.struct("cost", "pred")).alias("b")).select(*key, "b.*")


def path_steps(labels: DataFrame, groups: Sequence[str] = (), targets: DataFrame | None = None,
               weights: DataFrame | None = None) -> DataFrame:
    """(groups, source, node, pos, step): the nodes of the path to each label, or to each of ``targets``
    (groups, source, node); pos 0 is the source.  Pointer doubling: after k rounds every path holds its last
    2^k nodes, and every label points 2^k nodes back, so rounds grow with the logarithm of the longest path.

    With ``weights`` (groups, src, dst, w) every path is walked the same way from predecessor to predecessor, but
    folded as it is walked, not listed: the labels with ``start``, the node it starts at, and ``total``, the sum of
    its steps' weights."""
    key = [*groups, "source", "node"]
    if weights is not None:
        walked = _walked(labels, weights, list(groups))
        return walked if targets is None else walked.join(targets.select(*key), key, "left_semi")
    asked = labels.select(*key) if targets is None else labels.select(*key).join(targets.select(*key), key, "left_semi")
    rows = stored(asked.select(*key, F.col("node").alias("step"), F.lit(0).alias("back")), "path")
    jump = stored(labels.filter("pred IS NOT NULL").select(*groups, "source", F.col("node").alias("step"), F.col("pred").alias("to")), "path-jump")
    tables, length = [rows], 1
    while True:
        more = _union(tables).join(jump, [*groups, "source", "step"])
        more = stored(more.select(*key, F.col("to").alias("step"), (F.col("back") + length).alias("back")), "path")
        if more.isEmpty():
            break
        tables.append(more)
        on = jump.select(*groups, "source", F.col("step").alias("to"), F.col("to").alias("on"))
        further = stored(jump.join(on, [*groups, "source", "to"]).select(*groups, "source", "step", F.col("on").alias("to")), "path-jump")
        discard(jump)
        jump, length = further, 2 * length
    discard(jump, more)
    rows = _union(tables)
    hops = rows.groupBy(*key).agg(F.max("back").alias("hops"))
    return rows.join(hops, key).select(*key, (F.col("hops") - F.col("back")).alias("pos"), "step")


def _walked(labels: DataFrame, weights: DataFrame, g: Sequence[str]) -> DataFrame:
    """Labels with ``start`` and ``total`` of their paths.  Nodes that no path goes on from are set aside, round by
    round, while that leaves much fewer; the rest is walked by pointer doubling, and each node set aside takes
    over its predecessor's sums.  Rows moved are in proportion to the labels on trees of paths."""
    key = [*g, "source", "node"]
    w = weights.select(*g, F.col("src").alias("pred"), F.col("dst").alias("node"), F.col("w").alias("step"))
    now = labels.join(w, [*g, "pred", "node"], "left").select(*labels.columns, F.when(F.isnull("pred"), 0.0).otherwise(F.col("step")).alias("step"))
    now = stored(now, "walk")
    aside, size = [], now.count()
    while size > WALKED:
        above = now.filter("pred IS NOT NULL").select(*g, "source", F.col("pred").alias("node")).distinct()
        marked = stored(now.join(above.withColumn("above", F.lit(True)), key, "left"), "walk")
        rest = marked.filter("above").drop("above")
        left = rest.count()
        if left > 0.8 * size:
            discard(marked)
            break
        aside.append(marked.filter("above IS NULL").drop("above"))
        now, size = rest, left
    none = F.lit(None).cast(labels.schema["node"].dataType)
    state = stored(now.select(*key, F.col("pred").alias("up"), F.when(F.isnull("pred"), F.col("node")).otherwise(none).alias("start"),
                              F.col("step").alias("total")), "walk-up")
    while not state.filter("up IS NOT NULL").isEmpty():
        on = state.select(*g, "source", F.col("node").alias("up"), F.col("up").alias("further"), F.col("start").alias("reached"),
                          F.col("total").alias("more"))
        nxt = stored(state.join(on, [*g, "source", "up"], "left").select(
            *key, F.col("further").alias("up"), F.coalesce("start", "reached").alias("start"),
            (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")), "walk-up")
        discard(state)
        state = nxt
    tables = [stored(now.join(state.drop("up"), key).drop("step"), "walked")]
    for leaves in reversed(aside):
        known = _union(tables).select(*g, "source", F.col("node").alias("pred"), "start", "total")
        tables.append(stored(leaves.join(known, [*g, "source", "pred"], "left").select(
            *labels.columns, F.when(F.isnull("pred"), F.col("node")).otherwise(F.col("start")).alias("start"),
            F.when(F.isnull("pred"), 0.0).otherwise(F.col("step") + F.col("total")).alias("total")), "walked"))
    return _union(tables)


def path_arrays(labels: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, source, node, cost, path): labels with the node ids of their paths, source first."""
    key = [*groups, "source", "node"]
    steps = path_steps(labels, groups).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("s"))
    return labels.join(steps, key).select(*key, "cost", F.col("s.step").alias("path"))


def _flow(first: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> list[DataFrame]:
    """``first``, step(first), step(step(first)) ... until empty, each written."""
    out = [stored(first, name)]
    while not (more := stored(step(out[-1]), name)).isEmpty():
        out.append(more)
    discard(more)
    return out


def pivot_nodes(nodes: DataFrame, pivots: int, seed: int = 17) -> DataFrame:
    """(source): ``pivots`` nodes drawn by a seeded hash; the sample is the feature."""
    return nodes.select(F.col("node_id").alias("source")).orderBy(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("source").cast("string"))), "source").limit(pivots)


def betweenness(edges: DataFrame, nodes: DataFrame, weight: str, groups: Sequence[str] = (), pivots: int | None = None,
                seed: int = 17) -> DataFrame:
    """(groups, node_id, betweenness) of nodes that lie between others: over all sources and targets, the share of
    the shortest paths from source to target that pass the node.  Tied paths count fractionally.

    Dependency accumulation per source.  With the tight edges u -> v (cost(u) + w = cost(v)): path counts p
    flow forward from the source; then 1 / p flows backward from every node, and what arrives at v, times
    p(v), is v's dependency.  The graph is contracted first, and the flows over edges that stand for ways through
    removed nodes are shared out to these (:mod:`~freightline.plans.contraction`).  ``pivots``
    takes that many sources, drawn by a seeded hash, and scales by n / pivots.  Weights must be positive."""
    g = list(groups)
    sources, scale = nodes.select(F.col("node_id").alias("source")), 1.0
    if pivots is not None:
        n = nodes.count()
        sources, scale = pivot_nodes(nodes, pivots, seed), n / max(1, min(pivots, n))
    e = stored(cheapest_edges(edges, weight, g), "bc-edges")
    if not e.filter("w <= 0").isEmpty():
        raise ValueError("weights must be positive")
    if g:
        ends = e.select(*g, F.col("src").alias("source")).unionByName(e.select(*g, F.col("dst").alias("source")))
        sources = ends.distinct().join(sources, "source")  # a node without edges in a group is on no path there
    c, tables = _contracted(e, sources, g, True)
    by_tasks = lambda labels: ct.core_flows(c, labels, g, e.schema["dst"].dataType)
    by_rounds = lambda labels: _flows(labels, _tight(c, labels, g), g)
    out = ct.flow_through(c, tables, g, by_tasks if c.size <= ct.CORE else by_rounds)
    discard(*c.owned, *(t for t in tables if hasattr(t, "stored_path")), e)
    return out.select(*g, F.col("node").alias("node_id"), (F.col("f") * scale).alias("betweenness"))


def _tight(c: ct.Contracted, labels: DataFrame, g: Sequence[str]) -> DataFrame:
    """(groups, source, u, v, n): the edges of a core on shortest paths."""
    at = lambda end: labels.select(*g, "source", F.col("node").alias(end), F.col("cost").alias(f"cost_{end}"))
    tight = c.core.withColumnsRenamed({"src": "u", "dst": "v"}).join(at("u"), [*g, "u"]).join(at("v"), [*g, "source", "v"])
    slack = F.abs(F.col("cost_u") + F.col("w") - F.col("cost_v"))
    return stored(tight.filter(slack <= ct.tolerance(F.col("cost_v"))).select(*g, "source", "u", "v", "n"), "bc-tight")


def _counted(labels: DataFrame, tight: DataFrame, g: Sequence[str]) -> DataFrame:
    """Labels with ``paths``: the counts flow forward from the source."""
    key = [*g, "source", "node"]

    def forward(x: DataFrame) -> DataFrame:
        x = x.withColumnRenamed("node", "u").join(tight, [*g, "source", "u"])
        return x.groupBy(*g, "source", F.col("v").alias("node")).agg(F.sum(F.col("x") * F.col("n")).alias("x"))

    waves = _flow(labels.filter("pred IS NULL").select(*key, F.lit(1.0).alias("x")), forward, "bc-paths")
    out = stored(labels.drop("paths").join(_union(waves).groupBy(*key).agg(F.sum("x").alias("paths")), key), "bc-paths")
    discard(*waves, tight)
    return out


def _flows(labels: DataFrame, tight: DataFrame, g: Sequence[str]) -> DataFrame:
    """As :func:`~freightline.plans.contraction.core_flows`, by rounds."""
    key = [*g, "source", "node"]

    def backward(x: DataFrame) -> DataFrame:
        x = x.withColumnRenamed("node", "v").join(tight, [*g, "source", "v"])
        return x.groupBy(*g, "source", F.col("u").alias("node")).agg(F.sum(F.col("x") * F.col("n")).alias("x"))

    inner = labels.filter(~F.col("node").eqNullSafe(F.col("source")))
    waves = _flow(inner.select(*key, (1 / F.col("paths") + F.coalesce("got", F.lit(0.0))).alias("x")), backward, "bc-flow")
    below = inner.filter("got IS NOT NULL").select(*key, F.col("got").alias("x"))
    below = _union([below, *waves[1:]]).groupBy(*key).agg(F.sum("x").alias("x"))
    nodes = below.join(inner.select(*key, "paths"), key).select(
        *g, F.lit(None).cast(labels.schema["node"].dataType).alias("src"), F.col("node").alias("dst"), (F.col("x") * F.col("paths")).alias("f"))
    arrived = _union(waves).groupBy(*g, "source", F.col("node").alias("v")).agg(F.sum("x").alias("x"))
    over = tight.join(arrived, [*g, "source", "v"]).join(labels.select(*g, "source", F.col("node").alias("u"), "paths"), [*g, "source", "u"])
    over = over.select(*g, F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("paths") * F.col("n") * F.col("x")).alias("f"))
    out = stored(nodes.unionByName(over), "bc-core")
    discard(*waves, tight)
    return out


def spanning_forest(edges: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Breadth-first levels from ``roots`` (node), all together: tables (node, parent), the roots with parent
    null.  ``edges`` (src, dst) hold both directions.  A level only meets the two before it, which hold all
    known neighbours of its nodes.  After 4, 8, 16 ... levels the edges into nodes reached by then are left out."""
    pruned, left = 0, None
    levels = [stored(roots.select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent")), "forest")]
    while True:
        last = levels[-1]
        reached = last.join(edges, last["node"] == edges["src"]).groupBy(F.col("dst")).agg(F.min("src").alias("parent"))
        known = _union(levels[-2:]).select(F.col("node").alias("dst"))
        level = stored(reached.join(known, "dst", "left_anti").withColumnRenamed("dst", "node"), "forest")
        if level.isEmpty():
            discard(level, *([] if left is None else [left]))
            return levels
        levels.append(level)
        if len(levels) >= max(4, 2 * pruned):
            seen = _union(levels[pruned:]).select(F.col("node").alias("dst"))
            fewer = stored(edges.join(seen, "dst", "left_anti").select("src", "dst"), "forest-edges")
            if left is not None:
                discard(left)
            pruned, left, edges = len(levels), fewer, fewer


def subtree_sums(forest: DataFrame, own: DataFrame) -> DataFrame:
    """(node, parent, total): the exclusive or of ``own`` (node, own; 0 where absent) over a node and all below
    it in a ``forest`` (node, parent).  Pointer doubling: after k rounds ``total`` covers the 2^k nearest levels
    and ``up`` points 2^k levels up, so rounds grow with the logarithm of the depth."""
    zero = F.lit(0).cast("long")
    now = stored(forest.join(own, "node", "left").select("node", "parent", F.col("parent").alias("up"), F.coalesce("own", zero).alias("total")), "br-sums")
    while not (open_ := now.filter("up IS NOT NULL")).isEmpty():
        more = open_.groupBy(F.col("up").alias("node")).agg(F.bit_xor("total").alias("more"))
        on = open_.select(F.col("node").alias("up"), F.col("up").alias("on"))
        nxt = now.join(on, "up", "left").join(more, "node", "left").select(
            "node", "parent", F.col("on").alias("up"), F.col("total").bitwiseXOR(F.coalesce("more", zero)).alias("total"))
        nxt = stored(nxt, "br-sums")
        discard(now)
        now = nxt
    return now


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: the distinct undirected edges, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def bridges(edges: DataFrame, components: DataFrame, seed: int = 5) -> DataFrame:
    """(a, b, component) with a < b: the undirected edges whose removal parts a component (node_id, component;
    a component is named by one of its nodes).  Parallel edges count as one.

    Every edge outside a spanning forest draws a 64-bit label, and both its ends take it.  Summed by
    exclusive or over the subtree below a tree edge, the labels of all edges that leave the subtree remain:
    none, that is 0, for a bridge.  Another tree edge sums to 0 with probability 2^-64."""
    pairs = stored(undirected_pairs(edges), "br-edges")
    both = stored(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "br-edges")
    named = components.select(F.col("node_id").alias("node"), "component")
    levels = spanning_forest(both, named.filter(F.col("node") == F.col("component")).select("node"))
    tree = _union(levels[1:]).select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")) if len(levels) > 1 \
        else pairs.filter("false")
    loose = pairs.join(tree, ["a", "b"], "left_anti").withColumn("label", F.xxhash64("a", "b", F.lit(seed)))
    ends = loose.select(F.col("a").alias("node"), "label").unionByName(loose.select(F.col("b").alias("node"), "label"))
    own = stored(ends.groupBy("node").agg(F.bit_xor("label").alias("own")), "br-labels")
    if len(levels) == 1:
        return pairs.filter("false").join(named, pairs["a"] == named["node"]).select("a", "b", "component")
    sums = subtree_sums(_union(levels), own)
    cut = sums.filter("parent IS NOT NULL AND total = 0").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    out = stored(cut.join(named, cut["a"] == named["node"]).select("a", "b", "component"), "bridges")
    discard(pairs, both, own, *levels, sums)
    return out
