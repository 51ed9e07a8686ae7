"""Shortest paths by node contraction: the graph is made small, searched, and grown again.

A round removes nodes of few edges, no two of them neighbours, and joins what lay around each by edges that
stand for the way through it (their lengths added, of parallel ones the shortest, ties counted).  Distances
between the nodes that stay do not change, and each round is a few joins over what is left.  The core, of
at most ``CORE`` edges, is searched in the memory of a task, a source at a time; then the removed nodes are
labelled in reverse order, each from the neighbours it had when it was removed, which all have labels by then.
For betweenness the flow of paths goes the same ways back.  A graph that resists (dense everywhere) keeps a
larger core; the caller searches that by rounds over tables.

Edges are (groups, src, dst, w, n, last): ``n`` ways of length ``w``, ``last`` the node before ``dst`` on one
of them.  Labels are (groups, source, node, cost, pred, paths).
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from freightline.session import discard, stored

#: Edges of a core that tasks hold in memory.
CORE = 100_000
#: Edges into, and out of, a removed node: at first, and at most when rounds with fewer remove little.
FEW, MOST = 3, 6
#: Costs are equal within this share of them (of 1 if less).
TIE = 1e-9


def union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def tolerance(cost):
    return TIE * F.greatest(F.lit(1.0), cost)


@dataclass
class Contracted:
    """The core, and per round (first removed first) the edges into the removed nodes (groups, node, u, w, n, last)
    and, if traced, the ways through them (groups, src, dst, via, part, kept): the shares of the ties of a
    new edge that go through ``via`` and over an edge that was there before."""
    core: DataFrame
    size: int
    into: list[DataFrame] = field(default_factory=list)
    through: list[DataFrame] = field(default_factory=list)
    owned: list[DataFrame] = field(default_factory=list)


def _tied(rows: DataFrame, key: Sequence[str], cost: str, ways: str, second: str) -> DataFrame:
    """Rows that tie for the least ``cost`` of their key, with ``low``, the sum ``total`` of their ``ways``, and ``rank`` 1 in one."""
    order = Window.partitionBy(*key).orderBy(cost, second)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("low", F.min(cost).over(whole)).filter(F.col(cost) <= F.col("low") + tolerance(F.col("low")))
    return rows.withColumns({"total": F.sum(ways).over(whole), "rank": F.row_number().over(order)})


def contract(edges: DataFrame, stay: DataFrame, g: Sequence[str], trace: bool) -> Contracted:
    """``edges`` (groups, src, dst, w), one a pair and direction; the nodes ``stay`` (groups, node) are never removed."""
    g, node, pair = list(g), [*g, "node"], [*g, "src", "dst"]
    e = edges.filter("src <> dst").select(*pair, "w", F.lit(1.0).alias("n"), F.col("src").alias("last"))
    e = stored(e, "ct-edges")
    out = Contracted(e, e.count(), owned=[e])
    few, stay = FEW, stay.select(*node).distinct()
    while out.size > CORE and few <= MOST:
        e = out.core
        ends = e.select(*g, F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("leaves")).unionByName(
            e.select(*g, F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0).alias("leaves")))
        able = ends.groupBy(*node).agg(F.sum("leaves").alias("outs"), F.count("*").alias("both"))
        able = able.filter(F.greatest("outs", F.col("both") - F.col("outs")) <= few).join(stay, node, "left_anti")
        # fewest edges first, then by chance; of two neighbours the lower goes
        turn = F.col("both") * (1 << 56) + F.shiftrightunsigned(F.xxhash64("node", F.lit(len(out.into))), 8)
        able = stored(able.select(*node, turn.cast("long").alias("turn")), "ct-able")
        rivals = ends.join(able, node).groupBy(*g, F.col("other").alias("node")).agg(F.min("turn").alias("before"))
        gone = stored(able.join(rivals, node, "left").filter("before IS NULL OR turn < before").select(*node), "ct-gone")
        mark = lambda end: gone.select(*g, F.col("node").alias(end), F.lit(True).alias(f"{end}_gone"))
        split = stored(e.join(mark("src"), [*g, "src"], "left").join(mark("dst"), [*g, "dst"], "left")
                       .select(*pair, "w", "n", "last", "src_gone", "dst_gone"), "ct-split")
        discard(able, gone)
        into = split.filter("dst_gone").select(*g, F.col("dst").alias("node"), F.col("src").alias("u"), "w", "n", "last")
        onward = split.filter("src_gone").select(*g, F.col("src").alias("node"), "dst", F.col("w").alias("w2"), F.col("n").alias("n2"),
                                                 F.col("last").alias("last2"))
        ways = into.join(onward, node).filter("u <> dst").select(
            *g, F.col("u").alias("src"), "dst", (F.col("w") + F.col("w2")).alias("w"), (F.col("n") * F.col("n2")).alias("n"),
            F.col("last2").alias("last"), F.col("node").alias("via"))
        rows = split.filter("src_gone IS NULL AND dst_gone IS NULL").select(*pair, "w", "n", "last")
        rows = rows.withColumn("via", F.lit(None).cast(ways.schema["via"].dataType)).unionByName(ways)
        if trace:
            rows = _tied(rows, pair, "w", "n", "last")
            old = F.sum(F.when(F.isnull("via"), F.col("n")).otherwise(0.0)).over(
                Window.partitionBy(*pair).orderBy("w", "last").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            table = stored(rows.withColumn("old", old), "ct-ties")
            nxt = table.filter("rank = 1").select(*pair, F.col("low").alias("w"), F.col("total").alias("n"), "last")
            out.through.append(table.filter("via IS NOT NULL").select(
                *pair, "via", (F.col("n") / F.col("total")).alias("part"), (F.col("old") / F.col("total")).alias("kept")))
        else:
            table = nxt = stored(rows.groupBy(*pair).agg(F.min("w").alias("w"), F.max("n").alias("n"), F.min_by("last", "w").alias("last")), "ct-edges")
        size = nxt.count()
        if size > 0.9 * out.size:
            few += 1
        out.into.append(into)
        out.owned += [split, table]
        out.core, out.size = nxt, size
    return out


# -- the core, in memory -----------------------------------------------------

def _core_rows(c: Contracted, g: Sequence[str]) -> list[tuple]:
    """(group, src, dst, w, n, last): at most ``CORE``."""
    return [(tuple(r[:len(g)]), *r[len(g):]) for r in c.core.select(*g, "src", "dst", "w", "n", "last").collect()]


def _search(onward: dict, source) -> dict:
    """Node -> [cost, pred, paths], in the order of costs."""
    found, heap, done = {source: [0.0, None, 1.0]}, [(0.0, 0, source)], {}
    ticket = 0
    while heap:
        _, _, u = heapq.heappop(heap)
        if u in done:
            continue
        cost, _, paths = done[u] = found[u]
        for v, w, n, last in onward.get(u, ()):
            if v in done:
                continue
            new, held = cost + w, found.get(v)
            tie = 0.0 if held is None else TIE * max(1.0, held[0])
            if held is None or new < held[0] - tie:
                found[v] = [new, last, paths * n]
            elif new <= held[0] + tie:
                held[2] += paths * n
                if new >= held[0]:
                    continue
                held[0], held[1] = new, last
            else:
                continue
            ticket += 1
            heapq.heappush(heap, (new, ticket, v))
    return done


def core_labels(c: Contracted, sources: DataFrame, g: Sequence[str], node_type: T.DataType) -> DataFrame:
    """Labels of the core from each (groups, source), found one source after the other in many tasks."""
    edges, k = _core_rows(c, g), len(g)
    schema = T.StructType([*(sources.schema[x] for x in g), *(T.StructField(x, node_type) for x in ("source", "node")),
                           T.StructField("cost", T.DoubleType()), T.StructField("pred", node_type), T.StructField("paths", T.DoubleType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches):
        onward: dict = {}
        for group, src, dst, w, n, last in edges:
            onward.setdefault(group, {}).setdefault(src, []).append((dst, w, n, last))
        for b in batches:
            for *group, source in zip(*(x.to_pylist() for x in b.columns)):
                found = _search(onward.get(tuple(group), {}), source)
                rows = [(*group, source, v, *label) for v, label in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    rows = sources.select(*g, F.col("source").cast(node_type).alias("source")).distinct()
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def core_flows(c: Contracted, labels: DataFrame, g: Sequence[str], node_type: T.DataType) -> DataFrame:
    """(groups, src, dst, f) of each source.  ``labels`` of the core come with ``got``, what flowed back to a node
    from nodes outside.  Rows with src: the flow of an edge; without: the flow through node dst."""
    edges = _core_rows(c, g)
    schema = T.StructType([*(labels.schema[x] for x in g), *(T.StructField(x, node_type) for x in ("src", "dst")), T.StructField("f", T.DoubleType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    into: dict = {}  # filled once a task

    def run(key, table):
        group, source = tuple(x.as_py() for x in key[:-1]), key[-1].as_py()
        if not into:
            for of, src, dst, w, n, _ in edges:
                into.setdefault(of, {}).setdefault(dst, []).append((src, w, n))
        back = into.get(group, {})
        columns = [table.column(x).to_pylist() for x in ("node", "cost", "paths", "got")]
        label = {v: (cost, paths) for v, cost, paths, _ in zip(*columns)}
        got = {v: x for v, _, _, x in zip(*columns) if x is not None}
        rows = []
        for v, (cost, paths) in sorted(label.items(), key=lambda x: -x[1][0]):
            if v == source:
                continue
            if v in got:
                rows.append((None, v, got[v] * paths))
            x = 1 / paths + got.get(v, 0.0)
            for u, w, n in back.get(v, ()):
                if u in label and abs(label[u][0] + w - cost) <= TIE * max(1.0, cost):
                    got[u] = got.get(u, 0.0) + n * x
                    rows.append((u, v, label[u][1] * n * x))
        columns = list(zip(*((*group, *r) for r in rows))) or [[] for _ in arrow]
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return labels.groupBy(*g, "source").applyInArrow(run, schema)


# -- labels of the removed nodes, and flows through them ----------------------

def expand(c: Contracted, first: DataFrame, g: Sequence[str], trace: bool) -> list[DataFrame]:
    """Tables of labels: of the core (``first``), then of the rounds from the last to the first.  If traced,
    with a row per tied edge into a node: (u, n, from_paths), ``rank`` 1 in one row a label."""
    g, key = list(g), [*g, "source", "node"]
    tables = [first]
    for into in reversed(c.into):
        held = [*g, "source", F.col("node").alias("u"), F.col("cost").alias("held"), F.col("paths").alias("from_paths")]
        known = union([t.filter("rank = 1").select(*held) if "rank" in t.columns else t.select(*held) for t in tables])
        steps = into.withColumnRenamed("last", "pred").join(known, [*g, "u"])
        steps = steps.select(*key, (F.col("held") + F.col("w")).alias("cost"), "pred", "u", "n", "from_paths",
                             (F.col("n") * F.col("from_paths")).alias("ways"))
        if trace:
            rows = _tied(steps, key, "cost", "ways", "pred")
            rows = rows.select(*key, F.col("low").alias("cost"), "pred", F.col("total").alias("paths"), "u", "n", "from_paths", "rank")
        else:
            rows = steps.groupBy(*key).agg(F.min("cost").alias("cost"), F.min_by("pred", "cost").alias("pred"), F.lit(None).cast("double").alias("paths"))
        tables.append(stored(rows, "ct-labels"))
    return tables


def flow_through(c: Contracted, tables: Sequence[DataFrame], g: Sequence[str],
                 flows_of_core: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(groups, node, f): the flow through every node between others, of all sources together, where a flow of 1 goes
    from each source to each node within reach, shared by tied paths.  ``tables`` as of :func:`expand`, traced."""
    g, key, pair = list(g), [*g, "source", "node"], [*g, "src", "dst"]
    pending = tables[0].filter("false").select(*key, F.lit(0.0).alias("got"))
    through, over, done = [], [], []
    for into in reversed(tables[1:]):  # the first round's nodes are the outermost
        met = stored(into.join(pending, key, "full"), "ct-met")
        here = met.filter("paths IS NOT NULL")
        x = F.col("n") * (1 / F.col("paths") + F.coalesce("got", F.lit(0.0)))
        sent = here.select(*g, "source", F.col("u").alias("node"), x.alias("got"))
        nxt = stored(met.filter("paths IS NULL").select(*key, "got").unionByName(sent).groupBy(*key).agg(F.sum("got").alias("got")), "ct-pending")
        through.append(here.filter("rank = 1 AND got IS NOT NULL").select(*g, "node", (F.col("got") * F.col("paths")).alias("f")))
        over.append(here.groupBy(*g, F.col("u").alias("src"), F.col("node").alias("dst")).agg(F.sum(F.col("from_paths") * x).alias("f")))
        done += [met, nxt]
        pending = nxt
    core = stored(flows_of_core(tables[0].join(pending, key, "left")), "ct-core")
    through.append(core.filter("src IS NULL").select(*g, F.col("dst").alias("node"), "f"))
    flow, done = core.filter("src IS NOT NULL").groupBy(*pair).agg(F.sum("f").alias("f")), [*done, core]
    for ways, explicit in zip(reversed(c.through), reversed(over)):
        met = stored(flow.join(ways, pair, "left"), "ct-flow")
        part = met.filter("via IS NOT NULL").select(*pair, "via", (F.col("f") * F.col("part")).alias("f"))
        through.append(part.select(*g, F.col("via").alias("node"), "f"))
        stays = met.groupBy(*pair).agg((F.max("f") * F.coalesce(F.max("kept"), F.lit(1.0))).alias("f")).filter("f > 0")
        flow = union([stays, part.select(*g, "src", F.col("via").alias("dst"), "f"), part.select(*g, F.col("via").alias("src"), "dst", "f"), explicit])
        flow = flow.groupBy(*pair).agg(F.sum("f").alias("f"))
        done.append(met)
    out = stored(union(through).groupBy(*g, "node").agg(F.sum("f").alias("f")), "ct-through")
    discard(*done)
    return out
