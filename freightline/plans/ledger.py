"""Shipment ledger as event sourcing on tables (LG rows).

The ledger is an append-only event table ``(shipment_id, seq, ts, status, ...)``.
State is a fold of the events per shipment:

* latest state / milestones / counts are aggregates (``max_by``, filtered
  ``max``) -- partial aggregation, no per-key sort;
* the pairwise transition check is a ``lag`` window;
* the exact acceptance fold (an event is accepted only if the *accepted*
  state before it allows it) takes one grouped minimum per state of the longest
  chain, so a shipment with very many events is spread over all tasks.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightline.session import stored

# Allowed status transitions of the ledger contract.
TRANSITIONS = {
    "CREATED": ["DISPATCHED", "CANCELLED"],
    "DISPATCHED": ["IN_TRANSIT", "DELAYED"],
    "IN_TRANSIT": ["CUSTOMS_HOLD", "DELIVERED"],
    "CUSTOMS_HOLD": ["RELEASED", "CONFISCATED"],
}
# Documents required for customs compliance.
REQUIRED_CUSTOMS_DOCUMENTS = ["commercial_invoice", "certificate_of_origin"]


def transition_allowed(prev, nxt) -> Column:
    """Whether ``prev -> nxt`` is in the transition table (literal map, no join)."""
    m = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    p = F.col(prev) if isinstance(prev, str) else prev
    n = F.col(nxt) if isinstance(nxt, str) else nxt
    return F.coalesce(F.array_contains(F.element_at(m, p), n), F.lit(False))


def first_create(events: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG1: the first CREATED event per id is accepted, later ones are rejected.
    The winner is an aggregate (``min_by``) joined back, not a per-key sort."""
    created = events.filter(F.col("status") == "CREATED")
    first = created.groupBy(key).agg(F.min_by(F.col(seq), F.struct(ts, seq)).alias("_first"))
    return created.join(first, key).withColumn("accepted", F.col(seq) == F.col("_first")).drop("_first")


def latest_state(events: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq",
                 fields: Sequence[str] = ("status",)) -> DataFrame:
    """LG2: state of the newest event per id (ties broken by sequence)."""
    s = F.max_by(F.struct(*[F.col(f) for f in fields], F.col(ts).alias("_ts"), F.col(seq).alias("_seq")),
                 F.struct(ts, seq))
    g = events.groupBy(key).agg(s.alias("_s"), F.count(F.lit(1)).alias("n_events"))
    return g.select(key, *[F.col(f"_s.{f}").alias(f) for f in fields], F.col("_s._ts").alias("last_update"),
                    F.col("_s._seq").alias("last_seq"), "n_events")


def pairwise_transitions(events: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG3 pairwise mode: each event checked against the previous event's status."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    e = events.withColumn("prev_status", F.lag("status").over(w))
    ok = F.when(F.col("prev_status").isNull(), F.col("status") == "CREATED").otherwise(
        transition_allowed("prev_status", "status"))
    return e.withColumn("valid", ok)


def longest_chain(transitions: dict) -> int:
    """States on the longest path from CREATED; raises on a cycle."""
    def depth(state, seen):
        if state in seen:
            raise ValueError(f"transitions return to {state}")
        return 1 + max((depth(n, seen | {state}) for n in transitions.get(state, ())), default=0)
    return depth("CREATED", frozenset())


def exact_fold(events: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG3 exact mode: an event is accepted only if the state built from the
    previously *accepted* events allows it; rejected events leave the state
    unchanged.  Output adds ``accepted`` and ``state_after``.

    No status returns, so a shipment accepts as many events as the longest
    chain has states at most.  Each round finds the next accepted event of
    every shipment: the earliest one after the last accepted that its status
    allows, a minimum pre-aggregated in the map tasks.  So the events of one
    shipment may lie in all tasks; per shipment only its accepted events meet."""
    e = events.select(key, seq, ts, "status")
    at = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    slim = stored(e, "ledger-events")
    first = slim.filter("status = 'CREATED'").groupBy(key).agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), "status")).alias("last"))
    rounds = [stored(first, "ledger-accepted")]
    for _ in range(longest_chain(TRANSITIONS) - 1):
        now = slim.join(rounds[-1], key).filter((at > F.struct("last.ts", "last.seq")) & transition_allowed("last.status", "status"))
        rounds.append(stored(now.groupBy(key).agg(F.min(F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), "status")).alias("last")), "ledger-accepted"))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    chain = every.groupBy(key).agg(F.array_sort(F.collect_list("last")).alias("_chain"))  # at most the longest chain
    j = slim.join(chain, key, "left")
    upto = F.filter("_chain", lambda c: F.struct(c["ts"].alias("ts"), c["seq"].alias("seq")) <= at)
    last = F.try_element_at(upto, F.lit(-1))
    j = j.withColumn("_last", last)
    accepted = F.coalesce((F.col("_last.seq") == F.col(seq)) & (F.col("_last.ts") == F.col(ts)), F.lit(False))
    return j.select(key, seq, ts, "status", accepted.alias("accepted"), F.col("_last.status").alias("state_after"))


def last_tombstones(deletions: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG8: the latest deletion per key: key, ``dead_ts``, ``dead_seq``.  An earlier one ends nothing that the
    latest does not end."""
    last = deletions.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))).alias("t"))
    return last.select(key, F.col("t.ts").alias("dead_ts"), F.col("t.seq").alias("dead_seq"))


def live_events(events: DataFrame, tombstones: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG8: events after their key's tombstone, with ``recreated``: whether the key has one.  A key without
    later events is gone; one created anew starts over.  A late event from before the deletion stays dead."""
    j = events.join(tombstones, key, "left")
    alive = F.col("dead_ts").isNull() | (F.struct(F.col(ts).alias("t"), F.col(seq).alias("s")) > F.struct(F.col("dead_ts").alias("t"), F.col("dead_seq").alias("s")))
    return j.filter(alive).select(*events.columns, F.col("dead_ts").isNotNull().alias("recreated"))


def compacted(events: DataFrame, deletions: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG8: the log that gives the same state: live events and one tombstone per deleted key (kept, so that late
    events stay dead), told apart by ``tombstone``.  Compacting a compacted log changes nothing."""
    dead = last_tombstones(deletions, key, ts, seq)
    marks = dead.select(key, F.col("dead_ts").alias(ts), F.col("dead_seq").alias(seq), F.lit(True).alias("tombstone"))
    live = live_events(events.select(key, ts, seq, *[c for c in events.columns if c not in (key, ts, seq)]), dead, key, ts, seq)
    return live.drop("recreated").withColumn("tombstone", F.lit(False)).unionByName(marks, allowMissingColumns=True)


def milestones(events: DataFrame, key: str = "shipment_id", ts: str = "ts",
               statuses: Sequence[str] = ("DISPATCHED", "DELIVERED", "CUSTOMS_CLEARED")) -> DataFrame:
    """LG4: last timestamp of each milestone status (last write wins)."""
    return events.groupBy(key).agg(*[F.max(F.when(F.col("status") == s, F.col(ts))).alias(f"{s.lower()}_at")
                                     for s in statuses])


def history(events: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG5: ordered history with a 1-based position per shipment."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    return events.withColumn("position", F.row_number().over(w))


def missing_documents(docs: DataFrame, key: str, doc_type: str,
                      required: Sequence[str] = tuple(REQUIRED_CUSTOMS_DOCUMENTS)) -> DataFrame:
    """LG9: required documents absent per shipment (distinct types only are collected)."""
    req = F.array(*[F.lit(r) for r in required])
    g = docs.groupBy(key).agg(F.collect_set(doc_type).alias("_types"))
    miss = F.array_sort(F.array_except(req, "_types"))
    return g.select(key, miss.alias("missing"), (F.size(miss) == 0).alias("compliant"))


def customs_cleared(approvals: DataFrame, key: str, agency: str, ts: str, as_of: str | None = None,
                    needed: int = 2) -> DataFrame:
    """AG16/LG11: distinct approving agencies before ``as_of``; >= needed clears."""
    a = approvals if as_of is None else approvals.filter(F.col(ts) < F.lit(as_of).cast(approvals.schema[ts].dataType))
    g = a.groupBy(key).agg(F.count_distinct(agency).alias("n_agencies"), F.count(F.lit(1)).alias("n_approvals"))
    return g.withColumns({"cleared": F.col("n_agencies") >= needed,
                          "repeated_rejected": F.col("n_approvals") - F.col("n_agencies")})


def claim_decision(claims: DataFrame, amount: str, coverage: str) -> DataFrame:
    """LG12: a claim up to the coverage is PENDING, above it REJECTED."""
    return claims.withColumn("claim_status", F.when(F.col(amount) <= F.col(coverage), F.lit("PENDING"))
                             .otherwise(F.lit("REJECTED")))


def hash_chain(events: DataFrame, key: str, ts: str, seq: str, cols: Sequence[str]) -> DataFrame:
    """LG16: per shipment, ``h_n = sha256(h_{n-1} || record_hash_n)`` streamed in
    order per partition (same layout as :func:`exact_fold`)."""
    import hashlib
    from ..functions.text import record_hash
    rec = record_hash(cols)
    e = events.select(key, seq, ts, rec.alias("record_hash")).repartition(key).sortWithinPartitions(key, ts, seq)
    schema = T.StructType(e.schema.fields + [T.StructField("chain_hash", T.StringType())])

    def run(it):
        cur, h = object(), ""
        for pdf in it:
            out = []
            for k, r in zip(pdf[key].tolist(), pdf["record_hash"].tolist()):
                if k != cur:
                    cur, h = k, ""
                h = hashlib.sha256((h + r).encode()).hexdigest()
                out.append(h)
            pdf = pdf.copy()
            pdf["chain_hash"] = out
            yield pdf
    return e.mapInPandas(run, schema)


def latest_carrier(assignments: DataFrame, key: str = "shipment_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """LG6: carrier of the newest CARRIER_ASSIGNED event per shipment."""
    return assignments.groupBy(key).agg(F.max_by("carrier", F.struct(ts, seq)).alias("carrier"),
                                        F.max(ts).alias("assigned_at"))


def batch_updates(batches: DataFrame, existing: DataFrame, key: str = "shipment_id") -> DataFrame:
    """LG7: batch requests with parallel arrays ``ids, statuses, locations``.
    A length mismatch rejects the whole batch; unknown ids are skipped; the
    rest become status events (to be folded by :func:`latest_state`)."""
    same = (F.size("ids") == F.size("statuses")) & (F.size("ids") == F.size("locations"))
    ok = batches.filter(same)
    rows = ok.select("batch_id", "batch_ts", F.posexplode(F.arrays_zip("ids", "statuses", "locations")).alias("pos", "u"))
    rows = rows.select("batch_id", "batch_ts", "pos", F.col("u.ids").alias(key), F.col("u.statuses").alias("status"),
                       F.col("u.locations").alias("location"))
    return rows.join(existing.select(key).distinct(), key, "left_semi")


def metadata(state: DataFrame) -> DataFrame:
    """LG14: projection of the latest state with convenience flags."""
    return state.withColumns({"is_delivered": F.col("status") == "DELIVERED", "is_cancelled": F.col("status") == "CANCELLED",
                              "in_customs": F.col("status") == "CUSTOMS_HOLD"})
