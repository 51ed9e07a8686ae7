"""Conversation repair against an exhaustive search."""
import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from freightline.llm import conversation

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """rows: (turn, role, text) in order -> the contract's columns."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                      "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, before, inserts):
        """(cost, audit, roles) of the cheapest repair of rows i.. after a role initial."""
        found = []
        if i == len(rows) and before in ("", "a"):
            found.append((0, "", ()))
        for r in "ua" if inserts < 3 else "":
            if r in NEXT[before]:
                c, audit, roles = best(i, r, inserts + 1)
                found.append((c + 3, "I" + audit, ((i, {"u": "user", "a": "assistant"}[r], True), *roles)))
        if i < len(rows):
            c, audit, roles = best(i + 1, before, 0)
            found.append((c + 4, "D" + audit, roles))
            if faults[i] in ("", "truncated"):
                extra, own = 3 * (faults[i] == "truncated"), rows[i][1]
                if own[:1] and own[0] in NEXT[before]:
                    c, audit, roles = best(i + 1, own[0], 0)
                    found.append((c + extra, "K" + audit, ((i, own, False), *roles)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in NEXT[before]:
                        c, audit, roles = best(i + 1, r, 0)
                        found.append((c + extra + 3, "R" + audit, ((i, name, False), *roles)))
        return min(found) if found else (10**9, "", ())

    cost, audit, roles = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    text = "\n".join(f"{name}:{'' if new else rows[i][2]}" for i, name, new in roles)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def in_order(rows):
    def key(r):
        return (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest())
    return sorted(rows, key=key)


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: in_order(r) for c, r in out.items()}


def check(spark, path, rows):
    got = {r["conv_id"]: r.asDict() for r in conversation.op11_conversation_repair(spark, path).collect()}
    want = brute_damage(rows)
    assert got.keys() == want.keys()
    for conv, damaged in want.items():
        assert got[conv] == {"conv_id": conv, **brute(damaged)}, conv


def test_small_table(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, sf_small, rows)


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(11)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (-1, None, None, "x"), (-2, 3, "", ""), (-2, 4, "tool", "Done."),
            (-3, -2**62, "user", "A."), (-3, 2**62, "assistant", "B." + " " * 50_000)]
    for conv in range(300):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "tool", "ursula", None]),
                         rng.choice(["Yes.", "No", "Hm! ", " \n", "", None, "Ä?\x1c", "x" * 3000 + "."])))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, audit int, digest string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    check(spark, str(tmp_path), rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = conversation.op11_conversation_repair(spark, str(tmp_path))
    assert out.collect() == [] and out.columns[0] == "conv_id" and out.columns[-1] == "repaired_sha256"


def test_blocks_give_the_same_audit(monkeypatch):
    rng = random.Random(5)
    codes = [bytes(rng.choice((0, 4, 8, 4, 8, 5, 7, 11, 12, 2)) for _ in range(n)) for n in (0, 1, 7, 90, 400, 1000)]
    whole = conversation.solve(codes)
    for size in (1, 3, 64):
        monkeypatch.setattr(conversation, "BLOCK", size)
        assert conversation.solve(codes) == whole


def test_ranks_order_nodes_by_their_least_audit():
    table = conversation.Steps()
    at, layers = table.id(conversation.END), [table.last]
    for code in (4, 8, 8, 4, 0, 4, 11, 8):
        at, _, layer = table.step(at, code)
        layers.insert(0, layer)
    [(letters, _)] = conversation.least_paths([np.array(layers)], [0], table)
    node, walked = 0, []
    first, move = (x[np.array(layers)].ravel() for x in (table.letter, table.move))
    while first[node]:
        walked.append(first[node])
        node += move[node]
    assert list(letters) == walked


def test_one_large_conversation_is_spread(spark):
    """A conversation of 20,000 turns: its bytes come from many tasks, its audit in order."""
    rows = spark.range(20_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    keyed = conversation.ordered_keys(conversation.typed(rows))
    parts = conversation.blocks(conversation.coded(keyed)).collect()
    assert len(parts) > 2 and sum(len(p.codes) for p in parts) == 20_000
    plan, turns = conversation.repair(rows)
    assert plan.collect()[0].audit == "K" * 20_000
    assert turns.count() == 20_000
