"""Near-duplicate documents with an LSH forest over MinHash signatures.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes) and is named by a
   128-bit digest of that set.  Equal sets meet in one row, so exact copies cost nothing further.
2. A signature of trees x 8 MinHash values gives one sorted order per tree.  Sets that share the
   first three values of an order form a region; a region with more than ``region_rows`` sets is
   divided at depth five, then eight, then by hash, so no task holds an unbounded region.
3. Candidates are neighbours in these orders, that is, sets with the longest common prefix: all
   members of a small region, the next ``near`` ones in a larger region.  In larger regions each
   set also meets the hub of its prefix at every depth: one of the members that share full prefixes
   with most others over all trees (counts within a factor of 1.4 rank alike, a hash draws among
   them, so the orders name different hubs), which are the centre of a group of edited copies.
   A bitmap of each set travels along and drops pairs that cannot reach the similarity.
4. Candidates are confirmed on full shingle sets, in rounds: each set's strongest candidate that
   lies in another component, then the components are merged.  What is still in different
   components after the last round is confirmed whole, so no candidate is left out.
5. Sets of larger regions did not meet their whole region: those still in different components meet
   in an exact prefix join over rare shingles, so neither ``near`` nor a division costs a link.

Two sets at similarity 0.85 share a region in some of 16 trees with probability 1 - 2e-7.

Defined cases: null or empty text has no shingles, is its own component and kept; a text of one to
four words is one shingle; documents without a doc_id take part in links but name no component
(null where no member has an id); repeated rows are exact copies.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_of, map_batches, materialise, release, utf8
from .components import connected_components

WIDTH = 5
DEPTHS = (3, 5, 8)
#: 64-bit words of a set's bitmap.
WORDS = 8
#: Odd constants of the shingle hash, one per place in the shingle.
PLACES = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                      0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


class WordHashes(dict):
    """64-bit hash of each word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: ASCII letters in lower case, words between ASCII
    white space, five words each; fewer words make one shingle."""
    words = utf8(text or "").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(n, WIDTH)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i:n - k + 1 + i] * PLACES[i]
    return np.unique(mix(total))


def signatures(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """MinHash values, one row per non-empty set; sets are joined into blocks that fit the cache."""
    out = np.empty((len(sets), len(factors)), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 100_000):
            size += len(sets[end])
            end += 1
        block = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at:end - 1])])
        for j, f in enumerate(factors):
            out[at:end, j] = np.minimum.reduceat(block * f, starts)
        at = end
    return out


def prefixes(sig: np.ndarray, trees: int) -> list[np.ndarray]:
    """Per depth, the hash of each tree's prefix: (documents, trees)."""
    sig = sig.reshape(len(sig), trees, DEPTHS[-1])
    h = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), sig.shape[:2]).copy()
    out = []
    for d in range(DEPTHS[-1]):
        h = mix(h * PLACES[0] + sig[:, :, d])
        if d + 1 in DEPTHS:
            out.append(h.view(np.int64))
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit per shingle, by its lowest bits: shingles that two sets share have the same bit."""
    flags = np.zeros(64 * WORDS, bool)
    flags[s % np.uint64(64 * WORDS)] = True
    return np.packbits(flags, bitorder="little").view("<i8")


def may_reach(n: str, bits: str, m: str, other: str, percent: int):
    """False only for sets below the similarity: each bit of one set that the other lacks is a shingle
    they do not share, which bounds the intersection from above."""
    def lacking(a, b):
        words = (F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(WORDS))
        return reduce(lambda x, y: x + y, words)
    common = F.least(F.col(n) - lacking(bits, other), F.col(m) - lacking(other, bits))
    return common * (100 + percent) >= (F.col(n) + F.col(m)) * percent


def fingerprints(docs: DataFrame, trees: int) -> DataFrame:
    """(doc_id, n_shingles, key, bits, p3, p5, p8): the name of each document's set, its bitmap and prefixes."""
    factors = np.random.default_rng(85).integers(1, 2**63, trees * DEPTHS[-1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = WordHashes()

    def run(ids, texts):
        sets = [shingle_set(t, hashes) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        out = {"doc_id": ids, "n_shingles": [len(s) for s in sets], "key": keys,
               "bits": [bitmap(s) for s in sets]}
        per_depth = prefixes(signatures([sets[i] for i in full], factors), trees) if full else [[]] * len(DEPTHS)
        for d, values in zip(DEPTHS, per_depth):
            column = [None] * len(sets)
            for i, v in zip(full, values):
                column[i] = v
            out[f"p{d}"] = column
        yield out

    return map_batches(docs, run, [("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("key", T.BinaryType()),
                                   ("bits", T.ArrayType(T.LongType())), *((f"p{d}", T.ArrayType(T.LongType())) for d in DEPTHS)], ["doc_id", "text"])


def similar_size(a: str, b: str, percent: int):
    """Necessary for the similarity: sizes of the two sets are close enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def candidates(sets: DataFrame, percent: int, small: int, near: int, region_rows: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: candidate pairs (a, b, votes) of set numbers with a < b, and the sets (set, n, bits)
    of larger regions, which do not meet all their region; votes: the orders that proposed the pair."""
    trees = sets.select("set", "n", F.explode(F.arrays_zip(*(f"p{d}" for d in DEPTHS))).alias("p"))
    trees = trees.select("set", "n", *(F.col(f"p.p{d}").alias(f"p{d}") for d in DEPTHS))
    shared = trees.groupBy("p3").agg(F.count("*").alias("n3")).filter("n3 > 1")
    # bitmaps join only the rows that share a region
    live = materialise(trees.join(shared, "p3").join(sets.select("set", "bits"), "set"), "forest")
    dense = live.filter(F.col("n3") > small)
    deeper = [dense.groupBy(f"p{d}").agg(F.count("*").alias(f"n{d}")) for d in DEPTHS[1:]]
    dense = materialise(reduce(lambda x, y: x.join(y, y.columns[0]), deeper, dense), "forest")

    fits = F.when(F.col("n3") <= region_rows, F.col("p3")).when(F.col("n5") <= region_rows, F.col("p5"))
    # p8 names the tree, so a pair that one tree's parts split meets anew in the next tree
    part = F.when(F.col("n3") <= region_rows, 0).when(F.col("n5") <= region_rows, 0).otherwise(
        F.pmod(F.xxhash64("set", "p8"), F.ceil(F.col("n8") / region_rows)))
    regions = dense.select("set", "n", "bits", "p5", "p8", F.lit(near).alias("reach"),
                           F.coalesce(fits, F.col("p8")).alias("region"), part.alias("part"))
    regions = regions.unionByName(live.filter(F.col("n3") <= small).select(
        "set", "n", "bits", "p5", "p8", F.lit(small - 1).alias("reach"), F.col("p3").alias("region"),
        F.lit(0).cast("long").alias("part")))
    order = Window.partitionBy("region", "part").orderBy("p5", "p8", "set").rowsBetween(1, max(near, small - 1))
    following = F.collect_list(F.struct("set", "n", "bits")).over(order)
    pairs = regions.withColumn("following", following).select(
        "set", "n", "bits", F.explode(F.slice("following", F.lit(1), F.col("reach"))).alias("o"))
    pairs = pairs.select("set", "n", "bits", F.col("o.set").alias("other"), F.col("o.n").alias("m"), F.col("o.bits").alias("other_bits"))

    popular = dense.groupBy("set").agg(F.floor(2 * F.log2(F.sum("n8"))).alias("popular"))
    ranked = materialise(dense.join(popular, "set"), "forest")
    for d in DEPTHS:
        pick = F.struct("popular", F.xxhash64("set", f"p{d}").alias("draw"), "set", "n", "bits")
        hub = ranked.filter(F.col(f"n{d}") > 1).groupBy(f"p{d}").agg(F.max(pick).alias("hub"))
        pairs = pairs.unionByName(ranked.join(hub, f"p{d}").select(
            "set", "n", "bits", F.col("hub.set").alias("other"), F.col("hub.n").alias("m"), F.col("hub.bits").alias("other_bits")))
    pairs = pairs.filter((F.col("set") != F.col("other")) & similar_size("n", "m", percent)
                         & may_reach("n", "bits", "m", "other_bits", percent))
    pairs = materialise(pairs.groupBy(F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b")).agg(
        F.count("*").alias("votes")), "pairs")
    large = materialise(ranked.select("set", "n", "bits").dropDuplicates(["set"]), "large")
    release(live, dense, ranked)
    return pairs, large


#: Slots of the filter that spares the texts of documents without candidates: at most so many rows are broadcast.
SLOTS = 1 << 19


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, shingles) of the wanted sets (set, key, first_id), computed again from the texts of their
    first documents.  The filter before it broadcasts hash slots, SLOTS at most."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(wanted.select(slot("first_id")).distinct())
    some = docs.withColumn("slot", slot("doc_id")).join(slots, "slot", "left_semi").select("doc_id", "text")
    hashes = WordHashes()

    def run(ids, texts):
        sets = [shingle_set(t, hashes) for t in texts]
        yield {"doc_id": ids, "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
               "shingles": [s.view(np.int64) for s in sets]}

    made = map_batches(some, run, [("doc_id", T.LongType()), ("key", T.BinaryType()),
                                   ("shingles", T.ArrayType(T.LongType()))], ["doc_id", "text"])
    first = wanted.select(F.col("first_id").alias("doc_id"), "set", F.col("key").alias("want")).withColumn("id_hash", F.xxhash64("doc_id"))
    made = made.withColumn("id_hash", F.xxhash64("doc_id"))
    same = made["doc_id"].eqNullSafe(first["doc_id"]) & (made["key"] == first["want"]) & (made["id_hash"] == first["id_hash"])
    return made.join(first, same).select("set", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("common")
    return both.filter(F.col("common") * 100 >= union * percent).select("a", "b")


def strongest(pairs: DataFrame) -> DataFrame:
    """Of each set its pair (a, b) with the most votes."""
    sided = pairs.select(F.col("a").alias("set"), F.struct("votes", F.col("b").alias("other")).alias("v")).unionByName(
        pairs.select(F.col("b").alias("set"), F.struct("votes", F.col("a").alias("other")).alias("v")))
    return sided.groupBy("set").agg(F.max("v").alias("v")).select(
        F.least("set", "v.other").alias("a"), F.greatest("set", "v.other").alias("b")).distinct()


#: Slots of the shingle counts that give the order of the prefix join; at most so many rows are collected.
COUNT_SLOTS = 1 << 18


def open_pairs(full: DataFrame, sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Written table: pairs (a, b) of the given sets (set, n, bits) in different components that may reach the
    similarity: no pair that does is left out.  Prefix join: with all shingles in one order, rare
    ones first, such sets share one among their first n - ceil(n percent / 100) + 1, and what follows
    the first one they share is long enough.  Per shingle only sets outside its largest component
    meet the others."""
    slot = F.col("shingle").bitwiseAND(COUNT_SLOTS - 1).alias("slot")
    some = full.join(sets, "set", "left_semi")
    counted = some.select(F.explode("shingles").alias("shingle")).groupBy(slot).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(COUNT_SLOTS, np.int64)
    counts[counted["slot"].to_numpy(np.int64)] = counted["n"]

    def run(numbers, shingles):
        rows = {"set": [], "shingle": [], "at": []}
        for number, s in zip(numbers, shingles):
            s = np.array(s, np.int64)
            times = counts[s & (COUNT_SLOTS - 1)]
            head = np.lexsort((s, times))[:len(s) - -(-len(s) * percent // 100) + 1]
            at = np.flatnonzero(times[head] > 1)  # a shingle counted once is in no other set
            rows["set"] += [number] * len(at)
            rows["shingle"] += s[head[at]].tolist()
            rows["at"] += at.tolist()
        yield rows

    heads = map_batches(some, run, [("set", T.LongType()), ("shingle", T.LongType()), ("at", T.IntegerType())], ["set", "shingles"])
    roots = linked.select(F.col("node").alias("set"), "root")
    named = sets.select("set", "n", "bits").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = materialise(heads.join(named, "set"), "heads")
    of_root = heads.groupBy("shingle", "root").agg(F.count("*").alias("m"))
    largest = of_root.groupBy("shingle").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots"))
    largest = materialise(largest.filter("roots > 1").select("shingle", F.col("top.root").alias("top")), "heads")
    live = materialise(heads.join(largest, "shingle"), "heads")
    minor = live.filter("root != top").drop("top")
    other = live.select("shingle", *(F.col(c).alias(f"o_{c}") for c in ("set", "n", "bits", "at", "root")))
    rest = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    long_enough = rest * (100 + percent) >= (F.col("n") + F.col("o_n")) * percent
    met = minor.join(other, (minor["shingle"] == other["shingle"]) & (F.col("root") != F.col("o_root")) & long_enough
                     & may_reach("n", "bits", "o_n", "o_bits", percent))
    met = materialise(met.select(F.least("set", "o_set").alias("a"), F.greatest("set", "o_set").alias("b")).distinct(), "pairs")
    release(heads, largest, live)
    return met


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = 16, small: int = 8, near: int = 16,
                    region_rows: int = 4096, rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document; ``percent``: similarity of a link.
    ``rounds``: rounds that confirm one pair per set before all that is still open is confirmed; it
    changes the work, not the result."""
    docs = documents_of(docs)
    prints = materialise(fingerprints(docs, trees), "prints")
    sets = prints.filter("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"),
        *(F.first(f"p{d}").alias(f"p{d}") for d in DEPTHS))
    sets = materialise(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    slim = materialise(prints.select("doc_id", "n_shingles", "key"), "slim")
    release(prints)

    pairs, large = candidates(sets, percent, small, near, region_rows)
    names = materialise(sets.select("set", "key", "first_id"), "names")
    release(sets)
    ends = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
    ends = ends.unionByName(large.select("set")).distinct()
    full = materialise(full_sets(docs, names.join(ends, "set")), "full")

    linked, waiting, spent = None, pairs, [names, full, large]
    # one pair per set, then all that is open, then all that the forest did not propose in larger regions
    for step in [*["strongest"] * rounds, "open", "beyond"]:
        last = step != "strongest"
        chosen = (strongest(waiting) if step == "strongest" else waiting.select("a", "b") if step == "open" else
                  open_pairs(full, large, linked, percent))
        links = confirmed(chosen, full, percent)
        if linked is not None:
            links = links.unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
        linked = materialise(connected_components(links), "roots")
        spent.append(linked)
        if step == "beyond":
            spent.append(chosen)
        if not last:
            root = lambda end: linked.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            rest = waiting.join(chosen, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
            rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            spent.append(waiting)
            waiting = materialise(rest.select("a", "b", "votes"), "pairs")

    ids = linked.join(names.select(F.col("set").alias("node"), "first_id"), "node")
    lowest = ids.groupBy("root").agg(F.min("first_id").alias("lowest"))
    named = ids.join(lowest, "root").select(F.col("node").alias("set"), "lowest")
    components = names.join(named, "set", "left").select("key", F.coalesce("lowest", "first_id").alias("component"))
    out = slim.join(components, "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = materialise(out.select("doc_id", "n_shingles", component.alias("component_id"),
                                 F.col("doc_id").eqNullSafe(component).alias("kept")), "classes")
    release(slim, waiting, *spent)
    return out


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Similarity of a link in the pipeline, whose stages go by 0.8 or more; the query's contract says 0.85.
STAGE_PERCENT = 80


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays.  Documents without an id all stay,
    as do texts without words; of repeated rows (one id, one text) one stays."""
    found = near_duplicates(docs, percent=STAGE_PERCENT)
    kept = found.filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kept = kept.select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.col("text").cast("string")).alias("of_text"))
    out = rows.filter("id IS NOT NULL").join(kept, F.col("id") == F.col("kept_id"), "left_semi").dropDuplicates(["id", "of_text"])
    return out.unionByName(rows.filter("id IS NULL")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
