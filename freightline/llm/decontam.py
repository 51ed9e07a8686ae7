"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of benchmark items and documents become typed placeholders.  Windows of
five template words are hash-joined.  A document contains an item when its windows cover at least
0.8 of the item's windows; on each alignment the placeholders must be filled consistently, that is,
each value of the item always stands for the same value in the document.  So a question asked again
with other numbers or names is caught, and one whose slots disagree is not.

A Bloom filter of the benchmark's window hashes (a fixed number of bits) goes to the tasks, so only
windows that may match leave them; if the benchmark outgrows it, more rows reach the join and the
result is the same.

An item with fewer than five usable windows (short, or dense in slots) loses its coverage with one
window or has none, so its whole word sequence is also searched for, literally, without marks and case.

Defined cases: null or empty texts and items match nothing; an item with no window of five words,
three of them literal, is found as exact copy only; repeated items and rows give repeated pairs once; an
item without an id is not reported.
"""
from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialise, utf8
from .neardup import PLACES, WIDTH, mix

# Words that a slot of each type may hold.
UNITS = ("mm cm m km g kg mg lb oz l ml gal inch inches foot feet yard yards mile miles meter meters metre metres "
         "second seconds minute minutes hour hours day days week weeks month months year years gram grams liter "
         "liters litre litres dollar dollars euro euros cent cents percent").split()
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty "
                "seventy eighty ninety hundred thousand million").split()
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?")
MEASURE = re.compile(r"[0-9][0-9.,]*(" + "|".join(UNITS) + ")")
EDGE = "\"'“”‘’«»()[]{}<>.,;:!?*#%&$-–—_|"

CAP, ENDS, SLOT = 1, 2, 4  # flags in the lowest bits of a word's code
FLAGS = np.uint64(7)
NAME_CODE = np.uint64(xxhash.xxh3_64_intdigest(b"<name>") & ~7)


class WordCodes(dict):
    """Code of each word: hash of its template word and three flags; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        s = word.decode()
        core = s.strip(EDGE)
        low = core.lower()
        kind = ("<num>" if NUMBER.fullmatch(core) or low in NUMBER_WORDS else "<num><unit>" if MEASURE.fullmatch(low)
                else "<unit>" if low in UNITS else None)
        code = xxhash.xxh3_64_intdigest(utf8(kind or low)) & ~7
        if kind:
            code |= SLOT
        elif len(core) > 1 and core[0].isupper() and core[1:].islower():
            code |= CAP
        if s.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", ":"):
            code |= ENDS
        self[word] = code
        return code


def template(text: str | None, codes: WordCodes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, slot flags, window hashes and whether each window is usable (three literal words).
    A capitalised word is a name unless it opens a sentence."""
    words = utf8(text or "").split()
    n = len(words)
    c = np.fromiter(map(codes.__getitem__, words), np.uint64, n)
    flags = (c & FLAGS).astype(np.int64)
    opens = np.ones(n, bool)
    opens[1:] = (flags[:-1] & ENDS) > 0
    name = ((flags & CAP) > 0) & ~opens
    slot = name | ((flags & SLOT) > 0)
    if n < WIDTH:
        return words, slot, np.empty(0, np.uint64), np.empty(0, bool)
    h = np.where(name, NAME_CODE, c & ~FLAGS)
    total = np.zeros(n - WIDTH + 1, np.uint64)
    slots = np.zeros(n - WIDTH + 1, np.int64)
    for i in range(WIDTH):
        total += h[i:n - WIDTH + 1 + i] * PLACES[i]
        slots += slot[i:n - WIDTH + 1 + i]
    return words, slot, mix(total), slots <= WIDTH - 3


def slot_values(words: list[bytes], slot: np.ndarray, at: int) -> list[str]:
    """Slot fillings of the window at ``at``, as compared: lower case, without marks around them."""
    return [words[i].decode().strip(EDGE).lower() for i in range(at, at + WIDTH) if slot[i]]


WINDOW = [("window", T.LongType()), ("at", T.IntegerType()), ("slots", T.ArrayType(T.StringType()))]
#: Bits of the filter that reaches every task; at most so many numbers are collected for it.
BLOOM_BITS = 1 << 22


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the distinct texts of a benchmark: (item_text, window, at, slots, total)."""
    codes = WordCodes()

    def run(texts):
        rows = []
        for text in texts:
            words, slot, windows, usable = template(text, codes)
            places = np.flatnonzero(usable).tolist()
            rows += [(text, int(windows[i].view(np.int64)), i, slot_values(words, slot, i), len(places)) for i in places]
        names = ("item_text", "window", "at", "slots", "total")
        yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    texts = benchmark.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    return map_batches(texts, run, [("item_text", T.StringType()), *WINDOW, ("total", T.IntegerType())], ["text"])


def document_windows(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Windows of documents (row, text) whose hash is in the filter: (row, window, at, slots)."""
    codes = WordCodes()
    last = np.uint64(BLOOM_BITS - 1)

    def run(rows_, texts):
        rows = []
        for row, text in zip(rows_, texts):
            words, slot, windows, usable = template(text, codes)
            found = np.flatnonzero(usable & bits[(windows & last).astype(np.int64)])
            rows += [(row, int(windows[i].view(np.int64)), i, slot_values(words, slot, i)) for i in found.tolist()]
        names = ("row", "window", "at", "slots")
        yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return map_batches(docs, run, [("row", T.LongType()), *WINDOW], ["row", "text"])


#: Items with fewer usable windows than this are also searched for as whole word sequences.
FEW_WINDOWS = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Spans:
    """Hashes of all spans of one length in a word sequence, in time that does not depend on the length;
    a filter for the literal key, which is only made where they match."""

    def __init__(self, codes: WordCodes, size: int = 1024):
        self.codes = codes
        self.grow(size)

    def grow(self, size: int) -> None:
        self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, BASE))), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, INVERSE))), dtype=np.uint64)

    def sums(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if n >= len(self.up):
            self.grow(2 * n)
        h = np.fromiter(map(self.codes.__getitem__, words), np.uint64, n) & ~FLAGS
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)))

    def hashes(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return mix((sums[length:] - sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def literal_key(words: list[bytes]) -> int | None:
    """Names a word sequence without marks around the words and case; None if only marks are left."""
    cores = [w.decode().strip(EDGE).lower() for w in words]
    return xxhash.xxh3_64_intdigest(utf8("\n".join(cores))) - (1 << 63) if any(cores) else None


def whole_items(benchmark: DataFrame) -> DataFrame:
    """(item_text, literal, hash, length) of the distinct texts with few usable windows."""
    codes = WordCodes()
    spans = Spans(codes)

    def run(texts):
        rows = []
        for text in texts:
            words, _, _, usable = template(text, codes)
            literal = literal_key(words)
            if literal is not None and usable.sum() < FEW_WINDOWS:
                rows.append((text, literal, int(spans.hashes(spans.sums(words), len(words)).view(np.int64)[0]), len(words)))
        names = ("item_text", "literal", "hash", "length")
        yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    texts = benchmark.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    return map_batches(texts, run, [("item_text", T.StringType()), ("literal", T.LongType()), ("hash", T.LongType()),
                                    ("length", T.IntegerType())], ["text"])


def whole_copies(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item_text) of documents that hold the whole word sequence of an item of :func:`whole_items`."""
    bits = np.zeros(BLOOM_BITS, bool)
    slots = items.select(F.col("hash").bitwiseAND(BLOOM_BITS - 1).alias("b")).distinct().toPandas()["b"]
    bits[slots.to_numpy(np.int64)] = True
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())
    spans = Spans(WordCodes())
    last = np.uint64(BLOOM_BITS - 1)

    def run(rows_, texts):
        found = set()
        for row, text in zip(rows_, texts):
            words = utf8(text or "").split()
            sums = spans.sums(words)
            for length in lengths:
                at = np.flatnonzero(bits[(spans.hashes(sums, length) & last).astype(np.int64)])
                found |= {(row, literal_key(words[i:i + length])) for i in at.tolist()}
        found = [x for x in found if x[1] is not None]
        yield {"row": [r for r, _ in found], "literal": [k for _, k in found]}

    if not lengths:
        return items.select(F.lit(0).cast("long").alias("row"), "item_text")
    copies = map_batches(rows, run, [("row", T.LongType()), ("literal", T.LongType())], ["row", "text"])
    return materialise(copies.distinct(), "copies").join(items, "literal").select("row", "item_text").distinct()


def row_key():
    """Names a row by id and text, so rows that share an id stay apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """(row, item_text, n_windows, total, exact): documents' rows that contain a benchmark item."""
    items = materialise(benchmark_windows(benchmark), "items")
    bits = np.zeros(BLOOM_BITS, bool)
    slots = items.select(F.col("window").bitwiseAND(BLOOM_BITS - 1).alias("b")).distinct().toPandas()["b"]
    bits[slots.to_numpy(np.int64)] = True

    rows = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text"))
    hits = materialise(document_windows(rows, bits), "hits").select("row", "window", F.col("at").alias("d_at"),
                                                                 F.col("slots").alias("d_slots")).distinct()
    met = hits.join(items, "window").withColumn("shift", F.col("d_at") - F.col("at"))
    pairs = F.arrays_zip(F.col("slots").alias("i"), F.col("d_slots").alias("d"))
    lines = met.withColumn("pairs", pairs).groupBy("row", "item_text", "shift").agg(
        F.max("total").alias("total"), F.collect_set("at").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("filled"))
    given = F.size(F.array_distinct(F.transform("filled", lambda p: p["i"])))
    lines = lines.filter(given == F.size("filled")).withColumn("exact", F.forall("filled", lambda p: p["i"] == p["d"]))
    out = lines.groupBy("row", "item_text").agg(
        F.max("total").alias("total"), F.bool_and("exact").alias("exact"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_windows"))
    out = out.filter(F.col("n_windows") >= F.col("total") * coverage)
    whole = materialise(whole_items(benchmark), "whole")
    totals = items.groupBy("item_text").agg(F.max("total").alias("total"))
    copies = whole_copies(rows, whole).join(totals, "item_text", "left").withColumn("total", F.coalesce("total", F.lit(1)))
    out = out.select("row", "item_text", "total", "exact", "n_windows").unionByName(
        copies.select("row", "item_text", "total", F.lit(True).alias("exact"), F.col("total").alias("n_windows")))
    return out.groupBy("row", "item_text").agg(F.max("n_windows").alias("n_windows"), F.max("total").alias("total"),
                                               F.bool_or("exact").alias("exact"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_windows, total, coverage, kind): one row per document and item it contains;
    kind: ``exact``, or ``reparameterised`` if slots hold other values."""
    found = materialise(contaminated(docs, benchmark, coverage), "leaks")
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row")).join(found, "row")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("item_text")).filter("item_id IS NOT NULL").distinct()
    return names.join(items, "item_text").select(
        "doc_id", "item_id", "n_windows", "total", F.round(F.col("n_windows") / F.col("total"), 6).alias("coverage"),
        F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind")).distinct()


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = materialise(found.select(F.col("row").alias("leak")).distinct(), "leaks")
    marked = docs.select(F.struct(*docs.columns).alias("doc"), row_key().alias("key"))
    left = marked.join(rows, F.col("key") == F.col("leak"), "left_anti")
    return left.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
