"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

The pieces of all documents are packed together, not per partition.  Best fit decreasing depends
on lengths only, so the plan is computed from the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are: lengths from long to short, a segment tree
over remaining capacities finds the tightest open sequence that fits in logarithmic time, and
equal pieces into equal sequences are placed in one step.  The plan is a bounded table of steps
(each step at least halves what remains of a run of sequences, so there are about 3 * capacity *
log2(capacity) at most).  Every piece gets its rank among pieces of its length and looks its place
up in the plan.

A piece's rank is its number among its task's pieces of that length, given while tokenising, after
the counts of the tasks before it, so token ids are not shuffled.

Defined cases: null text is empty and packs as the end id alone; only documents longer than the
capacity are cut; repeated rows are packed once each; an empty table gives an empty result.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import append_columns, bounded_batches, documents_of, materialise

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
PIECE = [("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
         ("ids_crc32", T.LongType())]


class ChunkTokens(dict):
    """Token ids, as little-endian 32-bit bytes, of the runs between white space.

    The tokenizer folds white space and splits at it, so each run has its ids wherever it stands.
    A run of ASCII and Latin letters is split on into words, marks and digits as the tokenizer
    does, so that fewer strings reach it; any other run reaches it whole.  Bounded."""

    # The tokenizer's own split pattern after lower-casing, for the letters of SIMPLE.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    SIMPLE = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")  # without "<", which may open a special token

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.words: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.alphabet = "".join(chr(b if b in shown else next(spare)) for b in range(256))

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word_ids(self, word: str) -> bytes:
        """Ids of one piece of the split, which needs no more than the merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        found = [t.id for t in self.tokenizer.model.tokenize(word)]
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        if self.SIMPLE.fullmatch(chunk):
            if len(self.words) > 200_000:
                self.words.clear()
            out = b""
            for w in self.SPLIT.findall(chunk.lower()):
                if (ids := self.words.get(w)) is None:
                    ids = self.words[w] = self.word_ids(w)
                out += ids
        else:
            out = self.ids(chunk)
        self[chunk] = out
        return out

    #: str.split() also splits at these controls, which are no white space to the tokenizer.
    CONTROLS = re.compile("[\x1c-\x1f]")

    def encode(self, text: str) -> bytes:
        if self.CONTROLS.search(text):
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def chunk_tokens(vocabulary: str) -> ChunkTokens:
    """One per Python worker, kept between its tasks."""
    return ChunkTokens(vocabulary)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: one row per piece, with its token ids if asked for, the task that made it and its
    number among the task's pieces of its length.  Write it before use: both hold for one run only."""
    width = 4 * capacity
    fields = [*PIECE, ("task", T.IntegerType()), ("within", T.LongType()), *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        tokens, task, seen = chunk_tokens(vocabulary), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = tokens.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    length = len(part) // 4
                    row = (doc_id, piece, at // 4, length, zlib.crc32(part), task, seen[length])
                    seen[length] += 1
                    rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class TightestFit:
    """Segment tree over remaining capacities: the smallest one at or above a need that is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, need: int) -> int | None:
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:  # climb to the first open right-hand neighbour, then go down to its left-most leaf
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Steps (length, first rank, first sequence, pieces per sequence, first offset) of best fit
    decreasing over ``counts`` pieces per length, ordered by length and rank."""
    tree = TightestFit(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    steps, sequences = [], 0

    def opened(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            runs.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                first, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            take = min(left, n * each)
            full, rest = divmod(take, each)
            steps.append((length, rank, first, each, capacity - remaining))
            opened(remaining - each * length, first, full)
            opened(remaining - rest * length, first + full, 1 if rest else 0)
            used = full + (1 if rest else 0)
            opened(remaining, first + used, n - used)
            rank += take
            left -= take
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


#: Counts per (length, task) that are broadcast at most; beyond, they are joined by a shuffle.
START_ROWS = 500_000


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to written pieces of :func:`pieces_of`.  The pieces do not
    move: each knows its number in its task, and the tasks' counts give where the task begins."""
    counts = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "pack")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(lengths, capacity)
    keys = (plan[:, 0] << 48) + plan[:, 1]

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    if counts.count() <= START_ROWS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.drop("task", "before", "within")

    def place(length, rank):
        length, rank = np.array(length, np.int64), np.array(rank, np.int64)
        step = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
        nth = rank - step[:, 1]
        return {"sequence_id": step[:, 2] + nth // step[:, 3], "offset": step[:, 4] + nth % step[:, 3] * length}

    return append_columns(ranked, place, [("sequence_id", T.LongType()), ("offset", T.LongType())],
                          ["length", "rank"]).drop("rank")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry their ids: (sequence_id, ids, pieces).
    A group holds one sequence, so at most ``capacity`` ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    out = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return out.select("sequence_id", F.flatten("rows.ids").alias("ids"),
                      F.transform("rows", lambda r: r.dropFields("ids")).alias("pieces"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
                   with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents (doc_id, text): one row per piece with its place."""
    pieces = materialise(pieces_of(documents_of(docs), capacity, vocabulary, with_ids), "pieces")
    return pack(pieces, capacity)


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces with their token ids."""
    return pack_documents(docs, with_ids=True).select(*COLUMNS, "ids")
