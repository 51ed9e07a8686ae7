"""Language-model scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

1. Words of the training documents are counted; the table (128-bit name, bucket, n) stays distributed.
   The ``HEAD`` most frequent words reach every task as a fixed-size table; all others are looked up by a
   join per distinct (document, word).
2. The model predicts symbols.  The ``OWN`` most frequent words are symbols of their own; every other
   word, known or not, belongs to one of ``BUCKETS`` symbols by its last two bytes.  Within a bucket a word
   has probability (c + 1) / (N + V + 1): c its count, N all counts, V the distinct words, so an unknown
   word keeps a share and all probabilities of a context sum to one.
3. Log-bilinear: the vectors of the last ``CONTEXT`` symbols, each times the matrix of its place, add up to
   a prediction; its product with a symbol's output vector plus a bias is that symbol's score.
4. Noise-contrastive estimation: true symbols against ``NOISE`` shared draws from the unigram.  A fit sets out
   from the unigram and takes ``FIT_PASSES`` rounds and a slower one.  In a round every task goes over all
   its training documents from the model of the round before, and the results are averaged by tokens.
5. Scores are normalised: softmax over all symbols by one matrix product per block of tokens.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as empty text in the fold;
without training documents both scores follow the formula with N = V = 0 (score 0 for base, the
model untrained); repeated rows are scored once each; other columns are not read.
"""
from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, documents_of, materialise, utf8

FOLDS, HELD_OUT = 7, 2
END = b""
OWN, BUCKETS, HEAD = 256, 96, 1 << 18
CONTEXT, WIDTH, NOISE = 3, 24, 32
#: Distinct words a task counts before it hands them on.
TOLD = 400_000
#: Tokens of a training step, contexts of a scoring block (whose scores stay in the processor's cache).
STEP, BLOCK = 2048, 512


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with ASCII letters in lower case, then the end."""
    words = utf8(text or "").lower().split()
    words.append(END)
    return words


def name_of(word: bytes) -> bytes:
    return xxhash.xxh3_128_digest(word)


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def folds(docs: DataFrame) -> DataFrame:
    """Documents with ``held_out``."""
    docs = documents_of(docs)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn("held_out", F.crc32(key) % FOLDS == HELD_OUT)


# -- counts ------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(name, bucket, n) of all words of documents."""
    bounded_batches(docs.sparkSession)

    def told(seen: Counter):
        words = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(map(name_of, words), pa.binary()), pa.array(map(bucket_of, words), pa.int32()),
             pa.array(seen.values(), pa.int64())], ["name", "bucket", "n"])

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
                if len(seen) > TOLD:
                    yield told(seen)
                    seen.clear()
        yield told(seen)

    parts = docs.select("text").mapInArrow(run, "name binary, bucket int, n long")
    return parts.groupBy("name", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The fixed-size part of the counts: names and counts of the head words from the most frequent on,
    the symbols' unigram counts, and per bucket N + V + 1."""
    tokens: int
    types: int
    names: bytes
    counts: np.ndarray
    symbol_counts: np.ndarray
    bucket_size: np.ndarray


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals, ``BUCKETS`` sums and the head reach the driver: the words from the count on above which
    there are at most ``HEAD``, found by a histogram of counts in 64ths of an octave."""
    octave = F.floor(64 * F.log2(F.col("n"))).cast("int")
    sums = {r["bucket"]: r for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    steps = sorted((r["o"], r["v"]) for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("v")).collect())
    room, cut = HEAD, 1 << 30
    for o, v in reversed(steps):
        room -= v
        if room < 0:
            break
        cut = o
    head = counts.filter(octave >= cut).toPandas().sort_values(["n", "name"], ascending=[False, True], kind="stable")
    n = np.array([sums[b]["n"] if b in sums else 0 for b in range(BUCKETS)], np.int64)
    v = np.array([sums[b]["v"] if b in sums else 0 for b in range(BUCKETS)], np.int64)
    tokens, types = int(n.sum()), int(v.sum())
    own = head.head(OWN)
    np.subtract.at(n, own["bucket"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
    np.subtract.at(v, own["bucket"].to_numpy(np.int64), 1)
    symbols = np.zeros(OWN + BUCKETS, np.int64)
    symbols[:len(own)] = own["n"]
    symbols[OWN:] = n
    return Lexicon(tokens, types, b"".join(head["name"]), head["n"].to_numpy(np.int64), symbols, n + v + 1)


class Codes(dict):
    """Word -> its place in the head, or -1 - bucket of a word outside it; bounded."""

    def __init__(self, lex: Lexicon):
        super().__init__()
        self.head = {lex.names[i:i + 16]: i // 16 for i in range(0, len(lex.names), 16)}

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        code = self.head.get(name_of(word))
        if code is None:
            code = -1 - bucket_of(word)
        elif code >= OWN:
            code = (code << 8) + bucket_of(word)  # the bucket of a head word without a symbol of its own
        self[word] = code
        return code

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, places in the head or -1) of words."""
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        wide = code >= OWN << 8
        symbol = np.where(code < 0, OWN - 1 - code, np.where(wide, OWN + (code & 255), code))
        return symbol.astype(np.int16), np.where(code < 0, -1, np.where(wide, code >> 8, code))


@lru_cache(maxsize=1)
def _codes(key: int) -> list:
    return []


def codes_of(lex: Lexicon) -> Codes:
    """One per Python worker and lexicon, kept between its tasks."""
    kept = _codes(xxhash.xxh3_64_intdigest(lex.names) ^ lex.tokens)
    if not kept:
        kept.append(Codes(lex))
    return kept[0]


# -- the model ---------------------------------------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def row_sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by their index ``at`` (16 bits: sorted by radix)."""
    order = at.argsort(kind="stable")
    at = at.take(order)
    first = np.flatnonzero(at[1:] != at[:-1])
    first = np.concatenate([[0], first + 1])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[at.take(first)] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


class LogBilinear:
    """Input vectors (the last row stands before a text), a matrix per place, output vectors and biases."""

    def __init__(self, symbol_counts: np.ndarray, seed: int = 12):
        rng = np.random.default_rng(seed)
        size = len(symbol_counts)
        p = (symbol_counts + 1.0) / (symbol_counts + 1.0).sum()
        self.log_noise = np.log(p * NOISE).astype(np.float32)
        self.cumulative = np.cumsum(p)
        #: Own symbols that no word has, in a vocabulary of fewer words.
        self.unused = np.flatnonzero(symbol_counts[:OWN] == 0)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.parameters = [draw(size + 1, WIDTH), np.stack([np.eye(WIDTH, dtype=np.float32) * 0.5] * CONTEXT),
                           draw(size, WIDTH), np.log(p).astype(np.float32)[:, None]]
        self.squares = [np.full_like(x, 1e-2) for x in self.parameters]

    @property
    def size(self) -> int:
        return len(self.log_noise)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.parameters, *self.squares)])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at, out = 0, []
        for x in (*self.parameters, *self.squares):
            out.append(np.asarray(flat[at:at + x.size], np.float32).reshape(x.shape))
            at += x.size
        self.parameters, self.squares = out[:4], out[4:]
        return self

    def contexts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, tokens) of the symbols before each token, and the tokens, of all texts."""
        pad = np.full(CONTEXT, self.size, np.int16)
        line = np.concatenate([x for t in texts for x in (pad, t)])
        at = np.flatnonzero(line != self.size)
        return np.stack([line[at - i - 1] for i in range(CONTEXT)]), line[at]

    def learn(self, before: np.ndarray, target: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One step of noise-contrastive estimation with scaled gradients (sums of squares per value)."""
        r, c, q, b = self.parameters
        n = len(target)
        guess = np.empty((n, WIDTH + 1), np.float32)  # ends in 1, which meets the bias
        total = (r @ c[0]).take(before[0], 0)
        for w, m in zip(before[1:], c[1:]):
            total += (r @ m).take(w, 0)
        guess[:, :-1], guess[:, -1] = total, 1
        noise = np.searchsorted(self.cumulative, rng.random(NOISE) * self.cumulative[-1])
        out, drawn = q.take(target, 0), q[noise]
        above = b[:, 0] - self.log_noise
        up = 1 - sigmoid(np.einsum("ij,ij->i", total, out) + above.take(target))
        down = guess @ -np.column_stack([drawn, above[noise]]).T
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        toward = down @ drawn
        out *= up[:, None]
        toward += out
        ends = np.concatenate([target, noise.astype(np.int16)])
        side = np.empty((n + NOISE, WIDTH + 1), np.float32)
        np.multiply(guess, up[:, None], out=side[:n])
        np.matmul(down.T, guess, out=side[n:])
        side = row_sums(ends, side, self.size)
        # by symbol and place first: the products with r and c then have a row per symbol, not per token
        places = [row_sums(w, toward, self.size + 1) for w in before]
        gradients = [sum(x @ m.T for x, m in zip(places, c)), np.stack([r.T @ x for x in places]), side[:, :-1], side[:, -1:]]
        for value, square, g in zip(self.parameters, self.squares, gradients):
            g /= max(n, STEP // 2)
            square += g * g
            g *= rate
            g /= np.sqrt(square)
            value += g

    def learn_texts(self, texts: list[np.ndarray], rng: np.random.Generator, rate: float) -> int:
        """All tokens of texts once; a step takes tokens evenly spaced over all of them."""
        before, target = self.contexts(texts)
        apart = max(1, len(target) // STEP)
        each = len(target) // apart
        line = np.vstack([before, target])
        spread = np.ascontiguousarray(line[:, :apart * each].reshape(CONTEXT + 1, each, apart).transpose(2, 0, 1))
        for k in rng.permutation(apart):
            self.learn(spread[k, :-1], spread[k, -1], rng, rate)
        if apart * each < len(target):
            rest = line[:, apart * each:]
            self.learn(rest[:-1], rest[-1], rng, rate)
        return len(target)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of every token's symbol, normalised over all symbols; the scores of all symbols
        depend on the context alone and are made once for each that occurs."""
        r, c, q, b = self.parameters
        placed = [r @ m for m in c]
        before, target = self.contexts(texts)
        key = np.zeros(len(target), np.int64)
        for w in before:
            key *= self.size + 1
            key += w
        order = key.argsort(kind="stable")
        key = key.take(order)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]) if len(key) else key)
        each = before.take(order.take(start), 1)
        start = np.append(start, len(key))
        target = target.take(order)
        q = np.column_stack([q, b])  # a prediction ends in 1, which meets the bias
        q[self.unused] = 0
        q[self.unused, -1] = -80
        reach = np.linalg.norm(q[:, :-1], axis=1).max()
        low = np.abs(b).max()
        out = np.empty(len(target))
        guess, score = (np.ones((BLOCK, n), np.float32) for n in (WIDTH + 1, self.size))
        ones = np.ones(self.size, np.float32)
        for k in range(0, each.shape[1], BLOCK):
            g = guess[:each.shape[1] - k]
            g[:, :-1] = sum(x.take(w, 0) for x, w in zip(placed, each[:, k:k + BLOCK]))
            s = np.matmul(g, q.T, out=score[:len(g)])
            own = start[k:k + len(g) + 1]
            at = np.repeat(np.arange(len(g)), np.diff(own))
            mine = s[at, target[own[0]:own[-1]]]
            if reach * np.linalg.norm(g[:, :-1], axis=1).max() + low > 80:  # near the range of exp
                top = s.max(1, keepdims=True)
                s -= top
                mine = mine - top[at, 0]
            np.exp(s, out=s)
            out[order[own[0]:own[-1]]] = mine - np.log(s @ ones).take(at)
        return out / np.log(10)


# -- fit over the documents --------------------------------------------------

RATE, LATER_RATE = 0.1, 0.05
FIT_PASSES = 3
#: Pieces of the parameters and sums of squares that are averaged apart from each other.
PIECES = 16


def symbols_in(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Symbols of each text of a batch of column ``symbols``."""
    return [np.frombuffer(x, np.int16) for x in batch.column(0).to_pylist()]


def fit(docs: DataFrame, counts: DataFrame | None = None) -> tuple[Lexicon, LogBilinear]:
    """Lexicon and model of training documents (doc_id, text)."""
    counts = word_counts(docs) if counts is None else counts
    lex = lexicon(counts)
    return lex, learned(coded(docs, lex), lex)


def learned(train: DataFrame, lex: Lexicon) -> LogBilinear:
    """Model of coded training documents: ``FIT_PASSES`` rounds at ``RATE``, one at ``LATER_RATE``, each over all."""
    model = LogBilinear(lex.symbol_counts)
    for seed, rate in enumerate([RATE] * FIT_PASSES + [LATER_RATE], 1):
        model = learned_once(train, model, lex.symbol_counts, rate, seed)
    return model


def learned_once(train: DataFrame, model: LogBilinear, symbol_counts: np.ndarray, rate: float, seed: int) -> LogBilinear:
    """One round.  Every task learns from all its documents, and what the tasks have learned, sums of
    squares among it, is averaged by their tokens; per task one row of ``PIECES`` pieces."""
    bounded_batches(train.sparkSession)
    flat = model.flat()

    def learn(batches):
        own, rng, seen = LogBilinear(symbol_counts).load(flat.copy()), np.random.default_rng(seed), 0
        for b in batches:
            texts = symbols_in(b)
            seen += own.learn_texts(texts, rng, rate) if texts else 0
        if seen:
            pieces = np.array_split(own.flat().astype(np.float64) * seen, PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()),
                                              pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "seen", "total"])

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for piece, seen, total in zip(*(c.to_pylist() for c in b.columns)):
                held = sums.setdefault(piece, [0, 0.0])
                held[0] += seen
                held[1] = held[1] + np.frombuffer(total)
        for piece, (seen, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(total / seen).tobytes()], pa.binary())],
                                             ["piece", "mean"])

    parts = train.select("symbols").mapInArrow(learn, "piece int, seen long, total binary")
    means = parts.repartition(PIECES, "piece").mapInArrow(add, "piece int, mean binary").collect()
    if not means:
        return model
    return model.load(np.concatenate([np.frombuffer(r["mean"]) for r in sorted(means, key=lambda r: r["piece"])]))


# -- scores ------------------------------------------------------------------

CODED = [("n_tokens", T.LongType()), ("known", T.LongType()), ("logs", T.DoubleType()), ("partial", T.DoubleType()),
         ("rare", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.IntegerType())), ("symbols", T.BinaryType())]


def coded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Append to documents, in place of the text, what needs no more than the lexicon: known head words and the
    sum of their log10(c + 1), the share of the words within their buckets up to the counts of words outside
    the head, those words, and the symbols, two bytes each.  Fit and scores read the symbols, so a text is
    split and looked up once."""
    log_bucket, log_count = np.log10(lex.bucket_size), np.log10(lex.counts + 1.0)

    def run(texts):
        codes = codes_of(lex)
        out = {n: [] for n, _ in CODED}
        for t in texts:
            words = words_of(t)
            symbol, place = codes.encode(words)
            head = place[place >= 0]
            rare = Counter(words[i] for i in np.flatnonzero(place < 0))
            # an own symbol is its word; in a bucket the word's count goes by the size of the bucket
            within = log_count[head[head >= OWN]].sum() - log_bucket[symbol[symbol >= OWN] - OWN].sum()
            for name, v in zip(out, (len(words), len(head), float(log_count[head].sum()), float(within),
                                     list(map(name_of, rare)), list(rare.values()), symbol.tobytes())):
                out[name].append(v)
        return out

    return append_columns(docs, run, CODED, ["text"]).drop("text")


def scored(docs: DataFrame, lex: Lexicon, model: LogBilinear) -> DataFrame:
    """Coded documents with ``partial``, the score up to the counts of words outside the head; no symbols."""
    flat, symbol_counts = model.flat(), lex.symbol_counts

    def run(partial, texts):
        if not texts:
            return {"partial": []}
        symbols = [np.frombuffer(x, np.int16) for x in texts]
        logs = LogBilinear(symbol_counts).load(flat).log10(symbols)
        ends = np.cumsum([0, *(len(s) for s in symbols[:-1])])
        return {"partial": (np.array(partial) + np.add.reduceat(logs, ends)).tolist()}

    return append_columns(docs, run, [("partial", T.DoubleType())], ["partial", "symbols"]).drop("symbols")


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: LogBilinear) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents with ``held_out``,
    whole or coded."""
    if "symbols" not in docs.columns:
        docs = materialise(coded(docs.select("doc_id", "held_out", "text"), lex).withColumn("at", F.monotonically_increasing_id()), "coded")
    found = materialise(scored(docs.drop("rare", "times"), lex, model), "scored")
    rare = docs.select("at", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("at", F.col("w.rare").alias("name"), F.col("w.times").alias("times"))
    rare = rare.join(counts.select("name", "n"), "name").groupBy("at").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    all_of = found.join(rare, "at", "left")
    more = F.coalesce("more", F.lit(0.0))
    return all_of.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(lex.tokens + lex.types + 1))).alias("base_score"),
        (F.col("partial") + more).alias("score"))


def language_model(docs: DataFrame) -> DataFrame:
    """Learn from the documents not held out, score all."""
    docs = folds(docs)
    counts = materialise(word_counts(docs.filter(~F.col("held_out"))), "words")
    lex = lexicon(counts)
    table = coded(docs.select("doc_id", "held_out", "text"), lex).withColumn("at", F.monotonically_increasing_id())
    table = materialise(table, "coded")
    return score(table, counts, lex, learned(table.filter(~F.col("held_out")), lex))


def op12_lm_scores(spark, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
