"""Language-model scores: counts and base scores against brute force, the model against a plain walk
over tokens with its parameters, held-out accuracy."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freightline.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_base(rows, docs):
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-5)


def walk(text, c, lex, model):
    """Score of one text, token by token, straight from the formula."""
    top = [lex.names[i:i + 16] for i in range(0, len(lex.names), 16)][:lm.OWN]
    r, m, q, b = (x.astype(float) for x in model.parameters)
    line, total = [], 0.0
    for w in tokens(text):
        word = b"" if w is None else w.encode()
        name = lm.name_of(word)
        symbol = top.index(name) if name in top else lm.OWN + zlib.crc32(word[-2:]) % lm.BUCKETS
        before = [line[-i] if len(line) >= i else len(q) for i in range(1, lm.CONTEXT + 1)]
        s = sum(r[x] @ m[i] for i, x in enumerate(before)) @ q.T + b[:, 0]
        s[len(top):lm.OWN] = -np.inf
        p = np.exp(s - s.max())
        total += math.log10(p[symbol] / p.sum())
        if symbol >= lm.OWN:
            total += math.log10((c[w] + 1) / lex.bucket_size[symbol - lm.OWN])
        line.append(symbol)
    return total


@pytest.fixture(scope="module")
def fitted(spark, sf_small):
    docs = lm.folds(spark.read.parquet(f"{sf_small}/documents.parquet"))
    train = docs.filter("NOT held_out")
    counts = lm.materialise(lm.word_counts(train), "words")
    lex, model = lm.fit(train, counts)
    return docs, counts, lex, model


def test_table_scores(fitted, sample):
    docs, counts, lex, model = fitted
    rows = lm.score(docs, counts, lex, model).collect()
    pairs = [(i, t) for i, t, _ in sample]
    check_base(rows, pairs)
    c = Counter(w for i, t in pairs if not held(i) for w in tokens(t))
    by_id = {r.doc_id: r for r in rows}
    short = [(i, t) for i, t in pairs if len(tokens(t)) < 400][:60]
    assert len(short) == 60
    for i, t in short:
        assert by_id[i].score == pytest.approx(walk(t, c, lex, model), rel=1e-4, abs=1e-3)


def test_words_outside_the_head_are_looked_up(spark, sample, monkeypatch, make_docs):
    monkeypatch.setattr(lm, "HEAD", 500)
    docs = make_docs(sample)
    check_base(lm.language_model(docs).collect(), [(i, t) for i, t, _ in sample])


def test_probabilities_of_a_context_sum_to_one(fitted, sample):
    _, counts, lex, model = fitted
    symbol_sum = sum(10 ** model.log10([np.array([5, 9, s])])[2] for s in range(lm.OWN + lm.BUCKETS))
    assert symbol_sum == pytest.approx(1, abs=1e-4)
    per_bucket = Counter()
    top = {lex.names[i:i + 16] for i in range(0, 16 * lm.OWN, 16)}
    for r in counts.collect():
        if bytes(r["name"]) not in top:
            per_bucket[r["bucket"]] += r["n"] + 1
    assert all(per_bucket[b] + 1 == lex.bucket_size[b] for b in range(lm.BUCKETS))  # known words and one unknown


def test_held_out_accuracy(spark):
    """On held-out text the model beats the base by a wide margin, and learning beats the start."""
    docs = lm.folds(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    train = docs.filter("NOT held_out")
    counts = lm.materialise(lm.word_counts(train), "words")
    lex, model = lm.fit(train, counts)
    held_out = docs.filter("held_out")
    mean = lambda m, c: (lambda r: r[0] / r[1])(lm.score(held_out, counts, lex, m).agg({c: "sum", "n_tokens": "sum"})
                                                .selectExpr(f"`sum({c})` AS s", "`sum(n_tokens)` AS n").first())
    base, learned, start = mean(model, "base_score"), mean(model, "score"), mean(lm.LogBilinear(lex.symbol_counts), "score")
    assert learned > base + 0.15 and learned > start + 0.1


def test_odd_rows(spark, make_docs):
    docs = [(None, "a b", "en"), (None, None, "en"), (1, "", None), (1, "", None), (2, "A" * 30_000 + " \x1c é", "en"),
            (3, "x " * 30_000, "en"), (4, "tok\ud800en".encode("utf-8", "replace").decode(), "en")]
    check_base(lm.language_model(make_docs(docs)).collect(), [(i, t) for i, t, _ in docs])
    empty = lm.language_model(make_docs([]))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    only = next(i for i in range(100) if held(i))
    row = lm.language_model(make_docs([(only, "never seen", "en")])).collect()[0]
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and math.isfinite(row.score)


def test_texts_are_split_for_counts_and_codes_only(spark, sf_small, monkeypatch):
    """Fit and scores read the symbols that one pass over the texts has written."""
    calls, split = spark.sparkContext.accumulator(0), lm.words_of

    def counted(text):
        calls.add(1)
        return split(text)

    monkeypatch.setattr(lm, "words_of", counted)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    n, n_held = docs.count(), sum(held(r.doc_id) for r in docs.select("doc_id").collect())
    assert len(lm.language_model(docs).collect()) == n
    assert calls.value == 2 * n - n_held


def test_every_round_learns_from_every_training_document(spark, make_docs, monkeypatch):
    """Each round, not the last alone, meets all documents, however many there are."""
    learnt, read = spark.sparkContext.accumulator(0), lm.symbols_in

    def counted(batch):
        texts = read(batch)
        learnt.add(len(texts))
        return texts

    monkeypatch.setattr(lm, "symbols_in", counted)
    docs = lm.folds(make_docs([(i, f"w{i % 7} x{i % 11} end", "en") for i in range(9000)])).filter("NOT held_out")
    lm.fit(docs)
    assert learnt.value == (lm.FIT_PASSES + 1) * docs.count()
