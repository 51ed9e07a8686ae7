"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from freightline.llm import spelling

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_near(n):
    """All near words, by wildcards and deletions."""
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i], w[i + 1:]].add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= by[w[:i], w[i + 1:]] - {w}
            if (shorter := w[:i] + w[i + 1:]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def brute(n):
    near = brute_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_brute_near_is_every_pair(sample):
    n = brute_counts([(i, t) for i, t, _ in sample])
    words = sorted(n)[:400]
    near = brute_near(dict.fromkeys(words, 9))
    assert all((b in near[a]) == one_edit(a, b) for a in words for b in words if a != b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_variants_of_a_table(spark, sf):
    import duckdb
    path = f"/root/testdata/{sf}"
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    want = brute(brute_counts(docs))
    assert got(spelling.op13_spelling_variants(spark, path)) == want
    assert any(v[0] for v in want.values())


def test_odd_documents(spark, make_docs):
    rows = [(None, "Straße STRASSE straße " * 5, "de"), (1, None, "en"), (2, "", "en"), (3, "×÷ÀÿABCDEF " * 9, None),
            (3, "×÷ÀÿABCDEF " * 9, None), (4, "x" * 20_000 + " ", "en"), (5, "recieve " * 30 + "receive " * 200, "en"),
            *((i, "y" * 9_000 + " " + "y" * 9_001, "en") for i in range(10, 16))]
    want = brute(brute_counts([(i, t) for i, t, _ in rows]))
    assert got(spelling.group_variants(spelling.vocabulary(spelling.slipped_words(make_docs(rows))))) == want
    assert spelling.group_variants(spelling.vocabulary(spelling.slipped_words(make_docs([])))).collect() == []


def test_chunks_shared_by_very_many_words(spark):
    """5,000 words with one first half, and dense neighbourhoods: no key meets with more than its share."""
    rng = random.Random(13)
    tail = lambda k: "".join(rng.choice("abcdé") for _ in range(k))
    n = {"haupt" * 3 + tail(rng.choice((5, 6))): rng.choice((5, 30, 200)) for _ in range(5000)}
    n |= {tail(6): rng.choice((5, 30, 200, 1200)) for _ in range(1500)}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert got(spelling.group_variants(df)) == brute(n)
    pairs = spelling.near_pairs(df, most=1 << 40)
    small = spelling.near_pairs(df, most=4)
    assert sorted(pairs.collect()) == sorted(small.collect())
