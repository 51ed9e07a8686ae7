"""Quality rules by distribution divergence.

Fixed base rules (too few words, too many repeated three-word windows) come first.  The method
then compares each document's character-class histogram and common-word histogram with the
reference of its language by Jensen-Shannon distance (base 2, so 0 to 1).  References are exact
sums over all documents of a language that pass the base rules, hot languages pre-aggregated in their tasks.  A document
with too few words carries too little evidence for a histogram and is left to the base rules.

The limit of the word distance follows from the reference: a share of the distance that a text
without any common word has, plus what the draw of so few words adds to a clean text's distance.

Four languages have listed common words; those of any other language that carries enough documents are
counted from the data.  The query writes measured rows to the shared folder, sums the references from
them, and computes the distances from both.

Defined cases: null text has no words and fails the base rules; a null language, or one with too few
documents, has no reference and is left to the base rules; an empty table
gives an empty result; repeated rows are judged alike.
"""
from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, append_columns, map_batches, materialise, utf8

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?\"'()[]«»„“”…-"
CLASSES = ("lower", "upper", "caseless", "mark", "digit", "space", "stop", "punctuation", "symbol", "other")

#: Common words per language (parameter of the operator): function words in rough order of frequency.
COMMON_WORDS = {
    "en": "the of and to a in is that it on for was with as be this by at are from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class number of every code point of the basic plane; the planes above are ``other``."""
    by = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Nd": 4, "Nl": 4, "No": 4, "Zs": 5, "Zl": 5, "Zp": 5}
    table = np.full(65537, 9, np.uint8)
    for c in range(65536):
        ch = chr(c)
        kind = unicodedata.category(ch)
        table[c] = (5 if ch in WHITE else 8 if ch in SYMBOLS or kind[0] == "S" else 6 if ch in ".,;:!?" else
                    7 if kind[0] == "P" else 3 if kind[0] == "M" else by.get(kind, 9))
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.bincount(class_table()[np.minimum(points, 65536)], minlength=len(CLASSES))


def repeated_words(first: np.ndarray) -> int:
    """Words inside a three-word window that occurs twice or more.  ``first``: for every word the
    place of its first occurrence, which numbers equal words alike."""
    n = len(first)
    if n < 4:
        return 0
    pair = first[:-2] * n + first[1:-1]
    if n > 2_000_000:  # keep the triple code within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair * n + first[2:]
    if not np.any(np.diff(np.sort(code)) == 0):
        return 0
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def spellings(words: list[str]) -> dict[bytes, int]:
    """Slot of each spelling that counts as a common word: lower, title or upper case, alone or
    followed by one sentence mark."""
    return {utf8(form + mark): i for i, w in enumerate(words) for form in (w, w.capitalize(), w.upper())
            for mark in ("", *".,;:!?")}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, base 2; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


def word_limit(reference: np.ndarray, n: int, share: float) -> float:
    """Word distance above which a text of ``n`` words goes.  Squared distances add: ``share`` of the
    distance without any common word, and 1.2 times the mean that a text drawn from the reference has.  A
    common word adds (1 - p) / (8 n ln 2) to that mean, and never more than half its own share p."""
    if not reference.sum():
        return 1.0
    none = np.zeros(len(reference))
    none[-1] = 1
    p = reference / reference.sum()
    drawn = np.minimum((1 - p) / (8 * n * np.log(2)), p / 2).sum()
    return float(((share * js_distance(none, reference)) ** 2 + 1.2 * drawn) ** 0.5)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: A language outside the listed ones is judged if it has so many documents, and this share of all: the
#: number of such languages is bounded, as what reaches the driver is.
LANGUAGE_ROWS, LANGUAGE_SHARE = 200, 1e-4
#: Common words taken from the data for such a language.
TOP_WORDS = 40


def usable() -> Column:
    """Documents past the base rules: the only ones that make references."""
    return (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))


def words_in_data(docs: DataFrame, listed: dict[str, str] = COMMON_WORDS) -> dict[str, str]:
    """The ``TOP_WORDS`` most frequent words, in lower case and without marks, of each language of ``docs``
    (lang, text) that is not listed and has enough documents.  No text is read when there is none."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    floor = max(LANGUAGE_ROWS, int(total * LANGUAGE_SHARE))
    langs = [r["lang"] for r in sizes.filter((F.col("n") >= floor) & F.col("lang").isNotNull() & ~F.col("lang").isin(list(listed))).collect()]
    if not langs:
        return {}

    def run(names, texts):
        seen: dict[str, Counter] = {}
        for lang, text in zip(names, texts):
            words = (text or "").lower().split()
            if len(words) >= MIN_WORDS:
                seen.setdefault(lang, Counter()).update({w.strip(MARKS) for w in words} - {""})
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield dict(zip(("lang", "word", "n"), zip(*rows))) if rows else {"lang": [], "word": [], "n": []}

    some = docs.filter(F.col("lang").isin(langs))
    counts = map_batches(some, run, [("lang", T.StringType()), ("word", T.StringType()), ("n", T.LongType())], ["lang", "text"])
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    found: dict[str, list[str]] = {}
    for r in counts.withColumn("top", top).filter(F.col("top") <= TOP_WORDS).orderBy("lang", "top").collect():
        found.setdefault(r["lang"], []).append(r["word"])
    return {lang: " ".join(words) for lang, words in found.items()}


def measurer(common_words: dict[str, str]) -> Callable[[list, list], dict]:
    """Base metrics and both histograms of a batch of languages and texts."""
    forms = {lang: spellings(words.split()) for lang, words in common_words.items()}
    widths = {lang: len(words.split()) + 1 for lang, words in common_words.items()}

    def run(langs, texts):
        out = {n: [] for n in (*BASE, "q_classes", "q_words")}
        for lang, text in zip(langs, texts):
            text = text or ""
            words = utf8(text).split()
            n = len(words)
            first_of: dict[bytes, int] = {}
            first = np.fromiter(map(first_of.setdefault, words, range(n)), np.int64, n)
            lines = [x for x in text.split("\n") if x.strip(WHITE)]
            times = np.bincount(first, minlength=n)
            seen = np.zeros(widths.get(lang, 0), np.int64)
            for form in forms.get(lang, {}).keys() & first_of.keys():
                seen[forms[lang][form]] += times[first_of[form]]
            seen[-1:] = n - seen[:-1].sum()
            for name, v in zip(out, (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
                                     len(lines) - len(set(lines)), repeated_words(first), class_counts(text), seen)):
                out[name].append(v)
        return out

    return run


def measure(df: DataFrame, common_words: dict[str, str] = COMMON_WORDS) -> DataFrame:
    """Append the base metrics and both histograms (``q_classes``; ``q_words``: the common words of the
    document's language one by one, the last entry all other words; empty for other languages) to
    documents with ``lang`` and ``text``; no row moves."""
    counts = T.ArrayType(T.LongType())
    return append_columns(df, measurer(common_words), [*((n, T.LongType()) for n in BASE), ("q_classes", counts), ("q_words", counts)],
                          ["lang", "text"])


def references(measured: DataFrame, common_words: dict[str, str] = COMMON_WORDS) -> dict:
    """Both histograms per language of ``common_words``, summed over all its usable documents.  One row
    per language reaches the driver."""
    words = {lang: len(w.split()) + 1 for lang, w in common_words.items()}
    width = {"q_classes": len(CLASSES), "q_words": max(words.values(), default=1)}
    sums = [F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for c, n in width.items() for i in range(n)]
    rows = measured.filter(usable() & F.col("lang").isin(list(common_words))).groupBy("lang").agg(*sums).collect()
    return {r["lang"]: {c: np.array([r[f"{c}{i}"] or 0 for i in range(n)], float)
                        for c, n in (("q_classes", len(CLASSES)), ("q_words", words[r["lang"]]))} for r in rows}


JUDGED = [("js_class", T.DoubleType()), ("js_word", T.DoubleType()), ("base_failed", T.BooleanType()),
          ("kept", T.BooleanType())]


def judge_of(refs: dict, max_class: float = 0.30, word_share: float = 0.6, min_words: int = MIN_WORDS) -> Callable[..., dict]:
    """Distances and verdicts of a batch of measured documents; see :func:`judge`."""
    def run(langs, n_words, repeated, classes, words):
        out = {n: [] for n, _ in JUDGED}
        for lang, n, again, c, w in zip(langs, n_words, repeated, classes, words):
            failed = n < MIN_WORDS or 100 * again > 50 * n
            js_class = js_word = None
            kept = not failed
            if n >= min_words and lang in refs:
                ref = refs[lang]
                js_class = round(js_distance(np.array(c), ref["q_classes"]), 6)
                js_word = round(js_distance(np.array(w), ref["q_words"]), 6)
                kept = kept and js_class <= max_class and js_word <= word_limit(ref["q_words"], n, word_share)
            for field, v in zip(out, (js_class, js_word, failed, kept)):
                out[field].append(v)
        return out

    return run


def judge(measured: DataFrame, refs: dict, **limits) -> DataFrame:
    """Append both distances, ``base_failed`` and ``kept`` to measured documents.  Of the limits, ``min_words``
    is the length guard of the distances, ``max_class`` the largest class distance, ``word_share`` the share
    of :func:`word_limit`.  Documents whose language has no reference are left to the base rules, their
    distances are null."""
    return append_columns(measured, judge_of(refs, **limits), JUDGED, ["lang", "n_words", "n_repeat_words", "q_classes", "q_words"])


def typed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})


def op9_quality_divergence(spark, sf_dir: str) -> DataFrame:
    docs = typed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "lang", "text")
    words = COMMON_WORDS | words_in_data(docs)
    measured = materialise(measure(docs, words).drop("text"), "quality")
    return judge(measured, references(measured, words)).select("doc_id", *BASE, *(n for n, _ in JUDGED))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; the columns of documents stay.  The references take one
    pass and the verdicts another, so no copy of the corpus is written between them."""
    other = {c: f"row{i}" for i, c in enumerate(docs.columns) if c not in ("lang", "text")}  # no name can clash
    rows = typed(docs).select("lang", "text", *(F.col(c).alias(n) for c, n in other.items()))
    words = COMMON_WORDS | words_in_data(typed(docs))
    refs = references(measure(typed(docs).select("lang", "text"), words), words)
    measured, verdict = measurer(words), judge_of(refs)

    def run(langs, texts):
        m = measured(langs, texts)
        return {"kept": verdict(langs, m["n_words"], m["n_repeat_words"], m["q_classes"], m["q_words"])["kept"]}

    judged = append_columns(rows, run, [("kept", T.BooleanType())], ["lang", "text"]).filter("kept")
    return judged.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))
