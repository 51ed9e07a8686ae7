"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet as log probabilities per language: the likelihood of the whole text
under character-trigram models, the language a page's markup declares, its address suffix (top
level and a two-letter path prefix), and a prior of its host.  How far declarations and suffixes
are to be believed, and the host priors, are counted over the whole corpus by grouped aggregation
of the text-only verdicts; host priors are smoothed towards their domain's and those towards the
corpus', and leave the row itself out.

The trigram models are fitted on a bounded sample of labelled documents: about ``per_language``
distinct texts of each language, chosen by hash, so a rare language is sampled as densely as it needs
and a group of copies counts as one text.  All labels are languages; everything else covers all rows.
Documents take their ``source`` as host and declare nothing.

The driver and each task hold one row of numbers per trigram seen in the sample (at most 64 ** 3) and
one number per language in it, so labels must be language codes, not free text.

Defined cases: a row without letters, declaration and host is ``und`` with confidence 0; null
columns are missing evidence; with no labelled rows every row is ``und``; repeated rows count each.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, materialise, release

K = 64
HIDDEN = re.compile(r"<(script|style)\b", re.I)
CLOSING = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style")}
DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)


def letter_table() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, a to z, accented Latin letters by code, and
    one to a few classes per other script."""
    table = np.zeros(65537, np.uint8)
    for c in range(65536):
        ch = chr(c).lower()[:1]
        if not ch.isalpha():
            continue
        o = ord(ch)
        table[c] = (o - 96 if 97 <= o < 123 else 27 + o % 24 if o < 0x250 else 51 + o % 3 if o < 0x400 else
                    54 + o % 3 if o < 0x530 else 57 if 0x590 <= o < 0x600 else 58 if 0x600 <= o < 0x780 else
                    59 if 0x900 <= o < 0xE00 else 60 if 0x3040 <= o < 0x3100 else 61 if 0xAC00 <= o < 0xD7B0 else
                    62 if 0x4E00 <= o < 0xA000 else 63)
    table[65536] = 63
    return table


_table: list[np.ndarray] = []


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all trigrams of a text; runs of other characters count as one break."""
    if not _table:
        _table.append(letter_table())
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    m = np.concatenate(([0], _table[0][np.minimum(points, 65536)], [0])).astype(np.int64)
    m = m[np.append(True, (m[1:] != 0) | (m[:-1] != 0))]
    return m[:-2] * K * K + m[1:-1] * K + m[2:] if len(m) > 2 else np.empty(0, np.int64)


class Trigrams(NamedTuple):
    """Log likelihoods: ``scores[row[code]]`` has one per language; row 0 is for unseen trigrams."""
    row: np.ndarray
    scores: np.ndarray


def fit_trigrams(labelled: DataFrame, per_language: int = 1000) -> tuple[list[str], Trigrams]:
    """(languages, model) from a sample of rows (lang, text) whose expected size is ``per_language``
    distinct texts of each language."""
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    steps = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).select(
        "lang", F.greatest(F.lit(1), F.floor(F.col("n") / per_language)).cast("long").alias("step"))
    steps = materialise(steps, "steps")
    langs = sorted(r["lang"] for r in steps.select("lang").collect())
    if not langs:
        return [], Trigrams(np.zeros(K ** 3, np.int32), np.zeros((1, 0), np.float32))
    sample = labelled.join(steps, "lang").filter(F.pmod("h", "step") == 0).select("lang", "text").distinct()
    bounded_batches(labelled.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=K ** 3)
            for lang, n in sums.items():
                codes = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)),
                                                  pa.array(n[codes].astype(np.int64))], schema=schema)

    sums = sample.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    seen, at = np.unique(sums["code"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(seen) + 1, len(langs)))
    counts[at + 1, np.searchsorted(np.array(langs), sums["lang"].to_numpy(str))] = sums["n"]
    row = np.zeros(K ** 3, np.int32)
    row[seen] = np.arange(1, len(seen) + 1)
    release(steps)
    return langs, Trigrams(row, np.log((counts + 0.1) / (counts.sum(0) + 0.1 * K ** 3)).astype(np.float32))


def outside_markup(page: str) -> Iterator[str]:
    """What stands between tags, comments, scripts and styles, in time linear in the page: an end that was
    not found once is not looked for again."""
    at, start, missing = 0, 0, set()
    while (start := page.find("<", start)) >= 0:
        end = -1
        if (m := HIDDEN.match(page, start)) and (name := m[1].lower()) not in missing:
            close = CLOSING[name].search(page, m.end())
            end = close.end() if close else -1
            if end < 0:
                missing.add(name)
        if end < 0 and page.startswith("<!--", start) and "-->" not in missing:
            end = page.find("-->", start + 4) + 3
            if end < 3:
                missing.add("-->")
                end = -1
        if end < 0:
            end = page.find(">", start) + 1
            if not end:
                break
        yield page[at:start]
        at = start = end
    yield page[at:]


def visible(page: str | None) -> str:
    return html.unescape(" ".join(outside_markup(page or "")))


EVIDENCE = [("e_first", T.IntegerType()), ("e_n", T.LongType()), ("e_text", T.ArrayType(T.DoubleType())),
            ("declared", T.StringType())]


def likelihoods(model: Trigrams, codes: np.ndarray) -> np.ndarray:
    """Mean log likelihood of a text's trigrams per language; memory follows its distinct trigrams."""
    rows, times = np.unique(model.row[codes], return_counts=True)
    return times @ model.scores[rows].astype(np.float64) / len(codes)


def text_evidence(rows: DataFrame, langs: list[str], model: Trigrams, is_html: bool, weight: float = 1 / 3,
                  most: int = 120) -> DataFrame:
    """Append per-language log likelihoods of the whole ``text``, its trigrams, the text-only verdict
    and the declared language.  Neighbouring trigrams overlap, so a text counts as ``weight`` of its
    trigrams, at most ``most`` of them."""

    def run(texts):
        out = {n: [] for n, _ in EVIDENCE}
        for text in texts:
            m = DECLARED.search(text) if is_html and text else None
            codes = trigrams(visible(text) if is_html else text)
            n = len(codes)
            mean = likelihoods(model, codes) if n and langs else np.zeros(len(langs))
            out["e_first"].append(int(mean.argmax()) if n >= 20 and langs else None)
            out["e_n"].append(n)
            out["e_text"].append(mean * min(weight * n, most))
            out["declared"].append(m[1].lower() if m else None)
        return out

    return append_columns(rows, run, EVIDENCE, ["text"])


def per_language(n_langs: int):
    """Text-only verdicts per language, as an array of counts."""
    return F.array(*(F.count(F.when(F.col("e_first") == i, 1)) for i in range(n_langs)))


def believed(rows: DataFrame, column: str, n_langs: int) -> tuple[DataFrame, int]:
    """Verdict counts of every value of a column as a written table (column, c_column), and the number
    of values."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(per_language(n_langs).alias(f"c_{column}"))
    counts = materialise(counts, column)
    return counts, counts.count()


def identify(rows: DataFrame, langs: list[str], strength: float = 5.0) -> DataFrame:
    """Fuse the evidence of materialised rows (host, domain, suffix, declared, e_*): appends ``lang``,
    ``confidence`` and ``text_lang``."""
    n_langs = len(langs)
    if not langs:
        return rows.withColumns({"lang": F.lit("und"), "confidence": F.lit(0.0), "text_lang": F.lit(None).cast("string")})
    whole = np.array(rows.agg(per_language(n_langs).alias("c")).collect()[0]["c"], float)
    prior = (whole + 1) / (whole.sum() + n_langs)
    (declared, n_declared), (suffix, n_suffix) = believed(rows, "declared", n_langs), believed(rows, "suffix", n_langs)

    hosts = rows.filter("host IS NOT NULL").groupBy("host", "domain").agg(per_language(n_langs).alias("c_host"))
    hosts = materialise(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.get("c_host", F.lit(i))) for i in range(n_langs))).alias("c_domain"))
    hosts = materialise(hosts.join(domains, hosts["domain"].eqNullSafe(domains["domain"])).select("host", "c_host", "c_domain"), "hosts")
    joined = rows.join(hosts, "host", "left").join(declared, "declared", "left").join(suffix, "suffix", "left")

    def likelihood(c, n_values: int) -> np.ndarray:
        """log P(value | language) from the value's counts, smoothed towards its share of the corpus."""
        if c is None:
            return np.zeros(n_langs)
        c = np.array(c, float)
        share = (c.sum() + 1) / (whole.sum() + n_values + 2)
        return np.log((c + strength * share) / (whole + strength))

    def run(first, n, text, c_declared, c_suffix, c_host, c_domain):
        out = {"lang": [], "confidence": [], "text_lang": []}
        for f, k, t, d, s, h, m in zip(first, n, text, c_declared, c_suffix, c_host, c_domain):
            own = np.zeros(n_langs)
            if f is not None:
                own[f] = 1  # the row's own verdict is no evidence about its host
            base = prior
            for c in (m, h):
                if c is not None:
                    c = np.maximum(np.array(c, float) - own, 0)
                    base = (c + strength * base) / (c.sum() + strength)
            score = np.array(t) + likelihood(d, n_declared) + likelihood(s, n_suffix) + np.log(base)
            p = np.exp(score - score.max())
            p /= p.sum()
            known = k > 0 or d is not None or h is not None
            best = int(p.argmax())
            out["lang"].append(langs[best] if known else "und")
            out["confidence"].append(round(float(p[best]), 6) if known else 0.0)
            out["text_lang"].append(langs[f] if f is not None else None)
        return out

    new = [("lang", T.StringType()), ("confidence", T.DoubleType()), ("text_lang", T.StringType())]
    return append_columns(joined, run, new, ["e_first", "e_n", "e_text", "c_declared", "c_suffix", "c_host", "c_domain"])


def address_columns(url):
    """host, domain and suffix of an address column."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.when(host.isNotNull(), F.concat_ws("/", top, path))


def language_evidence(documents: DataFrame, pages: DataFrame, langs: list[str], model: Trigrams) -> DataFrame:
    """One row per document and per page with all its evidence."""
    source = F.col("source").cast("string")
    docs = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"),
                            F.lit(None).cast("long").alias("page_id"), source.alias("host"), source.alias("domain"),
                            F.lit(None).cast("string").alias("suffix"), F.col("text").cast("string").alias("text"))
    host, domain, suffix = address_columns(F.col("url").cast("string"))
    web = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"),
                       F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain.alias("domain"),
                       suffix.alias("suffix"), F.col("html").cast("string").alias("text"))
    return text_evidence(docs, langs, model, False).drop("text").unionByName(
        text_evidence(web, langs, model, True).drop("text"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    documents, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    langs, model = fit_trigrams(documents)
    rows = materialise(language_evidence(documents, pages, langs, model), "language")
    return identify(rows, langs).select("kind", "doc_id", "page_id", "lang", "confidence", "text_lang", "declared")
