"""Token counts per section by offset-mapped attribution.

Each whole document is encoded once.  The byte lengths of its tokens give the tokens' spans,
which an interval join (a binary search over the sorted section starts) maps to sections.  A token
that crosses a boundary is allocated by an explicit rule:

* ``majority``: to the section that holds most of its bytes, the earlier one if equal;
* ``start``: to the section in which it starts.

Sections end where the ``boundary`` pattern matches; by default they are the lines of a document,
each with its line end.  They cover the text, so the counts of a document's sections add up to its
tokens.

Defined cases: null or empty text is one empty section without tokens; repeated rows give repeated
results; spans are code points, end exclusive.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_of, map_batches, utf8
from .secrets import byte_vocabulary

SECTION = [("doc_id", T.LongType()), ("section", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()),
           ("n_tokens", T.LongType()), ("n_crossing", T.LongType()), ("doc_tokens", T.LongType())]


def token_lengths(vocabulary: str) -> np.ndarray:
    encoding = byte_vocabulary(vocabulary)
    lengths = np.zeros(encoding.n_vocab, np.int64)
    for token, rank in encoding._mergeable_ranks.items():
        lengths[rank] = len(token)
    return lengths


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether it crosses a boundary.  ``sections``: sorted starts, the first 0."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "majority":
        limits = np.append(sections, np.iinfo(np.int64).max)
        for i in np.flatnonzero(crossing):
            held = [min(ends[i], limits[s + 1]) - max(starts[i], limits[s]) for s in range(first[i], last[i] + 1)]
            first[i] += int(np.argmax(held))
    return first, crossing


def count_tokens(docs: DataFrame, rule: str = "majority", vocabulary: str = "byte_bpe_50k.tiktoken",
                 boundary: bytes = rb"\n") -> DataFrame:
    """One row per section of each document (doc_id, text): its span, its tokens, how many of them
    cross a boundary, and the tokens of the whole document."""
    if rule not in ("majority", "start"):
        raise ValueError(f"unknown allocation rule {rule!r}")
    lengths: list[np.ndarray] = []
    ends_at = re.compile(boundary)

    def run(ids, texts):
        encode = byte_vocabulary(vocabulary).encode_ordinary
        if not lengths:
            lengths.append(token_lengths(vocabulary))
        rows: list[tuple] = []
        for doc_id, text in zip(ids, texts):
            raw = utf8(text or "")
            text = raw.decode()
            tokens = np.array(encode(text), np.int64)
            ends = np.cumsum(lengths[0][tokens])
            octets = np.frombuffer(raw, np.uint8)
            sections = np.array([0, *(m.end() for m in ends_at.finditer(raw))])
            if len(sections) > 1 and sections[-1] == len(raw):
                sections = sections[:-1]
            at, crossing = attribute(ends - lengths[0][tokens], ends, sections, rule)
            counts = np.bincount(at, minlength=len(sections))
            crossed = np.bincount(at[crossing], minlength=len(sections))
            points = np.append(0, np.cumsum((octets & 0xC0) != 0x80))
            limits = points[np.append(sections, len(raw))]
            rows.extend(zip([doc_id] * len(sections), range(len(sections)), limits[:-1].tolist(), limits[1:].tolist(),
                            counts.tolist(), crossed.tolist(), [len(tokens)] * len(sections)))
        yield dict(zip((n for n, _ in SECTION), zip(*rows))) if rows else {n: [] for n, _ in SECTION}

    return map_batches(documents_of(docs), run, SECTION, ["doc_id", "text"])


def field_totals(counted: DataFrame) -> DataFrame:
    """Tokens per document from its sections."""
    return counted.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_sections"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
