"""Secret scan with a token-efficiency test.

Three fixed patterns (assigned credentials, access key ids, long hex strings) are the base.  The
method adds strings that a public byte-level vocabulary cannot compress: prose takes three or more
characters per token, a random key under two.  Known digests and identifiers are excluded first; an
identifier is known by its content: each run of four or more letters compresses like a word.

A run of key characters that compresses as a whole may still hold a key beside words (a path, a name
and its value), so the windows of its tokens that compress worst are tested as well; digests and UUIDs
between separators inside a run are cut out before.  The shortest tested length is 16, that of the
shortest access key id: below it a few odd abbreviations are as dense as a key.  Whole runs of 16 to 19
characters and windows, where a word of another language can be as dense, must also mix letter cases or
letters and digits.

Defined cases: a null or empty text has no spans; spans of one kind never overlap; a text of any
length is scanned whole; repeated rows give repeated results; ties at one start are ordered by
kind as listed in :data:`KINDS`.
"""
from __future__ import annotations

import base64
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, documents_of

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: A maximal run of key characters that is long enough to be tested.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
SHORTEST, ANY_SHAPE = 16, 20
SEPARATORS = "=-_/+"
#: Digests and UUIDs that stand between separators inside a longer run.
INSIDE = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
                    r"|(?:[0-9a-f]+|[0-9A-F]+))(?![0-9A-Za-z])")
#: Characters around a window that are searched for a separator.
REACH = 64
#: Characters by which a window may fall behind its best end before it is closed.
DROP = 6
#: Digest lengths in hex digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
INTEGRITY = re.compile(r"sha(256|384|512)-[A-Za-z0-9+/]+=*")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDY = re.compile(r"([A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4})([_/=+-]+([A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
LETTERS = re.compile(r"[A-Za-z]{4,}")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                 T.StructField("end", T.LongType())]))


@lru_cache(maxsize=4)
def byte_vocabulary(name: str):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wordlike(s: str, encode, ratio: float) -> bool:
    """Shaped like an identifier, and no run of four or more letters looks random; digit groups are exempt."""
    return bool(WORDY.fullmatch(s)) and all(len(x) >= ratio * len(encode(x)) for x in LETTERS.findall(s))


def known(s: str, encode, ratio: float) -> bool:
    """Digests, UUIDs, integrity values, plain numbers and word-like identifiers are no secrets."""
    return bool((len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s)) or UUID.fullmatch(s) or INTEGRITY.fullmatch(s)
                or wordlike(s, encode, ratio))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def mixed(s: str) -> bool:
    """Four letters and more, in both cases or beside digits; 16 hex digits are a 64-bit identifier."""
    letters = [c for c in s if c.isalpha()]
    cased = any(c.isupper() for c in s[1:]) and any(c.islower() for c in s)
    return len(letters) >= 4 and not (len(s) == 16 and DIGEST.fullmatch(s)) and (cased or any(c.isdigit() for c in s))


def pieces(run: str):
    """(start, text) of the parts of a run between the digests and UUIDs in it."""
    at = 0
    for m in INSIDE.finditer(run):
        if len(m[0]) in DIGEST_LENGTHS or UUID.fullmatch(m[0]):
            yield at, run[at:m.start()]
            at = m.end()
    yield at, run[at:]


def dense_windows(sizes: list[int], ratio: float):
    """(start, end) in characters of the windows of tokens with under ``ratio`` characters each.  A window
    opens at a dense token, closes when its surplus is used up or fell by :data:`DROP` characters, and
    ends where the surplus was greatest."""
    starts = [0]
    for n in sizes:
        starts.append(starts[-1] + n)
    i = 0
    while i < len(sizes):
        surplus = best = 0.0
        j = end = i
        while j < len(sizes):
            surplus += ratio - sizes[j]
            j += 1
            if surplus > best:
                best, end = surplus, j
            if surplus <= 0 or surplus < best - DROP:
                break
        if end > i:
            yield starts[i], starts[end]
        i = max(end, i + 1)


def widened(piece: str, a: int, b: int, encode, ratio: float) -> tuple[int, int]:
    """A window without separators at its ends, grown to the separators around it where it stays dense."""
    while a < b and piece[a] in SEPARATORS:
        a += 1
    while b > a and piece[b - 1] in SEPARATORS:
        b -= 1
    low, high = max(0, a - REACH), min(len(piece), b + REACH)
    left = max(piece.rfind(c, low, a) for c in SEPARATORS) + 1 or (a if low else 0)
    right = min((k for c in SEPARATORS if (k := piece.find(c, b, high)) >= 0), default=b if high < len(piece) else high)
    for x, y in ((left, right), (left, b), (a, right)):
        if y - x < ratio * len(encode(piece[x:y])):
            return x, y
    return a, b


def random_spans(text: str, encode, ratio: float, size) -> list[tuple[int, int, str]]:
    """Whole runs of key characters that do not compress; of other runs, the windows that do not.
    ``size`` gives the characters of a token."""
    found = []

    def dense(s: str) -> bool:
        return len(s) >= SHORTEST and not known(s, encode, ratio) and len(s) < ratio * len(encode(s))

    for m in CANDIDATE.finditer(text):
        s = m[0].strip(SEPARATORS)
        if len(s) < SHORTEST or (len(s) < ANY_SHAPE and not mixed(s)) or known(s, encode, ratio):
            continue
        at = m.start() + m[0].index(s)
        parts = list(pieces(s))
        if len(parts) == 1 and dense(s):
            found.append((at, 3, at + len(s)))
            continue
        for shift, piece in parts:
            if len(piece) < SHORTEST:
                continue
            last = 0
            for a, b in dense_windows([size(t) for t in encode(piece)], ratio):
                a, b = widened(piece, a, b, encode, ratio)
                a = max(a, last)
                if mixed(piece[a:b]) and dense(piece[a:b]):
                    found.append((at + shift + a, 3, at + shift + b))
                    last = b
    return found


def find_secrets(df: DataFrame, ratio: float = 2.0, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Append ``spans`` (kind, start, end in code points) to a frame with a ``text`` column; no row
    moves.  A candidate is reported when it has under ``ratio`` characters per token."""

    def scan(texts):
        encoding = byte_vocabulary(vocabulary)
        encode, out = encoding.encode_ordinary, []

        @lru_cache(maxsize=1 << 16)
        def size(token):
            return len(encoding.decode_single_token_bytes(token))

        for t in texts:
            t = t or ""
            spans = sorted(base_spans(t) + random_spans(t, encode, ratio, size))
            out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
        return {"spans": out}

    return append_columns(df, scan, [("spans", SPAN)], ["text"])


def digest_columns(df: DataFrame) -> DataFrame:
    """Counts and joined spans of the contract, derived from the operator's spans."""
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.kind != "random")
    return df.select("doc_id", count("assign"), count("access"), count("hex"),
                     F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), count("random"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest_columns(find_secrets(docs))
