"""Spelling variants: words one edit apart, grouped under their most frequent form.

Asymmetric q-chunks.  Of two words one edit apart let ``s`` be the longer (either, if equal) and ``t`` the
other.  ``s`` contributes two disjoint chunks, its halves; one edit leaves one of them whole, and ``t``
holds it at the same place or one to the left.  So ``t`` contributes its positional grams for sources of
its own length and of one more: of all its grams those at a place where a chunk within shift one can lie.
Both meet in a hash join on (source length, half, gram); what meets is verified.

A chunk that very many words share does not make pairs: its entries are chunked anew inside the half
that holds the edit, which adds what must also agree to the key, until a group is small or one
character is left open; then a group holds at most one word per letter of the alphabet.

All work is DataFrame expressions.  Words and counts are aggregated in the map tasks first.

Defined cases: null texts have no words; a null doc_id counts as an empty one in the checksum; a word may
be of any length; of repeated rows each counts; an empty table gives an empty result; other columns are
not read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, materialise

RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: One in so many (document, run) pairs loses a letter.
SLIP = 199
#: Chunks times grams of one key from which its entries are chunked anew.
PAIRS = 1024


def slipped_words(docs: DataFrame, slip: int = SLIP) -> DataFrame:
    """(word) per run of letters, in lower case, with the stated slips; slip 0: none."""
    runs = documents_of(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run"))
    runs = runs.select("doc_id", run.alias("run"))
    if not slip:
        return runs.select(F.col("run").alias("word"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    runs = runs.select("run", F.crc32(name).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % slip == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    long_enough = words.filter(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _part(start, length):
    return F.substring("word", start + 1, length)


def _split(entries: DataFrame) -> DataFrame:
    """Entries (key, word, n, chunk, source, at, open) of the next level: two per entry.  ``open`` characters
    of the source, from ``at`` on, may hold the edit; in a gram's word one less if it is shorter."""
    half = F.floor(F.col("open") / 2).cast("int")
    own = F.col("open") + F.length("word") - F.col("source")
    rest = F.col("open") - half
    first = F.struct(F.xxhash64("key", F.lit(0), _part(F.col("at"), half)).alias("key"),
                     (F.col("at") + half).alias("at"), rest.alias("open"))
    second = F.struct(F.xxhash64("key", F.lit(1), _part(F.col("at") + own - rest, rest)).alias("key"),
                      F.col("at").alias("at"), half.alias("open"))
    out = entries.select("word", "n", "chunk", "source", F.explode(F.array(first, second)).alias("x"))
    return out.select("x.key", "word", "n", "chunk", "source", "x.at", "x.open")


def entries_of(words: DataFrame) -> DataFrame:
    """Chunks and positional grams of every word (word, n)."""
    length = F.length("word")
    roles = F.array(F.struct(F.lit(True).alias("chunk"), length.alias("source")),
                    *(F.struct(F.lit(False).alias("chunk"), (length + d).alias("source")) for d in (0, 1)))
    whole = words.select("word", "n", F.explode(roles).alias("x"))
    return _split(whole.select(F.col("x.source").cast("long").alias("key"), "word", "n", "x.chunk", "x.source",
                               F.lit(0).alias("at"), F.col("x.source").alias("open")))


def near_pairs(words: DataFrame, most: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words (word, n) exactly one edit apart, once."""
    found, entries = [], entries_of(words)
    while True:
        entries = materialise(entries, "chunks")
        sizes = entries.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"),
                                           F.max("open").alias("left"))
        # every source of chunks is also among the grams of its length, so one gram is the word itself
        sizes = sizes.filter("chunks > 0 AND grams > 1")
        again = (F.col("chunks") * F.col("grams") > most) & (F.col("left") > 1)
        sizes = materialise(sizes.select("key", again.alias("again")), "chunks")
        some = entries.join(sizes.filter("NOT again").select("key"), "key")
        one = some.filter("chunk").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        two = some.filter("NOT chunk").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = one.join(two, "key").filter((F.length("a") > F.length("b")) | (F.col("a") < F.col("b")))
        met = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()
        found.append(materialise(met, "near"))
        hot = sizes.filter("again")
        if hot.isEmpty():
            break
        entries = _split(entries.join(hot.select("key"), "key"))
    return reduce(DataFrame.unionByName, found).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form).  A form occurs more often than its word, so
    chains end; pointers double, so rounds grow with the logarithm of the longest chain."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = materialise(now.join(step, "root", "left").select("word", F.coalesce("on", "root").alias("root"),
                                                                  F.col("on").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    words = materialise(words, "words")
    pairs = materialise(near_pairs(words), "near")
    sides = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("w")).alias("o"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("m"), F.col("a").alias("w")).alias("o")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    best = words.join(best, "word", "left")
    is_form = -F.col("o.m") >= ratio * F.col("n")
    best = materialise(best.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                   F.when(is_form, F.col("o.w")).alias("form"),
                                   F.when(is_form, -F.col("o.m")).alias("form_n")), "forms")
    ends = roots(best.filter("form IS NOT NULL"))
    out = best.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(slipped_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
