"""Surrogates for personal data.

Detected entities (e-mail addresses, phone numbers, card numbers, IP addresses, social security
numbers and names of persons) are replaced by keyed, type-consistent ones: an HMAC of the
canonical entity draws the surrogate, so every spelling of one entity gets the same one in all
documents.  Every mention of a surname that a text gives with a title or given name is replaced in that text.  Gender and script of given names, letter case, separators, digit counts, check digits
and private address ranges are kept.

Distinctness over the corpus is checked: if two entities of a type draw one surrogate, or a
surrogate is itself an entity of the corpus, the entity draws again until none is left; later draws are
longer or from a wider range, and a kind that is full nevertheless raises an error.  Given
names are permuted within their gender and script, which cannot collide.  Only redrawn entities
need a lookup; it is joined to the documents they occur in.

Defined cases: null and empty texts stay as they are; a text without entities is unchanged;
overlapping matches go to the type listed first; repeated rows get equal results.
"""
from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, map_batches, materialise, release
from .decontam import row_key

# Given names by gender and script, and forms of address by gender.
GIVEN = {
    ("m", "Latin"): "James John Robert Michael William David Thomas Daniel Paul Mark George Peter Hans Karl Pierre "
                    "Jean Luis Carlos Miguel Antonio".split(),
    ("f", "Latin"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Laura Julia Ingrid Ursula "
                    "Marie Sophie Carmen Lucia Elena Isabel".split(),
    ("m", "Cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split(),
    ("f", "Cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("m", "Greek"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
    ("f", "Greek"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
SYLLABLES = {
    "Latin": "ba be bo da de do ga ka ke la le lo ma me mi na ne no ra re ro sa se ta te to va vi".split(),
    "Cyrillic": "ба бе бо да де до га ка ке ла ле ло ма ме ми на не но ра ре ро са се та те то ва ви".split(),
    "Greek": "βα βε βο δα δε δο γα κα κε λα λε λο μα με μι να νε νο ρα ρε ρο σα σε τα τε το φα φι".split(),
}
POOL = {name.lower(): group for group, names in GIVEN.items() for name in names}

EMAIL = r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
IP = r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
CARD = r"(?P<card>(?<![\w-])[2-6]\d{3}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w-])[2-6]\d{2,5}(?:[ -]?\d{2,6}){2,5}(?![\w-]))"
PHONE = (r"(?P<phone>(?<![\w.+-])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|"
         r"(?<![\w.+-])\+\d{1,3}+(?:[ .-]?\(0\))?+(?:[ .-]?+\(?+\d{1,5}+\)?+){1,6}+(?!\w)|"
         r"(?<![\w.-])(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])0\d(?:[ .-]\d{2}){4}(?![\w-]))")
MAIL = re.compile(EMAIL, re.ASCII)
NUMERIC = re.compile("(?=[+(0-9])(?:" + "|".join((IP, SSN, PHONE, CARD)) + ")", re.ASCII)
DIGIT = re.compile("[0-9]")
# Particles of surnames, kept as they are, and capital words that are no surname after a name.
PARTICLES = "van von der den de del della di da dos du la le ter ten zu zur bin al el".split()
NOT_SURNAMES = frozenset("and or the of in on at to for with from by is was und oder der die das mit von et ou le la les y o el los las".split())
NAMES = [*TITLES, *(n for names in GIVEN.values() for n in names)]
EITHER = lambda names: "|".join(x for n in names for x in (n, n.upper()))
OPENING = re.compile(rf"\b(?=[{''.join(sorted({n[0] for n in NAMES}))}])(?:{EITHER(NAMES)})\b")
#: Keller, McDonald, O'Neil, Keller-Braun, KELLER.
SURNAME = r"(?:\p{Lu}['’])?\p{Lu}(?:\p{Ll}+(?:\p{Lu}\p{Ll}+)?|\p{Lu}{2,})(?:-\p{Lu}(?:\p{Ll}+|\p{Lu}+))*"
PERSON = regex.compile(rf"\b(?:(?P<title>{EITHER(TITLES)})\.?\s)?(?:(?P<given>{EITHER(n for v in GIVEN.values() for n in v)})"
                       rf"(?:-(?P<second>\p{{Lu}}\p{{Ll}}+))?\s)?(?:(?:{'|'.join(PARTICLES)})\s){{0,3}}(?P<surname>{SURNAME})\b(?!['’]\p{{L}}{{2}})")
KINDS = ("email", "ip", "ssn", "card", "phone", "surname")


def script_of(word: str) -> str:
    c = ord(word[0])
    return "Greek" if 0x370 <= c < 0x400 else "Cyrillic" if 0x400 <= c < 0x530 else "Latin"


def phone_name(text: str) -> str | None:
    """Canonical digits: with the country code where there is one; a ten-digit number without is North
    American, one that begins with 0 national.  None for too few or too many digits."""
    digits = re.sub("[^0-9]", "", text.replace("(0)", "")) if text[0] == "+" else re.sub("[^0-9]", "", text)
    if text[0] == "+":
        return digits if 8 <= len(digits) <= 15 else None
    return digits if digits[0] == "0" else "1" + digits


def overlaps(taken: list[tuple], a: int, b: int) -> bool:
    """Whether a span meets one of sorted, disjoint spans."""
    i = bisect_left(taken, (b,))
    return i > 0 and taken[i - 1][1] > a


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form), without overlaps, in order.  A surname found after a title or
    a given name is found wherever it stands in the text, capitalised or in capitals."""
    found = [(m.start(), m.end(), "email", m[0].lower()) for m in MAIL.finditer(text)] if "@" in text else []
    if DIGIT.search(text):
        mails = list(found)
        for m in NUMERIC.finditer(text):
            kind, digits = m.lastgroup, re.sub("[^0-9]", "", m[0])
            name = m[0] if kind == "ip" else phone_name(m[0]) if kind == "phone" else digits
            if kind == "card" and len(digits) != 16 and not (13 <= len(digits) <= 19 and luhn(digits) == 0):
                name = None
            if name is not None and not overlaps(mails, *m.span()):
                found.append((*m.span(), kind, name))
        found.sort()
    if OPENING.search(text):
        taken, people, surnames = list(found), [], set()
        for m in PERSON.finditer(text):
            if not (m["title"] or m["given"]) or overlaps(taken, *m.span()):
                continue
            surname = m["surname"].lower()
            if m["given"]:
                people.append((*m.span("given"), "given", m["given"].lower()))
            if m["second"]:
                people.append((*m.span("second"), "surname", m["second"].lower()))
            if surname not in POOL and surname not in NOT_SURNAMES:
                people.append((*m.span("surname"), "surname", surname))
                surnames.add(m["surname"])
        people.sort()
        if surnames:
            again = "|".join(sorted({regex.escape(x) for n in surnames for x in (n, n.upper(), spelled(n.lower()))}, key=lambda x: (-len(x), x)))
            for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}])(?:{again})(?![\p{{L}}\p{{N}}])", text):
                if not overlaps(people, *m.span()) and not overlaps(taken, *m.span()):
                    found.append((*m.span(), "surname", m[0].lower()))
        found = sorted(found + people)
    return found


def spelled(surname: str) -> str:
    """A lower-case surname with capitals: keller-braun, o'neil."""
    return regex.sub(r"(?:^|(?<=[-'’]))\p{L}", lambda m: m[0].upper(), surname)


class Draw:
    """Unbounded keyed stream of small numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}|{attempt}|{canon}".encode(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 32:
            block = hmac.new(self.key, self.seed + b"|%d" % self.n, hashlib.sha256).digest()
            self.n += 1
            self.pool = int.from_bytes(block, "big")
        self.pool, out = divmod(self.pool, n)
        return out


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def shaped(draw: Draw, s: str) -> str:
    """Letters for letters, digits for digits, all else kept."""
    return "".join(chr(97 + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in s)


#: Attempts within an entity's own format; each later one widens it, so that no format can be full for good.
NARROW = 3


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity.  From attempt ``NARROW`` on the format gives way:
    names and mail boxes grow, private addresses come from the largest private range, numbers draw more of
    their digits."""
    draw, wider = Draw(key, kind, canon, attempt), max(0, attempt - NARROW + 1)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        host = Draw(key, "domain", domain, 0)  # one domain, one surrogate domain
        return (f"{shaped(draw, local)}{''.join(chr(97 + draw.below(26)) for _ in range(wider))}"
                f"@{'.'.join([*(shaped(host, x) for x in labels[:-1]), labels[-1]])}")
    if kind == "ip":
        a, b, _, _ = octets = canon.split(".")
        fixed = 1 if a in ("10", "127") else 2 if (a, b) == ("192", "168") or (a == "172" and 16 <= int(b) < 32) else 0
        lead = octets[:fixed] or [str((11, 31, 51, 71, 91, 111, 131, 151, 171, 191, 201, 211)[draw.below(12)])]
        if wider:
            lead = ["10"] if fixed == 2 else lead if fixed else [str(11 + draw.below(116))]
        return ".".join([*lead, *(str(1 + draw.below(254)) for _ in range(4 - len(lead)))])
    if kind == "card":
        body = canon[0] + "".join(str(draw.below(10)) for _ in canon[1:])
        return body if luhn(canon) else body[:-1] + str((int(body[-1]) - luhn(body)) % 10)
    if kind == "phone":
        if len(canon) == 11 and canon[0] == "1":  # North American: area and exchange begin with 2 to 9
            return "1" + "".join(str(2 + draw.below(8)) if i in (0, 3) else str(draw.below(10)) for i in range(10))
        fixed = 1 if canon[0] == "0" or wider else 2
        return canon[:fixed] + str(1 + draw.below(9)) + "".join(str(draw.below(10)) for _ in canon[fixed + 1:])
    if kind == "ssn":
        return f"{100 + draw.below(566 if not wider else 900):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "given":
        names = GIVEN[POOL[canon]]
        order = sorted(names, key=lambda n: hmac.new(key, b"given|" + n.encode(), hashlib.sha256).digest())
        return order[([n.lower() for n in order].index(canon) + 1) % len(order)].lower()
    parts = SYLLABLES[script_of(canon)]
    n = max(3, -(-len(canon) // 2)) + wider
    return "-".join("".join(parts[draw.below(len(parts))] for _ in range(n)) for _ in canon.split("-"))


def dressed(new: str, old: str) -> str:
    """The surrogate in the format of the spelling it replaces."""
    if not any(c.isalpha() for c in old) and "." not in old:  # numbers: the old separators and leading country code
        parts = old.split("(0)")  # a trunk zero is no digit of the number
        digits = iter(new[-sum(c.isdigit() for x in parts for c in x):])  # a national spelling shows no country code
        return "(0)".join("".join(next(digits) if c.isdigit() else c for c in x) for x in parts)
    if old.isupper():
        return new.upper()
    if len(old) == len(new):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, old))
    return "-".join(p[:1].upper() + p[1:] for p in new.split("-")) if old[:1].isupper() else new


ENTITY = [("row", T.LongType()), ("kind", T.StringType()), ("canon", T.StringType())]


def entities(rows: DataFrame) -> DataFrame:
    """Distinct entities per row of (row, text)."""

    def run(keys, texts):
        found = [(k, kind, canon) for k, t in zip(keys, texts) if t
                 for kind, canon in sorted({(kind, canon) for _, _, kind, canon in detect(t) if kind != "given"})]
        yield dict(zip(("row", "kind", "canon"), zip(*found))) if found else {n: [] for n, _ in ENTITY}

    return map_batches(rows, run, ENTITY, ["row", "text"])


#: Rounds of drawing before a kind counts as full.
ATTEMPTS = 64


def distinct_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, surrogate) for every distinct entity, all surrogates of a kind distinct
    and none of them an entity of the corpus."""

    def draw(frame: DataFrame) -> DataFrame:
        return append_columns(frame, lambda kinds, canons, attempts: {
            "surrogate": [surrogate(key, *x) for x in zip(kinds, canons, attempts)]},
            [("surrogate", T.StringType())], ["kind", "canon", "attempt"])

    real = materialise(found.select("kind", "canon").distinct(), "entities")
    now = materialise(draw(real.withColumn("attempt", F.lit(0))), "surrogates")
    for attempt in range(1, ATTEMPTS + 1):
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon"))
        known = real.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("is_real"))
        judged = materialise(now.withColumn("nth", first).join(known, ["kind", "surrogate"], "left").withColumn(
            "clash", F.col("is_real").isNotNull() | (F.col("nth") > 1)).drop("nth", "is_real"), "surrogates")
        release(now)
        if judged.filter("clash").isEmpty():
            return judged.drop("clash")
        if attempt == ATTEMPTS:
            full = sorted(r["kind"] for r in judged.filter("clash").select("kind").distinct().collect())
            raise ValueError(f"no distinct surrogates left for: {', '.join(full)}")
        again = draw(judged.filter("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        now = materialise(judged.filter("NOT clash").drop("clash").unionByName(again), "surrogates")
        release(judged)


def replace_entities(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, canon in detect(text):
        out += [text[at:start], dressed(surrogate(key, kind, canon, attempts.get((kind, canon), 0)), text[start:end])]
        at, n = end, n + 1
    return "".join([*out, text[at:]]) if n else text, n


def pseudonymise(docs: DataFrame, key: bytes = b"surrogates") -> DataFrame:
    """Documents with ``text`` replaced and ``n_entities`` appended (unless there is such a column, which
    stays); other columns stay.  Give a secret ``key``."""
    other = {c: f"row{i}" for i, c in enumerate(docs.columns) if c != "text"}  # no name can clash
    marked = docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).alias(n) for c, n in other.items()),
                         row_key().alias("key"))
    found = materialise(entities(marked.select(F.col("key").alias("row"), "text")), "found")
    every = distinct_surrogates(found, key)
    redrawn = every.filter("attempt > 0").select("kind", "canon", "attempt")
    per_row = materialise(found.join(redrawn, ["kind", "canon"]).groupBy("row").agg(
        F.collect_set(F.struct("kind", "canon", "attempt")).alias("redrawn")), "redrawn")
    release(found)
    joined = marked.join(per_row, F.col("key") == F.col("row"), "left").drop("key", "row")

    def run(texts, redrawn_):
        new = [replace_entities(t, key, {(r["kind"], r["canon"]): r["attempt"] for r in a or ()}) if t else (t, 0)
               for t, a in zip(texts, redrawn_)]
        return {"text": [t for t, _ in new], "n_entities": [n for _, n in new]}

    out = append_columns(joined, run, [("text", T.StringType()), ("n_entities", T.LongType())], ["text", "redrawn"])
    kept = [F.col(other.get(c, c)).alias(c) for c in docs.columns]
    return out.select(*kept, *(["n_entities"] if "n_entities" not in docs.columns else []))


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data replaced; ``n_chars`` follows the new text."""
    return pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
