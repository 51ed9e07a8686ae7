"""Surrogates against a plain re-implementation, and the forms that are found."""
import random
import re

import pytest

from freightline.llm import pii

KEY = b"surrogates"


def brute(texts):
    """Replacement with one dictionary over all texts, drawn in the same rounds."""
    real = sorted({(k, c) for t in texts if t for _, _, k, c in pii.detect(t) if k != "given"})
    attempt = dict.fromkeys(real, 0)
    while True:
        by = {}
        for k, c in real:
            by.setdefault((k, pii.surrogate(KEY, k, c, attempt[k, c])), []).append((attempt[k, c], c))
        clash = [(k, c) for (k, s), held in by.items() for _, c in (sorted(held) if (k, s) in attempt else sorted(held)[1:])]
        if not clash:
            break
        for x in clash:
            attempt[x] += 1
    out = []
    for t in texts:
        spans = pii.detect(t) if t else []
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for start, end, k, c in reversed(spans):
            t = t[:start] + pii.dressed(pii.surrogate(KEY, k, c, attempt.get((k, c), 0)), t[start:end]) + t[end:]
        out.append(t)
    return out


def replaced(make_docs, texts):
    rows = pii.pseudonymise(make_docs(texts)).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_documents_match_brute_force(make_docs, sample):
    texts = [t for _, t, _ in sample] + [f"Mr. {a}{b} from 192.168.{i}.7" for i, (a, b) in enumerate(
        (a, b) for a in ("Ba", "Do", "Ka") for b in ("rase", "tovi", "nalu", "kemi"))]
    assert replaced(make_docs, texts) == brute(texts)


def found(text, kind):
    return [text[a:b] for a, b, k, _ in pii.detect(text) if k == kind]


@pytest.mark.parametrize("text", ["+49 30 901820", "+44 20 7946 0958", "+442079460958", "01 23 45 67 89", "(212) 555-0142",
                                  "+33 1 23 45 67 89", "+44 (0)20 7946 0958", "+1 212 555 0142", "212.555.0142"])
def test_phone_forms(text):
    assert found(f"call {text}, or not", "phone") == [text]


def test_country_codes_tell_phones_apart(make_docs):
    out = replaced(make_docs, ["+44 207 946 0958", "+1 207 946 0958", "+33 207-946-0958", "207 946 0958"])
    digits = [re.sub(r"\D", "", t) for t in out]
    assert [d[:2] for d in digits[:3:2]] == ["44", "33"] and digits[1][0] == "1"
    assert len({d[-10:] for d in digits[:3]}) == 3 and digits[1][1:] == digits[3]


def test_card_forms():
    for text in ("4539 1488 0343 6467", "378282246310005", "3782 822463 10005", "6011-0009-9013-9424", "30569309025904", "4222222222222"):
        assert found(f"card {text}.", "card") == [text]
    for text in ("1700000000000", "3782 822463 10006", "2024-01-01 10 20 30", "order 55 66 77"):
        assert not found(text, "card")


def test_every_mention_of_a_surname_goes(make_docs):
    texts = ["Mr. John Keller came. Keller said KELLER was late; a keller, and Kellermann stayed.",
             "Dr. O'Neil and Mrs McDonald. O'Neil left, McDonald's friend too.", "Herr Karl van der Berg. Then Berg went.",
             "Jean-Luc Picard spoke. Picard, PICARD.", "MARY KELLER AND PAUL AND JOHN", "Frau Anna Braun-Vogt, Braun-Vogt; BRAUN-VOGT"]
    out = replaced(make_docs, texts)
    assert re.fullmatch(r"Mr\. \w+ (\w+) came\. \1 said ([A-Z]+) was late; a keller, and Kellermann stayed\.", out[0])
    assert out[0].split()[2].lower() == out[0].split()[6].lower() != "keller"
    assert not re.search("Neil|Donald", out[1]) and "van der" in out[2] and "Berg" not in out[2]
    assert not re.search("Picard|PICARD|Luc", out[3]) and "KELLER" not in out[4] and out[4].count(" AND ") == 2
    assert not re.search("(?i)braun|vogt", out[5])


def test_formats_that_could_be_full_still_end(spark):
    """30,000 short surnames (21,952 three-syllable surrogates) and every 192.168 address."""
    rng = random.Random(4)
    names = set()
    while len(names) < 30_000:
        names.add("".join(rng.choices("abcdefghijklmnoprstuvwyz", k=rng.choice((4, 5, 6)))))
    rows = [(1, "surname", n) for n in sorted(names)] + [(2, "ip", f"192.168.{a}.{b}") for a in range(256) for b in range(256)]
    got = pii.distinct_surrogates(spark.createDataFrame(rows, "row long, kind string, canon string"), KEY).collect()
    made = {(r.kind, r.surrogate) for r in got}
    assert len(got) == len(rows) == len(made) and not made & {(k, c) for _, k, c in rows}


def test_a_full_kind_raises(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    rows = [(1, "ip", f"192.168.0.{b}") for b in range(256)] + [(1, "ip", f"192.168.{a}.1") for a in range(256)]
    clash = [(1, "ip", pii.surrogate(KEY, "ip", c)) for _, _, c in rows] + [(1, "ip", pii.surrogate(KEY, "ip", c, 1)) for _, _, c in rows]
    with pytest.raises(ValueError, match="ip"):
        pii.distinct_surrogates(spark.createDataFrame(rows + clash, "row long, kind string, canon string"), KEY)


def test_clashing_column_names(spark):
    """Columns named like helper columns of any stage travel unchanged."""
    from freightline.llm import decontam, neardup, quality
    names = ["row", "q_row", "q_redrawn", "n_text", "n_entities", "key", "kept", "id", "of_text", "kept_id", "doc", "leak", "redrawn",
             "row0", "row1", "q_classes", "q_words", "n_words", "component_id", "set", "bits"]
    words = " ".join(f"word{i}" for i in range(60))
    data = [(i, f"{words} Mr. John Keller number{i} of the and", "en", *(f"{n}-{i}" for n in names)) for i in range(3)]
    docs = spark.createDataFrame(data, f"doc_id long, text string, lang string, {', '.join(f'{n} string' for n in names)}")
    docs = docs.selectExpr("*", "'s' AS source", "length(text) AS n_chars")
    want = {r.doc_id: tuple(r[n] for n in names) for r in docs.collect()}
    import os
    sf = "/root/testdata/sf0.001"
    assert os.path.exists(sf)
    for stage in (quality.quality_stage, neardup.dedup_stage, decontam.decontamination_stage, pii.pii_stage):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r[n] for n in names) == want[r.doc_id] for r in rows)


def test_empty_table(make_docs):
    assert pii.pseudonymise(make_docs([])).collect() == []
