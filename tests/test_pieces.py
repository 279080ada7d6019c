"""Texts analyzed in pieces against the same texts analyzed whole."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import patterns
from maskwright.functions.regex import to_java
from maskwright.operators import pieces
from maskwright.operators.analyze import Context, Options, findings
from maskwright.operators.catalog import RECOGNIZERS, Recognizer
from maskwright.plans import vectors


def mixed(n, seed):
    """Values and words in a row, with odd separators and long stretches without any."""
    r = random.Random(seed)
    values = [v for pairs in vectors.VALUES.values() for _, v in pairs if v] + ["1234 5678", "January 12, 2020", "+1 (555) 123 4567", "cep", "passport number", "email address", "j@x.com"]
    out = []
    for _ in range(n):
        x = r.random()
        out.append(r.choice(values) if x < 0.5 else r.choice(["é", "日本語", "of", "Word", "a" * 90, "ein Satz mit Worten", "x." * 40]) if x < 0.9 else r.choice(["\t", "\r\n", " ", "_", "-", "7"]))
        out.append(r.choice([" ", " ", " ", "\n", ", ", "", " ", "  "]))
    return "".join(out)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_every_built_in_pattern_allows_cuts():
    assert pieces.cuts_of(Options()) == r"\n| [a-z]"
    assert patterns.safe_cut([r"\bcode [a-z]+\b"]) == r"\n" and patterns.safe_cut([r"a\sb"]) is None and patterns.safe_cut([r"\b\w+ "]) == r"\n"
    assert patterns.safe_cut([r"(?i)\b[A-Z] [A-Z]\b"]) == r"\n" and patterns.safe_cut([r"x|\d{2} ?\d"]) == r"\n| [a-z]"
    for p in (r"^a", r"a$", r"(?<=a)b", r"(a)\1", r"\pN+", "[^a]+"):
        assert patterns.safe_cut([p]) is None


@pytest.mark.parametrize("size", [64, 1000])
def test_pieces_find_what_the_whole_text_has(spark, size):
    texts = [mixed(n, n + size) for n in (0, 1, 5, 60, 200, 400)] + [None, "", "x" * 5000, "日" * 1000 + " mail j@x.com", " word" * 500 + " 10.0.0.1", "\n" * 300]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[4])], "id long, text string")
    for o in (Options(), Options(context=Context(before=3, after=4)), Options(context=False, threshold=0.4, allow=["10.0.0.1"], entities=["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "BR_CEP"])):
        want = rows(findings(df.coalesce(1), "id", options=o))
        assert rows(pieces.findings_in_pieces(df, "id", options=o, size=size)) == want and len(want) > 30


def test_pieces_cover_the_text(spark):
    texts = [mixed(300, 1), "日本 words é" * 300, "a" * 3000]
    got = pieces.pieces(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", r"\n| [a-z]", 100, 50).select("id", "piece.*").collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r.id == i), key=lambda r: r.offset + r.lead)
        raw = t.encode()
        assert b"".join(r.text.encode()[r.lead : r.lead + r.own] for r in mine) == raw and len(mine) > 5 or i == 2
        for r in mine:
            assert raw[r.offset :].startswith(r.text.encode()) and (r.offset == 0 or len(re.findall(r"\W\w", t.encode()[r.offset : r.offset + r.lead].decode())) > 6)


def test_a_text_of_ten_megabytes(spark):
    unit = mixed(400, 7) + " plain words without any value in them" * 200 + "\n"
    text = unit * (10_000_000 // len(unit.encode()) + 1)
    o = Options(entities=["EMAIL_ADDRESS", "IBAN_CODE", "PHONE_NUMBER", "US_SSN"])
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert rows(pieces.findings_in_pieces(df, "id", options=o)) == rows(findings(df, "id", options=o))


def test_what_leaves_no_safe_cut_stays_whole(spark):
    df = spark.createDataFrame([(1, "begin of a very long\nmatch end " * 50)], "id long, text string")
    o = Options(recognizers=[Recognizer("T", "A", "en", [(0.5, r"begin[a-z\s]+end", 0)])])
    assert pieces.cuts_of(o) is None and len(rows(pieces.findings_in_pieces(df, "id", options=o, size=40))) == 1
    assert pieces.cuts_of(Options(recognizers=[*RECOGNIZERS, Recognizer("L", "L", "en", [(0.5, "(?<=a)b", 0)], lookaround=True)])) is None


def test_shapes_hold_for_the_matches(spark):
    """All matches of the built-in patterns in random texts, by their first and last kinds and pairs."""
    text = mixed(3000, 3)
    kind = lambda c: patterns.LINE if c in "\t\n\v\f\r" else patterns.BLANK if c == " " else patterns.SMALL if c.isascii() and c.islower() else patterns.OTHER
    df, seen = spark.createDataFrame([(text,)], "text string"), 0
    chosen = sorted({rx for r in RECOGNIZERS for _, rx, g in r.patterns if not g})
    got = df.select(*(F.regexp_extract_all("text", F.lit(to_java(rx)), F.lit(0)).alias(f"m{k}") for k, rx in enumerate(chosen))).first()
    for rx, found in zip(chosen, got, strict=True):
        s = patterns.shape(rx)
        for m in found:
            k = [kind(c) for c in m]
            assert k[0] in s.first and k[-1] in s.last and set(k) <= s.held and set(zip(k, k[1:], strict=False)) <= s.pairs, (rx, m)
            seen += 1
    assert seen > 1000
