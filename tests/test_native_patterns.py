"""Patterns of one's own in the JVM: spans of any group as RE2 gives them, without Python, and in time that follows the text's size."""

import random
import time

import duckdb
import pandas as pd
import pytest

from maskwright.functions import patterns
from maskwright.operators import custom
from maskwright.operators.analyze import Options, analyze
from maskwright.operators.catalog import RECOGNIZERS

#: Pattern, its three parts around the group for RE2, and the group.
NATIVE = [
    (r"\bTK-(\d{4})\b", r"(\bTK-)(\d{4})(\b)", 1), (r"(?i)emp[- ]?(\d{3,6})", r"((?i)emp[- ]?)(\d{3,6})()", 1), (r"@([a-z]+)\.[a-z]{2,}", r"(@)([a-z]+)(\.[a-z]{2,})", 1),
    (r"(\w\w)-(\w{2,5}?)-[^\s]", r"(\w\w-)(\w{2,5}?)(-[^\s])", 2), (r"<[^<>]*>", r"()(<[^<>]*>)()", 0), (r"(?:ab|a)(b|c)?c", r"()((?:ab|a)(?:b|c)?c)()", 0), (r"a.b|[\[&]\p{Zs}x", r"()(a.b|[\[&]\p{Zs}x)()", 0),
    (r"\B-(\D)(\S)", r"(\B-\D)(\S)()", 2), (r"(?:(?:x|y){2}z){1,3}", r"()((?:(?:x|y){2}z){1,3})()", 0), (r"[^a\s]é", r"()([^a\s]é)()", 0), (r"\b[a-z]+ (?P<n>[0-9]+)\b", r"(\b[a-z]+ )([0-9]+)(\b)", 1),
]


def test_spans_are_those_of_re2(spark):
    r = random.Random(5)
    bits = ["TK-", "1234", "emp", "EMP-", "@ab", ".", "com", "ab-", "abc-d", "<", ">", "x", "abbc", "acc", "a\rb", "a\nb", "[ x", "& x", "é", "ſ", "٣", " ", "-", "-x", "\n", "xyz", "yxz", "7", "word 12", "_", "\x85", "ba"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(500)]
    own = [custom.recognizer(f"T{k}", [(0.5, p, g)]) for k, (p, _, g) in enumerate(NATIVE)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = analyze(df, options=Options(recognizers=own))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x.i, s.entity_type, s.start, s.end, s.text) for x in found.collect() for s in x.spans}
    db, want = duckdb.connect(), set()
    db.register("d", pd.DataFrame({"i": range(len(texts)), "t": texts}))
    for k, (_, parts, _) in enumerate(NATIVE):
        for i, marked in db.execute(f"SELECT i, regexp_replace(t, '{parts}', '\\1\ue010\\2\ue011\\3', 'g') FROM d").fetchall():
            size = len(marked.split("\ue010")[0].encode())
            for part in marked.split("\ue010")[1:]:
                hit, rest = part.split("\ue011", 1)
                if hit:
                    want.add((i, f"T{k}", size, size + len(hit.encode()), hit))
                size += len(hit.encode()) + len(rest.encode())
    assert got == want and len({k for _, k, *_ in got}) == len(NATIVE) and len(got) > 1000


@pytest.mark.parametrize("pattern", [r"(a+)+b", r"\w+@", r"\d+\d+x", r"x.*y", r"(?<!a)b", r"(a|b)\1", r"^a", r"a$", r"(?:[a-z]?){50}", r"\S+ \S+", r"a(?i)b", r"[[:alpha:]]", r"\pL", "[a-z]{0,5000}1"])
def test_what_is_not_shown_to_be_linear_runs_in_python(pattern):
    assert patterns.native(pattern) is None


def test_groups_that_are_optional_or_repeated_run_in_python(spark):
    assert patterns.native(r"(\d{2})+x", 1) is None and patterns.native(r"(\d{2})?x", 1) is None and patterns.native(r"(?:(a)|b)", 1) is None
    own = [custom.recognizer("T", [(0.5, r"(\d{2})?x", 1)]), custom.recognizer("U", [(0.5, r"\w+@$", 0)])]
    spans = analyze(spark.createDataFrame([("12x x éab@",)], "text string"), options=Options(recognizers=own)).first().spans
    # in Python, too, classes are RE2's
    assert [(s.entity_type, s.text) for s in spans] == [("T", "12"), ("U", "ab@")]


def test_time_follows_the_size(spark):
    own = [custom.recognizer(f"T{k}", [(0.5, p, g)]) for k, (p, _, g) in enumerate(NATIVE)]
    for text in ("a" * 1_000_000, "<" * 1_000_000, "ab-" * 300_000, "xyz" * 300_000, "@a." * 300_000, "TK-" * 300_000):
        began = time.time()
        analyze(spark.createDataFrame([(text,)], "text string"), options=Options(recognizers=own)).collect()
        assert time.time() - began < 20


def test_gates_of_own_patterns():
    assert patterns.holds_a_digit(r"(?:a|b)\d?[0-9]{2}") and not patterns.holds_a_digit(r"a\d*") and not patterns.holds_a_digit(r"\d|x") and not patterns.holds_a_digit(r"[\dx]")
    assert sum(patterns.native(rx, g) is not None for r in RECOGNIZERS for _, rx, g in r.patterns) > 60


def test_a_flag_holds_for_the_whole_pattern(spark):
    """Also in the group, as RE2 has it."""
    own, texts = [custom.recognizer("T", [(0.5, r"(?i)\bthe ([a-z]{9,12})\b", 1)])], ["The Toonineath, the ofantition", "le THE OUONRESTATST", "the Short"]
    found = analyze(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), options=Options(recognizers=own)).orderBy("i").collect()
    want = [duckdb.execute("SELECT regexp_extract_all(?, ?, 1)", [t, own[0].patterns[0][1]]).fetchone()[0] for t in texts]
    assert [[s.text for s in x.spans] for x in found] == want and want[0] == ["Toonineath", "ofantition"]
