"""Overlapping spans: resolved, joined and counted, against loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.operators import anonymize as anon
from maskwright.operators import overlaps

SPAN = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def painted(size, spans):
    """Each byte belongs to the first span over it; pieces are its runs."""
    order = sorted(spans, key=lambda x: (-x[3], x[1] - x[2], x[1], x[2], x[0]))
    owner = [None] * size
    for k, (_, a, b, _) in enumerate(order):
        for i in range(max(a, 0), min(b, size)):
            owner[i] = k if owner[i] is None else owner[i]
    out, begin = [], 0
    for i in range(1, size + 1):
        if i == size or owner[i] != owner[begin]:
            if owner[begin] is not None:
                out.append((begin, i, order[owner[begin]][0]))
            begin = i
    return out


@pytest.mark.parametrize("few", [0, 16, 1000])
def test_resolve(spark, monkeypatch, few):
    """By comparison, by sweeping, and by whichever fits."""
    monkeypatch.setattr(anon, "FEW", few)
    r = random.Random(few)
    rows = []
    for n in [0, 1, 2, 3, 5, 10, 17, 33, 64, 100] * 3:
        size = r.choice([5, 30, 200])
        ends = [sorted((r.randint(-3, size + 3), r.randint(-3, size + 3))) for _ in range(n)]
        rows.append(("x" * size, [(r.choice("ABC"), a, b, r.choice([0.3, 0.5, 1.0])) for a, b in ends]))
    df = spark.createDataFrame(rows, f"text string, spans {SPAN}")
    got = df.select(anon.resolve(F.col("text"), F.col("spans")).alias("p")).collect()
    for (text, spans), x in zip(rows, got, strict=True):
        assert [tuple(p) for p in x.p] == painted(len(text), [(t, max(a, 0), min(b, len(text)), s) for t, a, b, s in spans if min(b, len(text)) > max(a, 0)])


def test_a_hundred_thousand_nested_spans(spark):
    n = 100_000
    nested = spark.range(1).select(F.repeat(F.lit("x"), 2 * n).alias("text"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.lit("T").alias("entity_type"), k.alias("start"), (2 * n - k).alias("end"), (k / n).alias("score"))).alias("spans"))
    began = time.time()
    p = nested.select(anon.resolve(F.col("text"), F.col("spans")).alias("p")).first().p
    assert time.time() - began < 120  # comparing them takes hours
    # the innermost has the highest score, so each keeps what lies left and right of the next one
    assert len(p) == 2 * n - 1 and tuple(p[0]) == (0, 1, "T") and tuple(p[n - 1]) == (n - 1, n + 1, "T") and tuple(p[-1]) == (2 * n - 1, 2 * n, "T")


@pytest.mark.parametrize(("size", "crowded"), [(1024, 1024), (8, 5), (1, 1)])
def test_overlapping_spans(spark, size, crowded):
    r = random.Random(size)
    spans = lambda n: [(r.choice([1, 1, 1, 2, None]), r.choice("AB"), a := r.randint(0, 60), a + r.randint(0, 25)) for _ in range(n)]
    x, y = spans(120), spans(90)
    schema = "id int, entity_type string, start int, end int"
    a, b = spark.createDataFrame(x + x[:3], schema), spark.createDataFrame(y + y[:2], schema)
    got = sorted((q.id, *q.a, *q.b, q.shared) for q in overlaps.overlapping(a, b, "id", size, crowded).select("id", F.struct("a.start", "a.end", "a.entity_type").alias("a"), F.struct("b.start", "b.end", "b.entity_type").alias("b"), "shared").collect())
    want = sorted((i, s, e, t, u, f, v, min(e, f) - max(s, u)) for i, t, s, e in x + x[:3] for j, v, u, f in y + y[:2] if i is not None and i == j and min(e, f) > max(s, u))
    assert got == want and len(want) > 1000
    assert overlaps.overlapping(a.limit(0), b, "id").count() == 0


def test_found_against_planted(spark):
    """A text with many spans, where bins are crowded, and one without any found."""
    planted = [(1, "NAME", 10 * k, 10 * k + 6) for k in range(400)] + [(1, "NAME", 0, 6), (2, "NAME", 0, 5), (2, "CITY", 7, 9), (2, "CITY", 9, 9)]
    found = [(1, "NAME", 0, 6), (1, "NAME", 9, 17), (1, "NAME", 22, 24), (1, "CITY", 40, 46), (1, "NAME", 33, 39), (1, "NAME", 60, 66), (1, "NAME", 55, 70)]
    schema = "doc_id int, entity_type string, start int, end int"
    rows = overlaps.span_overlap(spark.createDataFrame(found, schema), spark.createDataFrame(planted, schema)).collect()
    assert {r.entity_type: tuple(r)[1:] for r in rows} == {"NAME": (401, 2, 3, 6, 395), "CITY": (1, 0, 0, 0, 1)}
