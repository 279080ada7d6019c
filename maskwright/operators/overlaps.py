"""Spans that overlap others of the same text, as a range join of two tables of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a bin; rows of one side in a bin of a text from which it is split.
BIN, CROWDED = 1024, 1024


def _binned(spans: DataFrame, key: str, size: int) -> DataFrame:
    """A row for each bin that a span touches; empty spans touch none."""
    return spans.filter(F.col(key).isNotNull() & (F.col("end") > F.col("start"))).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))


def overlapping(a: DataFrame, b: DataFrame, key: str = "doc_id", size: int = BIN, crowded: int = CROWDED) -> DataFrame:
    """(key, a, b, shared): each pair of a span of one table and a span of the other that share bytes of a text, as structs of their columns without the key, and how many bytes. Both tables have the key, start and end; rows with a null key meet none, and repeated rows meet as often as they occur.

    Spans meet in the bins that they touch, and a pair is told in the bin where the later of them begins, so once, without a pass over all pairs. A bin with many spans of `a` is split: these are dealt to parts, and its spans of `b` go to each part.
    """
    left, right = _binned(a.select(key, "start", "end", F.struct(*(c for c in a.columns if c != key)).alias("a")), key, size), _binned(b.select(key, "start", "end", F.struct(*(c for c in b.columns if c != key)).alias("b")), key, size)
    at = [key, "_bin"]
    parts = left.groupBy(*at).agg(F.ceil(F.count("*") / crowded).cast("int").alias("_parts"))
    # only bins that have both sides go on, and each knows its parts
    dealt = left.join(parts, at).select(*at, "a", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int").alias("_part"))
    spread = right.join(parts, at).select(*at, "b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    met = dealt.join(spread, [*at, "_part"])
    begin, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    return met.filter((end > begin) & (F.floor(begin / size) == F.col("_bin"))).select(key, "a", "b", (end - begin).alias("shared"))


def span_overlap(found: DataFrame, planted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(entity_type, planted, exact, covered, touched, missed): of the planted spans (key, entity_type, start, end) of each type, those that a found span of the type equals, holds whole, shares bytes with, and those that none does. Repeated planted spans count once."""
    one = planted.select(key, "entity_type", "start", "end").filter(F.col("end") > F.col("start")).distinct()
    met = overlapping(found.select(key, "entity_type", "start", "end").distinct(), one, key).filter("a.entity_type = b.entity_type")
    hit = lambda test: F.max(test.cast("int"))
    p, q = F.col("a"), F.col("b")
    best = met.groupBy(key, "b").agg(hit((p["start"] == q["start"]) & (p["end"] == q["end"])).alias("exact"), hit((p["start"] <= q["start"]) & (p["end"] >= q["end"])).alias("covered"), F.lit(1).alias("touched"))
    best = best.select(key, "b.*", "exact", "covered", "touched")
    each = one.join(best, [key, "entity_type", "start", "end"], "left").na.fill(0, ["exact", "covered", "touched"])
    counted: list[Column] = [F.sum(c).alias(c) for c in ("exact", "covered", "touched")]
    return each.groupBy("entity_type").agg(F.count("*").alias("planted"), *counted, F.sum(1 - F.col("touched")).alias("missed"))
