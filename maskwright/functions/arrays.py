"""Array expressions that cost time in proportion to the array's size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are collected one at a time; longer arrays are joined from parts of this size, so appending never copies all that came before.
PART = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for a row; inside, reading it costs nothing, however large it is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The accumulator (of type kind) after each element: step(acc, element), from zero on. An empty array gives an empty array."""
    none = F.array().cast(f"array<{kind}>")

    def inside(state, x):
        return let(step(state["acc"], x), lambda acc: F.struct(acc.alias("acc"), F.concat(state["out"], F.array(acc)).alias("out")))

    def part(state, p):
        begin = F.struct(state["acc"].alias("acc"), none.alias("out"))
        done = F.aggregate(F.slice(items, p * PART + 1, PART), begin, inside)
        return let(done, lambda d: F.struct(d["acc"].alias("acc"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))
    begin = F.struct(zero.cast(kind).alias("acc"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(parts, begin, part, lambda state: F.flatten(state["out"]))).otherwise(none)
