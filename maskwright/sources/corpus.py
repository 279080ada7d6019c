"""A benchmark corpus: documents of four sizes and three densities of personal data, the same for equal seeds."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIZES = {"100B": 100, "1KB": 1 << 10, "10KB": 10 << 10, "1MB": 1 << 20}
#: Words between two values; 0: no values.
DENSITIES = {"none": 0, "sparse": 60, "dense": 8}
SCHEMA = "id string, size_class string, density string, text string"
_WORDS = "the report shows that most teams moved their work early and found a new way to plan the next season with care".split()


def card(rng: random.Random) -> str:
    """Sixteen digits that pass the Luhn check."""
    digits = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
    return "".join(map(str, [*digits, -total % 10]))


def value(rng: random.Random) -> str:
    kind = rng.randrange(3)
    if kind == 0:
        return f"user{rng.randrange(10**6)}@example.com"
    return card(rng) if kind == 1 else ".".join(str(rng.randrange(1, 255)) for _ in range(4))


def document(size: int, every: int, rng: random.Random) -> str:
    """A text of exactly `size` bytes; a value that would be cut at the end is left out."""
    parts, n, k = [], 0, 0
    while n < size:
        k += 1
        word = value(rng) if every and k % every == 0 else rng.choice(_WORDS)
        if n + len(word) > size:
            word = "." * (size - n)
        parts.append(word)
        n += len(word) + 1
    return " ".join(parts).ljust(size, ".")[:size]


def corpus(spark: SparkSession, per_group: int = 10, seed: int = 42, sizes: dict[str, int] | None = None) -> DataFrame:
    """(id, size_class, density, text): per_group documents of every size and density, each drawn from the seed and its own id."""
    kinds = [(s, n, d, e) for s, n in (sizes or SIZES).items() for d, e in DENSITIES.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                s, n, d, e = kinds[i % len(kinds)]
                name = f"{s}-{d}-{i // len(kinds)}"
                yield pd.DataFrame([(name, s, d, document(n, e, random.Random(f"{seed}/{name}")))], columns=["id", "size_class", "density", "text"])

    return spark.range(per_group * len(kinds)).mapInPandas(run, SCHEMA)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a JSON Lines file."""
    return spark.read.schema(SCHEMA).json(path)
