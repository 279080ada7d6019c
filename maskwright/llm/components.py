"""Connected components by alternating large-star and small-star rounds.

First each task replaces the links it holds by stars, in chunks of bounded
size: long chains of neighbours, which would take many rounds, mostly end there.
If few links are left, one task ends the job, as a round costs several tables
however small they are. Else every round replaces links by links to the smallest neighbour, first towards
larger nodes, then towards smaller ones, until all links are stars. Joins have
a plain exchange on either side, so adaptive execution splits a hub's rows;
minima are pre-aggregated. Each round ends in a table of the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import discard, mapped, stored


#: Links that a task joins to stars at a time.
CHUNK = 1_000_000
#: Links, at most CHUNK, that one task joins to the end; where more are left, rounds do.
ONE_TASK = 100_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node of the given ones to the smallest node that they reach, which join the same nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(far := low[low], low):
            low = far
    far = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[far], nodes[low[far]]


def _local_stars(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: the links (u, v) of each task as stars."""

    def run(batches):
        held, n = [], 0

        def joined():
            x, y = stars(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += len(b)
            if n >= CHUNK:
                yield joined()
                held, n = [], 0
        if held:
            yield joined()

    return mapped(links, run, "u long, v long")


def _minima(pairs: DataFrame, name: str) -> DataFrame:
    """(u, m): the smallest of u and its neighbours."""
    return stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: two columns of node ids (long). Returns (node, component), component the smallest node reachable; only nodes that have a link appear.

    Null ends and loops are ignored; repeated links count once; no links give an empty table.
    """
    a, b = links.columns[:2]
    e = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v")
    e = stored(_local_stars(e).distinct(), "cc")
    seen = _digest(e)
    if few := seen[0] <= min(ONE_TASK, CHUNK):
        parts, e = e, stored(_local_stars(e.coalesce(1)), "cc")
        discard(parts)
    for _ in range(rounds):
        if few:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both, "cc-min")
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        discard(e, least)
        low = _minima(large, "cc-min")
        hub = low.select("u", F.col("m").alias("v"))
        rest = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(hub.unionByName(rest).distinct(), "cc")
        discard(large, low)
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
