"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its pivots (sampled vectors, few of a dense region),
the nearest first. Each pivot has an inverted list for every label: its members
are nearest to it, and its visitors are all others that can be within the
threshold of any member. If x is nearest to p and y is within the angle a of x,
then y . (q - p) <= sin(a) |q - p| for every pivot q, so a vector visits those
p for which that holds, and no pair is lost. Two vectors are compared, in double
precision, in the one list that `meeting` names. Long lists are cut into blocks,
and pairs of blocks go to tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, stored
from maskwright.llm.components import connected_components

#: Vectors for each pivot, and the least and most of these (the most bounds what is broadcast); sampled vectors for each pivot.
VECTORS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS, SAMPLED = 3200, 16, 256, 16
#: Pivots whose cosine is below this are apart.
APART = 0.8
#: A list's blocks hold this share of all vectors, but so many at least and at most (the most bounds what a task holds).
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 128, 256, 4096
#: Rows of a block that are compared at a time.
STRIP = 256


def usable(vector: Column) -> Column:
    """The vector as doubles, or null where it links with nothing: null, empty or zero, or with null or non-finite components."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), v)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pick_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Up to `count` unit vectors that are apart from each other, of a sample chosen by a hash of their ids so that a rerun picks the same."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(count * SAMPLED).select("v").collect()
    return apart(unit(np.array([r.v for r in rows], np.float64)), count)


def apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` of the vectors, none of which is near another: a dense region gives one or a few, whatever its share of the sample."""
    nearest, chosen = np.full(len(sample), -1.0), []
    for k in range(len(sample)):
        if len(chosen) == count:
            break
        if nearest[k] < APART:
            chosen.append(k)
            nearest = np.maximum(nearest, sample @ sample[k])
    return sample[chosen]


def meeting(p, q):
    """The one of the lists p and q in which their members meet; each list gets about half of its pairs."""
    return np.where((p + q) % 2 == 1, np.minimum(p, q), np.maximum(p, q))


def lists_of(x: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, and whether (vector x pivot) it is posted to that pivot's list."""
    near = x @ pivots.T
    home = near.argmax(1)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    reach = np.sqrt(1 - min(1.0, threshold) ** 2) if threshold > 0 else np.inf
    posted = np.ones(near.shape, bool)
    for p in range(len(pivots)):
        other = gaps[p] > 0
        posted[:, p] = ((near[:, other] - near[:, p, None]) <= reach * gaps[p, other] + 1e-9).all(1)
    numbers = np.arange(len(pivots))
    posted &= meeting(home[:, None], numbers) == numbers
    posted[np.arange(len(x)), home] = True
    return home, posted


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the links a-b join, one for each node but the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def spread(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Cuts the members and the visitors of each list (label, pivot) into blocks of about `block` rows and sends each row to all pairs of blocks that hold its own and of which one at least holds members.

    Adds b, the row's block, and i <= j, the pair of blocks; visitors' blocks follow the members'. Short lists have the one pair (0, 0), with visitors in block 1. Only the sizes of longer lists are joined back, over plain exchanges.
    """
    parts = lambda n: F.ceil(n / block).cast("int")
    counts = rows.groupBy("label", "pivot").agg(F.count(F.when(F.col("member"), 1)).alias("m"), F.count("*").alias("n"))
    big = stored(counts.filter(F.col("n") > block).select("label", "pivot", F.greatest(F.lit(1), parts(F.col("m"))).alias("mb"), parts(F.col("n") - F.col("m")).alias("vb")), name)
    long = F.col("mb").isNotNull()
    at = F.xxhash64("rep")
    b = F.when(F.col("member"), F.pmod(at, F.coalesce("mb", F.lit(1)))).otherwise(F.coalesce("mb", F.lit(1)) + F.pmod(at, F.greatest(F.lit(1), F.coalesce("vb", F.lit(1))))).cast("int")
    last = F.when(F.col("member"), F.col("mb") + F.col("vb")).otherwise(F.col("mb")) - 1
    out = rows.join(big, ["label", "pivot"], "left").withColumn("b", b).withColumn("o", F.explode(F.when(long, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
    return out.withColumn("i", F.when(long, F.least("b", "o")).otherwise(0)).withColumn("j", F.when(long, F.greatest("b", "o")).otherwise(0)).drop("mb", "vb", "o")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links join vectors of equal, non-null label and equal dimension with cosine >= threshold. Equal vectors of a label are one class: compared once, counted as often as they occur. Rows whose vector can't be used, or whose label is null, link with nothing; a null id takes no part in links either. Rows of a repeated id count as vectors of their own, with links of their own, and share its id.
    """
    spark = configure(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), usable(F.col(vector_column)).alias("v"), F.col(label_column).cast("string").alias("label"))
    good = rows.filter("id is not null and v is not null and label is not null")
    classes = stored(good.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    reps = classes.select("rep", "size", "label", "v")
    edges, degrees = [], []
    for dim in [r.d for r in reps.select(F.size("v").alias("d")).distinct().collect()]:
        part = reps.filter(F.size("v") == dim)
        n = part.count()
        pivots = pick_pivots(part, int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n // VECTORS_PER_PIVOT))))
        found = _links(part, spark.sparkContext.broadcast(pivots), threshold, int(min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))))
        edges.append(found.filter("other is not null").select("rep", "other"))
        degrees.append(found.filter("other is null").select("rep", "links"))
    if not edges:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for more in edges[1:]:
        edges[0] = edges[0].unionByName(more)
    for more in degrees[1:]:
        degrees[0] = degrees[0].unionByName(more)
    found = connected_components(edges[0])
    joined = stored(found.join(classes.select(F.col("rep").alias("node"), "least"), "node"), "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = joined.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    about = classes.join(degrees[0].groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(joined, "rep", "left")
    about = stored(about.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "vector-classes")
    out = rows.withColumn("code", F.xxhash64("label", "v")).join(about.withColumn("code", F.xxhash64("label", "v")), ["code", "label", "v"], "left")
    own = F.col("id").isNotNull() & F.col("component_id").isNotNull()
    component = F.when(own, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.when(own, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, pivots, threshold: float, block: int) -> DataFrame:
    """(rep, other, links): rows with `other` are the links of a forest, rows without carry the number of vectors linked to rep that one pair of blocks found."""

    def describe(batches):
        for b in batches:
            home, posted = lists_of(unit(matrix(b.column("v"))), pivots.value, threshold) if len(b) else (np.zeros(0, np.int64), np.zeros((0, 1), bool))
            ends = np.append(0, posted.sum(1).cumsum())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(posted)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("size"), b.column("label"), b.column("v"), pa.array(home, pa.int32()), lists], names=["rep", "size", "label", "v", "home", "pivots"])

    described = stored(mapped(reps.select("rep", "size", "label", "v"), describe, "rep long, size long, label string, v array<double>, home int, pivots array<int>"), "described")
    posted = described.withColumn("pivot", F.explode("pivots")).withColumn("member", F.col("home") == F.col("pivot")).drop("pivots", "home")
    pairs = spread(posted, block, "pivot-lists")

    def compare(key, t: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key[2:])
        rep, size, at, member = (t.column(c).to_numpy() for c in ("rep", "size", "b", "member"))
        v = unit(matrix(t.column("v").combine_chunks()))
        links, a, b = np.zeros(len(rep), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def meet(rows, cols, same):
            nonlocal a, b
            for k in range(0, len(rows), STRIP):
                near = v[rows[k : k + STRIP]] @ v[cols].T >= threshold
                if same:
                    near &= np.arange(len(cols)) > np.arange(k, k + len(near))[:, None]
                x, y = np.nonzero(near)
                if len(x):
                    x, y = rows[k + x], cols[y]
                    links[:] += np.bincount(x, size[y], len(rep)).astype(np.int64) + np.bincount(y, size[x], len(rep)).astype(np.int64)
                    new = forest(rep[x], rep[y])
                    a, b = np.concatenate([a, new[0]]), np.concatenate([b, new[1]])

        first, second = np.flatnonzero(at == i), np.flatnonzero(at == j)
        if i == j:
            first = second = np.flatnonzero(member & (at == i))
            meet(first, first, True)
            meet(first, np.flatnonzero(~member), False)  # those of a short list
        else:
            meet(first, second, False)
        if len(a):
            a, b = forest(a, b)
        some = np.flatnonzero(links)
        return pa.table({"rep": np.concatenate([a, rep[some]]), "other": pa.array([*b.tolist(), *[None] * len(some)], pa.int64()), "links": np.concatenate([np.zeros(len(a), np.int64), links[some]])})

    return stored(pairs.select("label", "pivot", "i", "j", "rep", "size", "b", "member", "v").groupBy("label", "pivot", "i", "j").applyInArrow(lambda key, t: compare(key, t), "rep long, other long, links long"), "vector-links")
