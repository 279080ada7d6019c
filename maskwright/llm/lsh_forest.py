"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each document's shingle set gives a signature, and a digest of the set by
   which equal sets become one class.
2. The forest: TREES orders of the signature, each sorted as a whole. A
   document's candidates in an order are its neighbours of longest common
   prefix, DEPTH values at least: the REACH next places on either side, and of
   the TIES next those that share as long a prefix as the last of them. So the
   depth is that of the region: short where few documents share values, up to
   2 * DEPTH values where many do. Candidates whose signatures agree enough to
   leave a similarity at the threshold possible are joined to groups.
3. Within a group every pair that the signatures leave possible is confirmed
   on full sets, but for pairs that confirmed links join already, so the
   components are those of all links within the group. Long groups are cut into
   blocks: first one block meets all others, which joins what is near a common
   text; then all that this left outside the group's largest component meets
   the whole group. Pairs of blocks go to tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, stored, utf8
from maskwright.llm.components import CHUNK, connected_components, stars
from maskwright.llm.shingles import in_chunks, jaccard_at_least, shingle_sets

TREES, DEPTH, REACH, TIES = 20, 4, 8, 32
VALUES = TREES * DEPTH
#: Signature values of two sets that must agree: the expected number at the threshold less four to five standard deviations (in the forest, of values cut to four bits).
SLACK = 4.5
#: Documents of a block.
BLOCK = 100

_RNG = np.random.default_rng(80)
_FLIP = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, one row each."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), np.uint32)
    for j in range(VALUES):
        out[:, j] = np.minimum.reduceat(((flat ^ _FLIP[j]) * _TIMES[j]) >> np.uint64(32), starts)
    return out


def least_agreeing(percent: int, collide: float = 0.0) -> int:
    p = percent / 100 + (1 - percent / 100) * collide
    return int(VALUES * p - SLACK * (VALUES * p * (1 - p)) ** 0.5)


def describe(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n, s, x, signature): the size of each document's shingle set, two 64-bit sums that stand for the set, and its signature (null if empty)."""

    def run(batches):
        for b in batches:
            n, s, x, sig = [], [], [], []
            for part in in_chunks([t.as_py() for t in b.column(1)]):
                sets = shingle_sets(part, words)
                full = [v for v in sets if len(v)]
                rows = iter(signatures(full) if full else ())
                for v in sets:
                    n.append(len(v))
                    s.append(int(v.sum(dtype=np.uint64).view(np.int64)))
                    x.append(int((v * (v >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(next(rows).tobytes() if len(v) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "s", "x", "signature"])

    return mapped(docs.select(F.col(id_column).cast("long").alias("id"), utf8(text_column).alias("text")), run, "id long, n long, s long, x long, signature binary")


def plant(reps: DataFrame) -> DataFrame:
    """(key, deep, rep, code): a row for each tree. key: the tree and the first DEPTH values of its order; deep: further values; code: all values cut to four bits."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(len(b), VALUES)
            low = (sig & 15).astype(np.uint8)
            code = (low[:, ::2] << 4 | low[:, 1::2]).tobytes()
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUES // 2), len(b), [None, pa.py_buffer(code)]).cast(pa.binary())
            wide = np.concatenate([sig, sig], axis=1).astype(np.uint64)
            for t in range(TREES):
                key = np.full(len(b), t + 1, np.uint64)
                for v in range(t * DEPTH, t * DEPTH + DEPTH):
                    key = (key ^ wide[:, v]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                deep = np.zeros(len(b), np.uint64)
                for v in range(t * DEPTH + DEPTH, t * DEPTH + 2 * DEPTH):
                    deep = deep << np.uint64(16) | (wide[:, v] & np.uint64(0xFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(deep.view(np.int64)), b.column(0), codes], names=["key", "deep", "rep", "code"])

    return mapped(reps.select("rep", "signature"), run, "key long, deep long, rep long, code binary")


def common_prefix(key: np.ndarray, deep: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values of their order the rows x and y share from the first on: 0 below DEPTH, 2 * DEPTH at most."""
    apart = (deep[x] ^ deep[y]).view(np.uint64)
    more = sum(((apart >> np.uint64(16 * (DEPTH - k))) == 0).astype(np.int8) for k in range(1, DEPTH)) + (apart == 0)
    return np.where(key[x] == key[y], DEPTH + more, 0)


def near_places(key: np.ndarray, deep: np.ndarray, old: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate places (x, y) of a sorted order, x < y, with y from `old` on."""
    n, out = len(key), []
    edge = common_prefix(key, deep, np.arange(max(0, n - REACH)), np.arange(min(REACH, n), n))
    for o in range(1, min(TIES, n - 1) + 1):
        x = np.arange(max(0, old - o), n - o)
        x = x[key[x] == key[x + o]]
        if o > REACH:
            x = x[common_prefix(key, deep, x, x + o) >= np.minimum(edge[x], edge[x + o - REACH])]
        out.append((x, x + o))
    return out


def neighbours(forest: DataFrame, least: int) -> DataFrame:
    """Links (a, b) that join the documents which are neighbours in a tree's order and of whose cut values `least` agree. Each task gives its links as stars, so their number follows that of its rows, not of its neighbours."""

    def joined(xs, ys):
        v, u = stars(np.concatenate(xs), np.concatenate(ys))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])

    def run(batches):
        key, deep, rep, code = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, VALUES // 2), np.uint8)
        xs, ys, held = [], [], 0
        for b in batches:
            old = len(key)
            key, deep, rep = (np.append(have, b.column(k).to_numpy()) for k, have in enumerate((key, deep, rep)))
            code = np.concatenate([code, np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, VALUES // 2)])
            for x, y in near_places(key, deep, old):
                apart = code[x] ^ code[y]
                alike = ((apart & 0xF0) == 0).sum(1) + ((apart & 0x0F) == 0).sum(1) >= least
                xs.append(rep[x[alike]])
                ys.append(rep[y[alike]])
                held += len(xs[-1])
            if held >= CHUNK:
                yield joined(xs, ys)
                xs, ys, held = [], [], 0
            key, deep, rep, code = key[-TIES:], deep[-TIES:], rep[-TIES:], code[-TIES:]
        if held:
            yield joined(xs, ys)

    ordered = forest.repartitionByRange("key", "deep", "rep").sortWithinPartitions("key", "deep", "rep")
    return mapped(ordered.select("key", "deep", "rep", "code"), run, "a long, b long").filter("a < b")


def links_of(ids: np.ndarray, block: np.ndarray, texts: list[bytes], i: int, j: int, words: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join, within blocks i and j, what all links between the two join (within one block if i == j)."""
    sets = [s for part in in_chunks(texts) for s in shingle_sets(part, words)]
    sig, size = signatures(sets), np.array([len(s) for s in sets])
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    least, found = least_agreeing(percent), []
    for x in np.flatnonzero(block == i):
        others = np.flatnonzero(block == j)
        others = others[others > x] if i == j else others
        others = others[100 * np.minimum(size[x], size[others]) >= percent * np.maximum(size[x], size[others])]
        if len(others):
            agree = (sig[others] == sig[x]).sum(1)
            found += [(-int(g), int(x), int(y)) for g, y in zip(agree, others, strict=True) if g >= least]
    out = []
    for _, x, y in sorted(found):
        a, b = root(x), root(y)
        if a != b and jaccard_at_least(sets[x], sets[y], percent):
            parent[a] = b
            out.append((int(ids[x]), int(ids[y])))
    return out


def near_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Links join documents whose sets of `words`-word shingles satisfy 100 * intersection >= percent * union. Null and blank texts have empty sets and link with nothing, as do rows without id. Equal sets are one class; rows that repeat an id are one node of the links, and each keeps its row. No documents give an empty table.
    """
    configure(docs.sparkSession)
    seen = stored(describe(docs, words, id_column, text_column), "shingles")
    full = seen.filter("id is not null and n > 0")
    reps = stored(full.groupBy("n", "s", "x").agg(F.min(F.struct("id", "signature")).alias("r")).select("n", "s", "x", F.col("r.id").alias("rep"), "r.signature"), "classes")
    groups = connected_components(neighbours(plant(reps), least_agreeing(percent, 1 / 16)))
    texts = docs.select(F.col(id_column).cast("long").alias("rep"), utf8(text_column).alias("text"))

    def compare(key, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        some = [k for k, x in enumerate(t.column("text").to_pylist()) if x.split()]
        t = t.take(some)
        found = links_of(t.column("rep").to_numpy(), t.column("b").to_numpy(), t.column("text").to_pylist(), i, j, words, percent) if some else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    def confirmed(members: DataFrame) -> DataFrame:
        pairs = members.join(texts, "rep").select("group", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "text")
        return pairs.groupBy("group", "i", "j").applyInArrow(lambda key, t: compare(key, t), "a long, b long")

    sized = _cut_groups(groups)
    links = stored(confirmed(_first_block_with_all(sized)), "links")
    found = connected_components(links)
    if not (big := sized.filter("blocks > 1")).isEmpty():
        rest = stored(_rest_with_all(big, found), "groups")
        if not rest.isEmpty():
            found = connected_components(links.unionByName(confirmed(rest)))
    classes = stored(reps.select("n", "s", "x", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s", "x", F.coalesce("component", "rep").alias("component")), "classes")
    out = seen.select("id", "n", "s", "x").join(classes, ["n", "s", "x"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_documents keeps: one document of each component. Rows without id stay."""
    gone = near_documents(docs, words, percent, id_column, text_column).filter("not kept").select(id_column).distinct()
    return docs.join(gone, id_column, "left_anti").select(docs.columns)


def _cut_groups(groups: DataFrame) -> DataFrame:
    """(rep, group, blocks): each document's group and the number of its blocks."""
    big = stored(groups.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "groups")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    return stored(groups.join(big, "component", "left").select(F.col("node").alias("rep"), F.col("component").alias("group"), blocks.alias("blocks")), "groups")


def _block(first: Column, blocks: Column) -> Column:
    return first + F.pmod(F.xxhash64("rep"), blocks).cast("int")


def _first_block_with_all(sized: DataFrame) -> DataFrame:
    """(group, rep, b, o): pairs (b, o) of blocks that need the document, for each group's first block with itself and all others."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    out = sized.withColumn("b", _block(F.lit(0), F.col("blocks")))
    return out.select("group", "rep", "b", F.explode(F.when(F.col("b") == 0, every).otherwise(F.array(F.lit(0)))).alias("o"))


def _rest_with_all(big: DataFrame, found: DataFrame) -> DataFrame:
    """(group, rep, b, o) as above, for the documents outside of their group's largest component in `found` with each other and with those inside."""
    placed = stored(big.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "group", F.coalesce("component", "rep").alias("component")), "groups")
    sizes = placed.groupBy("group", "component").agg(F.count("*").alias("n"))
    least = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).filter("n > main.n")
    plan = stored(least.select("group", F.col("main.component").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("inside")), "groups")
    out = placed.join(plan, "group").withColumn("in", F.col("component") == F.col("main"))
    b = F.when(F.col("in"), _block(F.col("rest"), F.col("inside"))).otherwise(_block(F.lit(0), F.col("rest")))
    last = F.when(F.col("in"), F.col("rest")).otherwise(F.col("rest") + F.col("inside")) - 1
    return out.select("group", "rep", b.alias("b"), F.explode(F.sequence(F.lit(0), last)).alias("o"))
