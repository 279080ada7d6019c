"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and a tail. The tails' length histogram,
in classes of STEP tokens, is a cutting-stock problem: a linear program over
patterns (how many tails of each class share a sequence), whose columns are
priced by a knapsack dynamic program. Its solution, rounded down, is dealt to
the documents by their rank within their class. The other tails, a few of a
hundred, are cut to fill what the patterns leave open; what then remains makes
full sequences and a few whose length is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.bpe import encoded, newer, shared_bpe
from maskwright.llm.common import configure, mapped, stored, utf8

#: Tokens of a sequence, of a length class, and the id that ends a document.
LENGTH, STEP, END_ID = 4096, 32, 2
CLASSES = LENGTH // STEP
#: Rows of a bucket in which ranks and running sums are counted before the buckets' own are added.
BUCKET_ROWS = 1000


def price(duals: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of greatest worth: unbounded knapsack over class sizes 1..CLASSES with capacity CLASSES."""
    sizes = np.arange(1, len(duals) + 1)
    best, took = np.zeros(len(duals) + 1), np.zeros(len(duals) + 1, int)
    for room in range(1, len(best)):
        worth = duals[:room] + best[room - sizes[:room]]
        k = int(worth.argmax())
        best[room], took[room] = (worth[k], k + 1) if worth[k] > best[room - 1] else (best[room - 1], 0)
    pattern, room = np.zeros(len(duals), int), len(duals)
    while room:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return best[-1], pattern


def solve(demand: np.ndarray, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each is used) of the relaxed cutting-stock problem, by the revised simplex method with generated columns."""
    have = np.flatnonzero(demand)
    if not len(have):
        return np.zeros((0, len(demand)), int), np.zeros(0)
    columns = []
    for k in have:
        p = np.zeros(len(demand), int)
        p[k] = len(demand) // (k + 1)
        columns.append(p)
    need = demand[have].astype(float)
    inverse = np.diag([1.0 / (len(demand) // (k + 1)) for k in have])
    x = inverse @ need
    for _ in range(rounds):
        duals = np.zeros(len(demand))
        duals[have] = np.maximum(inverse.sum(0), 0)
        worth, pattern = price(duals)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern[have]
        rows = np.flatnonzero(direction > 1e-10)
        out = rows[(x[rows] / direction[rows]).argmin()]
        columns[out] = pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        x = np.maximum(inverse @ need, 0)
    else:
        raise RuntimeError(f"the linear program isn't solved after {rounds} columns")
    return np.array(columns), x


class Plan:
    """Sequences 0..count-1 by pattern, and where the tail of each class and rank goes."""

    def __init__(self, lengths: np.ndarray):
        """lengths: how many tails have each length 0..LENGTH - 1."""
        cls = np.maximum(1, -(-np.arange(LENGTH) // STEP)) - 1
        lengths = np.where(np.arange(LENGTH) > 0, lengths, 0)
        demand = np.bincount(cls, lengths, CLASSES).astype(np.int64)
        tokens = np.bincount(cls, lengths * np.arange(LENGTH), CLASSES)
        mean = tokens / np.maximum(demand, 1)
        patterns, x = solve(demand)
        times = np.floor(x + 1e-9).astype(np.int64)
        # as many sequences are given up as it takes for the tails left over to fill the others' gaps
        for _ in range(60):
            used = (patterns * times[:, None]).sum(0) if len(times) else np.zeros(CLASSES, np.int64)
            over = np.maximum(used - demand, 0)
            open_ = float((times * (LENGTH - patterns @ mean)).sum()) + float(over @ mean) if len(times) else 0.0
            rest = float(np.maximum(demand - used, 0) @ mean)
            if rest >= 1.03 * open_ + 2 * LENGTH or not times.sum():
                break
            times = np.floor(times * max(0.0, 1 - max(0.002, 0.7 * (1.03 * open_ + 2 * LENGTH - rest) / max(1.0, times.sum() * LENGTH)))).astype(np.int64)
        self.patterns, self.times = patterns, times
        self.base = np.append(0, np.cumsum(times))
        self.count = int(self.base[-1])

    def place(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The sequence of each tail, -1 for those left over."""
        out = np.full(len(cls), -1, np.int64)
        for c in np.unique(cls):
            mine = np.flatnonzero(cls == c)
            each = self.patterns[:, c] if len(self.patterns) else np.zeros(0, int)
            ends = np.cumsum(each * self.times)
            if not len(ends) or not ends[-1]:
                continue
            mine = mine[rank[mine] < ends[-1]]
            p = np.searchsorted(ends, rank[mine], side="right")
            within = rank[mine] - (ends[p] - each[p] * self.times[p])
            out[mine] = self.base[p] + within // each[p]
        return out


def tokenized(docs: DataFrame, vocabulary: str, id_column: str, text_column: str) -> DataFrame:
    """(row, id, n, crc, ids): each text's ids and the end id, as unsigned 16-bit integers, or 32-bit ones if one of them needs it; n tokens; the CRC-32 of all as 32-bit integers."""
    kind, unlike = docs.schema[id_column].dataType.simpleString(), newer(vocabulary)

    def run(batches):
        bpe = shared_bpe(vocabulary, unlike)
        for b in batches:
            n, crc, raw = [], [], []
            for ids in encoded(bpe, b.column(2)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
                raw.append((ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())], names=["row", "id", "n", "crc", "ids"])
        bpe.rest()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), utf8(text_column).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, n long, crc long, ids binary")


def running(df: DataFrame, key: str, value: str, name: str, buckets: int, within: list[str] | None = None) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows before this one (of the same `within`) in the order of a hash bucket and key; buckets are counted apart, so no task holds all rows."""
    within = within or []
    df = df.withColumn("bucket", F.pmod(F.xxhash64(key, F.lit(name)), F.lit(buckets)))
    part = Window.partitionBy(*within, "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = df.groupBy(*within, "bucket").agg(F.sum(value).alias("total")).withColumn("ahead", F.coalesce(F.sum("total").over(whole), F.lit(0))).drop("total")
    df = df.withColumn(name, F.coalesce(F.sum(value).over(part), F.lit(0)))
    return df.join(ahead, [*within, "bucket"]).withColumn(name, F.col(name) + F.col("ahead")).drop("ahead", "bucket")


def cells(df: DataFrame, begin: str, length: str) -> DataFrame:
    """One row for each stretch of LENGTH coordinates that [begin, begin + length) touches."""
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(begin) / LENGTH), F.floor((F.col(begin) + F.col(length) - 1) / LENGTH))))


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents.

    A null text is empty and has the end id alone; repeated rows are packed as documents of their own; no documents give no pieces. A sequence's pieces lie without gaps from 0; sequences other than those of the last few have LENGTH tokens, or as many as a power of two.
    """
    spark = configure(docs.sparkSession)
    ids = stored(tokenized(docs, vocabulary, id_column, text_column), "tokens")
    light = ids.select("row", "n")
    buckets = max(1, light.count() // BUCKET_ROWS)
    tail = F.col("n") % LENGTH
    lengths = np.zeros(LENGTH, np.int64)
    for r in light.groupBy(tail.cast("int").alias("tail")).count().collect():
        lengths[r["tail"]] = r["count"]
    plan = Plan(lengths)

    def place(batches):
        for b in batches:
            at = plan.place(b.column("cls").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("begin"), b.column("tail"), pa.array(at)], names=["row", "begin", "tail", "sequence"])

    tails = light.select("row", (F.col("n") - tail).alias("begin"), tail.alias("tail")).filter("tail > 0").withColumn("cls", (F.ceil(F.col("tail") / STEP) - 1).cast("long")).withColumn("one", F.lit(1))
    ranked = running(tails, "row", "one", "rank", buckets, ["cls"])
    placed = stored(mapped(ranked.select("row", "begin", "tail", "cls", "rank"), place, "row long, begin long, tail long, sequence long"), "placed")
    inside = placed.filter("sequence >= 0")
    order = Window.partitionBy("sequence").orderBy(F.desc("tail"), "row")
    whole = inside.withColumn("offset", F.coalesce(F.sum("tail").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("row", F.col("begin").alias("start"), F.col("tail").alias("length"), "sequence", "offset")

    loose = placed.filter("sequence < 0")
    spare = loose.agg(F.coalesce(F.sum("tail"), F.lit(0))).first()[0]
    used = inside.groupBy("sequence").agg(F.sum("tail").alias("used"))
    gaps = used.filter(F.col("used") < LENGTH).select("sequence", F.col("used").alias("from"), (LENGTH - F.col("used")).alias("room"))
    gaps = stored(running(gaps, "sequence", "room", "at", buckets), "gaps")
    open_ = gaps.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    # beyond the gaps, loose tails go on in sequences of their own: full ones, then powers of two
    more, last = divmod(max(0, spare - open_), LENGTH)
    fresh = spark.range(more).select((F.col("id") + plan.count).alias("sequence"), F.lit(0).cast("long").alias("from"), F.lit(LENGTH).cast("long").alias("room"), (F.col("id") * LENGTH + open_).alias("at"))
    bits, rows = [1 << k for k in range(12, -1, -1) if last >> k & 1], []
    for k, size in enumerate(bits):
        rows.append((plan.count + more + k, 0, size, open_ + more * LENGTH + sum(bits[:k])))
    room = gaps.select("sequence", "from", "room", "at").unionByName(fresh).unionByName(spark.createDataFrame(rows, "sequence long, from long, room long, at long"))
    liquid = running(loose, "row", "tail", "pos", buckets)
    both = cells(room, "at", "room").join(cells(liquid.select("row", "begin", "tail", "pos"), "pos", "tail"), "cell")
    low = F.greatest("at", "pos", F.col("cell") * LENGTH)
    high = F.least(F.col("at") + F.col("room"), F.col("pos") + F.col("tail"), (F.col("cell") + 1) * LENGTH)
    poured = both.withColumn("low", low).withColumn("high", high).filter("low < high")
    poured = poured.groupBy("row", "begin", "pos", F.col("sequence"), "from", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    poured = poured.select("row", (F.col("begin") + F.col("low") - F.col("pos")).alias("start"), (F.col("high") - F.col("low")).alias("length"), "sequence", (F.col("from") + F.col("low") - F.col("at")).alias("offset"))

    full = light.filter(F.col("n") >= LENGTH).withColumn("pieces", F.floor(F.col("n") / LENGTH))
    full = running(full, "row", "pieces", "first", buckets).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    full = full.select("row", (F.col("k") * LENGTH).alias("start"), F.lit(LENGTH).cast("long").alias("length"), (F.col("first") + F.col("k") + plan.count + more + len(bits)).alias("sequence"), F.lit(0).cast("long").alias("offset"))

    pieces = whole.unionByName(poured).unionByName(full).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence", "offset")).alias("pieces"))
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches):
        for b in batches:
            out = []
            for i, n, crc, raw, parts in zip(*(b.column(c).to_pylist() for c in ("id", "n", "crc", "ids", "pieces")), strict=True):
                x = None
                for p in parts:
                    own = crc
                    if p["length"] != n:
                        x = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4") if x is None else x
                        own = zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes())
                    out.append((i, p["start"], p["length"], own, n, p["sequence"], p["offset"]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), b.column("id").type), *(pa.array(list(c), pa.int64()) for c in cols[1:])], names=[id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return mapped(ids.join(pieces, "row").select("id", "n", "crc", "ids", "pieces"), cut, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
