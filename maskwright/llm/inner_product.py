"""Maximum inner product search with score-aware (anisotropic) quantisation.

A code of four bits for each dimension is chosen so that a vector's residual
parallel to it costs more than the rest: that part moves the large inner
products. Queries scan lookup tables over the codes of all candidates, block by
block. The best by code are ranked by exact inner products, which gives a score
that the nearest must reach, and then only those candidates are whose code and
length of residual leave it open, so none of the nearest is lost. Of equal
vectors only as many can be among the nearest as are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, stored
from maskwright.llm.embeddings import matrix, unit, usable

#: Codewords of a dimension.
WORDS = 16
#: Share of the norm from which on inner products matter: sets how much dearer parallel residuals are.
CARE = 0.2
#: Vectors that codebooks are fitted on, at most; rounds of fitting; passes over the dimensions when encoding.
SAMPLE, ROUNDS, PASSES = 8192, 8, 2
#: Queries and candidates of a block; candidates of a block whose exact scores set what the others must reach (no cap).
QUERY_BLOCK, BLOCK, RERANK = 4096, 8192, 64
#: Queries of a block that are scanned at a time, and pairs that are scored at a time.
SCANNED, SCORED = 256, 100_000


class Codebooks:
    """Codewords (dimension, word) and the encoder for them."""

    def __init__(self, x: np.ndarray):
        self.dim = x.shape[1]
        self.extra = max(0.0, (self.dim - 1) * CARE**2 / (1 - CARE**2) - 1)
        self.words = np.quantile(x, (np.arange(WORDS) + 0.5) / WORDS, axis=0).T.copy()
        for _ in range(ROUNDS):
            self._refit(x, self._encode(x))

    def _encode(self, x: np.ndarray) -> np.ndarray:
        u = unit(x)
        codes = np.stack([np.abs(x[:, m, None] - self.words[m]).argmin(1) for m in range(self.dim)], 1)
        own = lambda m: (x[:, m] - self.words[m][codes[:, m]]) * u[:, m]
        along = sum(own(m) for m in range(self.dim))
        for _ in range(PASSES):
            for m in range(self.dim):
                rest = along - own(m)
                r = x[:, m, None] - self.words[m]
                codes[:, m] = (r * r + self.extra * (rest[:, None] + r * u[:, m, None]) ** 2).argmin(1)
                along = rest + own(m)
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        u = unit(x)
        own = (x - self.words[np.arange(self.dim), codes]) * u
        along = own.sum(1)
        for m in range(self.dim):
            weight = 1 + self.extra * u[:, m] ** 2
            wanted = x[:, m] * weight + self.extra * u[:, m] * (along - own[:, m])
            total, sums = (np.bincount(codes[:, m], w, WORDS) for w in (weight, wanted))
            self.words[m][total > 0] = sums[total > 0] / total[total > 0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two codes in each byte."""
        codes = self._encode(x) if len(x) else np.zeros((0, self.dim), np.int64)
        codes = np.pad(codes, ((0, 0), (0, self.dim % 2))).astype(np.uint8)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the codes leave of each vector."""
        halves = np.stack([codes >> 4, codes & 15], 2).reshape(len(codes), -1)[:, : self.dim]
        rest = x - self.words[np.arange(self.dim), halves]
        return np.sqrt((rest * rest).sum(1))

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of all queries with all coded vectors, summed up from tables."""
        table = (queries.T[:, None, :] * self.words[:, :, None]).astype(np.float32)
        table = np.pad(table, ((0, self.dim % 2), (0, 0), (0, 0)))
        out = np.zeros((len(codes), len(queries)), np.float32)
        for k in range(codes.shape[1]):
            both = (table[2 * k][:, None] + table[2 * k + 1][None]).reshape(WORDS * WORDS, -1)
            out += both[codes[:, k]]
        return np.ascontiguousarray(out.T)


def few_of_each(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows without those of which n others with smaller ids have the same vector."""
    bytes_ = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    group = np.unique(bytes_, return_inverse=True)[1]
    order = np.lexsort((ids, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[place < n])


def _products(v: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each pair (v[a], x[b]), in double precision, each summed alike."""
    return np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", v[a[k : k + SCORED]], x[b[k : k + SCORED]]) for k in range(0, len(a), SCORED)])


def search_block(books: Codebooks, ids: np.ndarray, q: np.ndarray, cand: np.ndarray, codes: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, candidate, score) of the `top` best of a block for each query, by exact score, ties to smaller ids; and how many exact scores that took."""
    kept = few_of_each(cand, x, top + 1)  # one of them may be the query's own
    cand, codes, x = cand[kept], codes[kept], x[kept]
    found, scored = [], 0
    left, longest = books.residuals(x, codes), np.sqrt((x * x).sum(1))
    for at in range(0, len(ids), SCANNED):
        mine, v = ids[at : at + SCANNED], q[at : at + SCANNED]
        own = mine[:, None] == cand
        size = np.sqrt((v * v).sum(1))[:, None]
        near = np.where(own, -np.inf, books.scan(v, codes))
        take = min(max(RERANK, top + 1), len(cand))
        first = np.argpartition(-near, take - 1, axis=1)[:, :take]
        exact = _products(v, x, np.repeat(np.arange(len(v)), take), first.ravel()).reshape(first.shape)
        exact[np.take_along_axis(own, first, 1)] = -np.inf
        least = np.partition(exact, take - min(top, take), axis=1)[:, take - min(top, take)]
        # tables are summed in single precision
        a, b = np.nonzero((near + size * left + 1e-4 * size * (longest + left) >= least[:, None]) & ~own)
        score = _products(v, x, a, b)
        scored += first.size + len(a)
        order = np.lexsort((cand[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        best = np.arange(len(a)) - np.searchsorted(a, a) < top
        found.append((mine[a[best]], cand[b[best]], score[best]))
    return *(np.concatenate(c) for c in zip(*found, strict=True)), scored


def nearest_by_inner_product(vectors: DataFrame, top: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, the `top` other rows of largest inner product found.

    Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part; vectors of another dimension than the query's are no candidates of it. Rows of a repeated id are one candidate, the one of the greatest vector. Scores are inner products of the original vectors in double precision; equal scores rank by smaller id.
    """
    spark = configure(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), usable(F.col(vector_column)).alias("v")).filter("id is not null and v is not null")
    rows = rows.groupBy("id").agg(F.max("v").alias("v"))
    results = None
    for dim in [r.d for r in rows.select(F.size("v").alias("d")).distinct().collect()]:
        part = rows.filter(F.size("v") == dim)
        found = _search(part, Codebooks(np.array([r.v for r in part.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])), top, every)
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= top)
    return best.select("query_id", "rank", "vec_id", "score")


def _search(part: DataFrame, books: Codebooks, top: int, every: int) -> DataFrame:
    def encode(batches):
        for b in batches:
            codes = books.encode(matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "codes"])

    coded = stored(mapped(part, encode, "id long, v array<double>, codes binary"), "coded")
    n, queries = coded.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    part_of = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = coded.filter(F.col("id") % every == 0).withColumn("qb", part_of(query_blocks)).withColumn("cb", each(blocks)).withColumn("asks", F.lit(True))
    given = coded.withColumn("cb", part_of(blocks)).withColumn("qb", each(query_blocks)).withColumn("asks", F.lit(False))

    def run(t: pa.Table) -> pa.Table:
        asks, ids, x = t.column("asks").to_numpy(), t.column("id").to_numpy(), matrix(t.column("v").combine_chunks())
        codes = np.frombuffer(b"".join(t.filter(pc.invert(t.column("asks"))).column("codes").to_pylist()), np.uint8)
        if asks.all() or not asks.any():
            a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            a, b, s, _ = search_block(books, ids[asks], x[asks], ids[~asks], codes.reshape((~asks).sum(), -1), x[~asks], top)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return asked.unionByName(given).select("qb", "cb", "asks", "id", "v", "codes").groupBy("qb", "cb").applyInArrow(run, "query_id long, vec_id long, score double")
