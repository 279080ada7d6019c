"""Importance resampling towards a target distribution, by a dictionary of the distinct features.

Runs of words are counted as strings. A task numbers the distinct strings of
some megabytes of text at a time (a chunk) and keeps each document's counts by
these numbers, so only a chunk's distinct strings are shuffled, each once,
however often documents repeat it: no string has more rows than there are
chunks. Summed up they are the dictionary of all distinct strings, each of
which is hashed once. Buckets add up the strings' counts, the buckets' gains
go back to the strings and from there to the chunks that hold them, where they
are added up over each document's own counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.bpe import ragged
from maskwright.llm.common import ARROW_BYTES, configure, discard, mapped, slices, stored, valid

#: Bytes of text that are cut into words at a time, where a longer text is cut into parts; those whose strings are numbered together, with what a row counts for besides.
PART_BYTES, CHUNK_BYTES, ROW_BYTES = 4 << 20, 16 << 20, 64
#: Buckets, at most: their gains are broadcast.
MOST_BUCKETS = 1 << 20
#: Fixed values of the features: the bytes that separate words, and A-Z in lower case.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP, _WORD = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"), re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Resampling:
    """longest: words of a feature, at most. buckets: features are counted by crc32 modulo this. share: of 100 documents with `least` words or more, those drawn. seed: of the random part of the scores."""

    longest: int = 1
    buckets: int = 10_000
    share: int = 10
    least: int = 20
    seed: int = 2024

    def __post_init__(self):
        if not 1 <= self.buckets <= MOST_BUCKETS or self.longest < 1:
            raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}, and features have a word at least")


def parts_of(text: bytes, longest: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """A text's parts of about `limit` bytes, cut between words, each with the `longest` - 1 words that follow it; features that begin within the given bytes are the part's own."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        stop = end
        for _ in range(longest - 1):
            more = _WORD.search(text, stop)
            stop = more.end() if more else stop
        yield text[at:stop], end - at
        at = end


def features(texts: list[bytes], own: list[int], longest: int) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All runs of 1 to `longest` consecutive words that begin within each text's own bytes, joined by one space, as numbered strings; the text that each lies in; each text's number of words."""
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(LOWER), np.uint8)
    gap = GAP[raw]
    edge = np.diff((~gap).astype(np.int8), prepend=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    stop = np.cumsum(size)
    owner = np.searchsorted(stop, first, side="right")
    mine = first - (stop - size)[owner] < np.array(own, np.int64)[owner]
    # the words one after the other, a space behind each
    kept = ~gap | np.append(False, ~gap[:-1])
    letters = np.where(gap, np.uint8(32), raw)[kept]
    at = np.append(0, np.cumsum(end - first + 1))
    strings, owners = [], []
    for n in range(1, longest + 1):
        k = np.flatnonzero(mine[: max(0, len(owner) - n + 1)] & (owner[n - 1 :] == owner[: max(0, len(owner) - n + 1)]))
        length = at[k + n] - 1 - at[k]
        offsets = np.append(0, np.cumsum(length))
        strings.append(pa.Array.from_buffers(pa.large_string(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(ragged(letters, at[k], length))]))
        owners.append(owner[k])
    return pa.concat_arrays(strings).dictionary_encode(), np.concatenate(owners), np.bincount(owner[mine], minlength=len(texts))


def _counted(rows: DataFrame, longest: int) -> DataFrame:
    """(chunk, part, id, n_words, n_features, codes, counts, words, totals): a row for each text, or part of a long one (part: what these share, else null), with its distinct features by number and how often each occurs, as 32-bit integers. The first row of a chunk has the chunk's strings by number and their totals. Stored, as chunks are numbered by the tasks that made them."""

    def chunk(number: int, part: int | None, held: list) -> pa.RecordBatch:
        """The rows of held (ids, strings, owners, words), whose strings are numbered anew as one."""
        strings = pa.chunked_array([x for _, x, _, _ in held]).unify_dictionaries()
        words, of = np.concatenate([w for *_, w in held]), strings.chunk(0).dictionary
        codes = np.concatenate([x.indices.to_numpy() for x in strings.chunks])
        firsts = np.cumsum([0] + [len(w) for *_, w in held])
        owner = np.concatenate([o + first for (_, _, o, _), first in zip(held, firsts, strict=False)])
        rows, distinct = len(words), max(1, len(of))
        pairs, counts = np.unique(owner * distinct + codes, return_counts=True)
        ends = np.searchsorted(pairs, np.arange(rows + 1) * distinct)
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        once = lambda x: pa.ListArray.from_arrays(pa.array(np.append(0, np.full(rows, len(of))), pa.int32()), x)
        named = lambda x: pa.array([x] * rows, pa.int64())
        columns = [named(number), named(part), pa.concat_arrays([i for i, *_ in held]), pa.array(words), pa.array(np.bincount(owner, minlength=rows))]
        columns += [cut((pairs % distinct).astype("<i4")), cut(counts.astype("<i4")), once(of.cast(pa.string())), once(pa.array(np.bincount(codes, minlength=len(of))))]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "id", "n_words", "n_features", "codes", "counts", "words", "totals"])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for rows in slices(batch, PART_BYTES):
                texts, ids = rows.column(1).to_pylist(), rows.column(0)
                if len(texts) == 1 and len(texts[0]) > PART_BYTES:
                    whole = number
                    for text, own in parts_of(texts[0], longest, PART_BYTES):
                        yield chunk(number, whole, [(ids, *features([text], [own], longest))])
                        number += 1
                elif texts:
                    held.append((ids, *features(texts, list(map(len, texts)), longest)))
                    size += sum(map(len, texts)) + ROW_BYTES * len(texts)
                if size > CHUNK_BYTES:
                    yield chunk(number, None, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk(number, None, held)

    kind = rows.schema["id"].dataType.simpleString()
    return stored(mapped(rows, run, f"chunk long, part long, id {kind}, n_words long, n_features long, codes binary, counts binary, words array<string>, totals array<long>"), "features")


def _strings(counted: DataFrame) -> DataFrame:
    """(chunk, code, word, n) for each distinct string of each chunk."""
    zipped = counted.filter("size(words) > 0").select("chunk", F.posexplode(F.arrays_zip("words", "totals")).alias("code", "s"))
    return zipped.select("chunk", "code", F.col("s.words").alias("word"), F.col("s.totals").alias("n"))


def _dictionary(counted: DataFrame, buckets: int) -> DataFrame:
    """(word, n, bucket): all distinct strings, how often each occurs, and its hash."""
    return _strings(counted).groupBy("word").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(buckets)))


def _weighed(counted: DataFrame, gains: DataFrame) -> DataFrame:
    """(part, id, n_words, n_features, gain): the sum of gains over the features of each text or part."""

    def add(docs: pa.Table, gains: pa.Table) -> pa.Table:
        gain = np.zeros(gains.num_rows, np.int64)
        gain[gains.column("code").to_numpy()] = gains.column("gain").to_numpy()
        sums = []
        for codes, counts in zip(docs.column("codes"), docs.column("counts"), strict=True):
            sums.append(int((gain[np.frombuffer(codes.as_py(), "<i4")] * np.frombuffer(counts.as_py(), "<i4")).sum()))
        return docs.select(["part", "id", "n_words", "n_features"]).append_column("gain", pa.array(sums, pa.int64()))

    docs = counted.select("chunk", "part", "id", "n_words", "n_features", "codes", "counts")
    kind = counted.schema["id"].dataType.simpleString()
    return docs.groupBy("chunk").cogroup(gains.groupBy("of")).applyInArrow(add, f"part long, id {kind}, n_words long, n_features long, gain long")


def importance_resampling(docs: DataFrame, target: DataFrame, options: Resampling = Resampling(), id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): how much likelier each document's features are in the target than in the documents, the same with random noise by its id, and its rank among the documents drawn (null if not drawn).

    Null and empty texts, and texts without words, have no features and weight 0; bytes that are no UTF-8 count as U+FFFD; null ids draw noise as the empty text and come first among equal scores; repeated rows rank one after the other; an empty target gives every feature a count of 0; other columns are not read. Long texts are counted in parts.
    """
    o = options
    configure(docs.sparkSession, ARROW_BYTES)
    counted = _counted(docs.select(F.col(id_column).alias("id"), valid(text_column).cast("binary").alias("text")), o.longest)
    aim = _counted(target.select(F.lit(0).alias("id"), valid(target_column).cast("binary").alias("text")), o.longest)
    strings = stored(_dictionary(counted, o.buckets), "dictionary")
    sums = lambda of, name: of.groupBy("bucket").agg(F.sum("n").cast("double").alias(name))
    total = lambda of: float(of.agg(F.sum("n_features")).first()[0] or 0)
    s, t = sums(strings, "s"), sums(_dictionary(aim, o.buckets), "t")
    ratio = ((F.coalesce("t", F.lit(0.0)) + 1) * F.lit(total(counted) + o.buckets)) / ((F.col("s") + 1) * F.lit(total(aim) + o.buckets))
    gains = s.join(F.broadcast(t), "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    of_strings = _strings(counted).join(strings.join(F.broadcast(gains), "bucket").select("word", "gain"), "word").select(F.col("chunk").alias("of"), "code", "gain")
    weighed, long_ = _weighed(counted.filter("part IS NULL"), of_strings), counted.filter("part IS NOT NULL")
    if not long_.isEmpty():
        weighed = weighed.unionByName(_weighed(long_, of_strings).groupBy("part", "id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain"))))
    # // rounds to zero, floors go down
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) DIV n_features")).otherwise(F.lit(0))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{o.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weighed.select("id", "n_words", "n_features", weight.cast("long").alias("weight"), F.monotonically_increasing_id().alias("row")).withColumn("score", F.col("weight") + noise), "scores")
    discard(counted, aim, strings)
    return ranked(scored, o).select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, o: Resampling) -> DataFrame:
    """Stored scores with the rank of the rows drawn: the best by score, then smaller id. Only what reaches the last score drawn is sorted, in ranges that may cut through equal scores.

    Scores are whole numbers within some 100,000 (a gain is 1000 logarithms of counts), so what the driver sees is bounded.
    """
    able = scored.filter(F.col("n_words") >= o.least)
    by_score = sorted(map(tuple, able.groupBy("score").count().collect()), reverse=True)
    wanted = o.share * sum(n for _, n in by_score) // 100
    least, have = None, 0
    for score, n in by_score:
        if have < wanted:
            least, have = score, have + n
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reach = (F.col("n_words") >= o.least) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    best = stored(scored.filter(reach).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "best-scores")
    sizes, before = sorted(map(tuple, best.groupBy("range").count().collect())), []
    for k, _ in sizes:
        before.append((k, sum(n for j, n in sizes if j < k)))
    offsets = F.broadcast(scored.sparkSession.createDataFrame(before, "range int, before long"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = best.join(offsets, "range").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.drop("range", "before").unionByName(scored.filter(~reach).withColumn("rank", F.lit(None).cast("long")))
