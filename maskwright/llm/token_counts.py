"""Token counts of whole texts, with huge ones encoded in overlapping pieces that are resynchronised.

A text longer than a piece is cut at fixed bytes, and each piece also holds
what follows its end for some way. Pieces are encoded with offsets, in any
task. Where two meet, both know the first stretch of the later one; at a place
there where both begin a word, the earlier piece's tokens end and the later
one's begin, and the counts are added up. Pieces that share no such place are
encoded again with wider overlaps, up to the whole text.

Why a shared place is stable: words are cut from left to right by a pattern
that looks at nothing before a word and, past its end, no further than the
white space that follows or a contraction of three characters, and special
strings hold no piece of themselves at their ends. So the words of a piece
that starts at a true border are those of the text, but for words that the
missing rest could change, which end within a margin of the piece's end; and a
piece that was cut anywhere agrees with the text from the first true border at
which it begins a word itself.

Short texts go whole. Their stretches between single spaces are numbered
first, as a word always ends before a space that stands alone between other
characters, and the library encodes each distinct stretch once.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm.common import ARROW_BYTES, configure, mapped, per_worker, slices, stored, valid

#: Bytes of a piece and of the first overlap, and how much wider the next one is.
PIECE, OVERLAP, WIDER = 1 << 15, 512, 8
#: Bytes of short texts that are handled together, and counts of stretches that a worker keeps.
BATCH_BYTES, KEPT = 1 << 20, 300_000
#: What a byte is: 1 ASCII but for white space and controls, 2 the first of a Latin letter's two bytes, 0 another.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F], KIND[0xC3:0xCB] = 1, 2


def check_vocabulary(path: str) -> int:
    """Characters at a piece's end that the missing rest can change. Raises ValueError for vocabularies whose borders this module hasn't proven: it knows byte-level ones with the usual pattern, without a normalizer, and with special strings that can't overlap."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, special = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec.get("added_tokens", [])]
    known = spec.get("normalizer") is None and spec.get("post_processor") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    plain = not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    apart = not any(a[k:] and b.startswith(a[k:]) for a in special for b in special for k in range(1, len(a))) and not any(a != b and a in b for a in special for b in special)
    if not (known and plain and apart):
        raise ValueError("word borders of this vocabulary are not known to be stable")
    # a special string that the end cuts off may begin here, and white space before it be cut otherwise; else a contraction
    return max([4, *(len(s) + 2 for s in special)])


def _tokenizer(path: str) -> Tokenizer:
    def load() -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return t

    return per_worker(("tokenizer", path), load)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): bytes of each whole text in UTF-8, its tokens as the tokenizers library counts them without added special tokens (special strings in a text are one token each), and whether these are more than `limit`.

    Null and empty texts have no bytes and no tokens; bytes that are no UTF-8 count as U+FFFD; null ids and repeated rows keep their own rows; other columns are not read. Texts of any length need memory for a piece at a time, unless they hold no word border for as long: these take as much as the wider overlap.
    """
    margin = check_vocabulary(vocabulary)
    configure(docs.sparkSession, ARROW_BYTES)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), valid(text_column).cast("binary").alias("text"))
    size = F.octet_length("text")
    counted = mapped(rows.filter(size <= piece), _count(vocabulary), f"id {kind}, n_bytes long, n_tokens long")
    long_ = stored(rows.filter(size > piece).select(F.monotonically_increasing_id().alias("key"), "id", size.cast("long").alias("n_bytes"), "text"), "long-texts")
    counted = counted.unionByName(_resynchronised(long_, vocabulary, margin, piece, overlap))
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def stretches(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The stretches of all texts, cut before spaces between two characters that surely are no white space, as numbered bytes, and the text that each lies in."""
    joined = b"".join(texts)
    raw, ends = np.frombuffer(joined, np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    space = np.flatnonzero(raw[2:-1] == 32) + 2
    other = (KIND[raw[space - 1]] == 1) | (raw[space - 1] & 0xC0 == 0x80) & (KIND[raw[space - 2]] == 2)
    begins = np.append(0, ends[:-1])
    at = np.union1d(begins[ends > begins], space[other & (KIND[raw[space + 1]] > 0)])
    offsets = np.append(at, len(raw)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return found.dictionary_encode(), np.searchsorted(ends, at, side="right")


def _count(vocabulary: str):
    def run(batches):
        t = _tokenizer(vocabulary)
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, BATCH_BYTES):
                texts = part.column(1).to_pylist()
                found, owner = stretches(texts)
                keys = found.dictionary.to_pylist()
                if new := [k for k in keys if k not in known]:
                    if len(known) > KEPT:
                        known, new = {}, keys
                    known.update(zip(new, map(len, t.encode_batch_fast([k.decode() for k in new], add_special_tokens=False)), strict=True))
                count = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
                n = np.bincount(owner, count[found.indices.to_numpy()], len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    return run


def _resynchronised(texts: DataFrame, vocabulary: str, margin: int, piece: int, overlap: int) -> DataFrame:
    """(id, n_bytes, n_tokens) of stored texts (key, id, n_bytes, text): rounds of pieces whose overlaps grow until every text's pieces meet."""
    done, open_ = None, texts
    while True:
        found = stored(_spliced(open_, vocabulary, margin, max(piece, 4 * overlap), overlap), "piece-counts")
        met = found.filter("n_tokens IS NOT NULL").drop("key")
        done = met if done is None else done.unionByName(met)
        apart = found.filter("n_tokens IS NULL").select("key")
        if apart.isEmpty():
            return done
        open_, overlap = texts.join(apart, "key", "left_semi"), overlap * WIDER


def _spliced(texts: DataFrame, vocabulary: str, margin: int, piece: int, overlap: int) -> DataFrame:
    """(key, id, n_bytes, n_tokens): the tokens of each text, from its pieces; null where two share no word border in their overlap.

    Overlaps are a quarter of a piece at most, so the borders of a text follow each other in the order of its pieces.
    """
    cuts = texts.select("key", "id", "n_bytes", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(piece).cast("long"))).alias("at"))
    # four bytes more for each character of the margin, and for a character that the end cuts through
    cut = F.substring("text", (F.col("at") + 1).cast("int"), F.lit(piece + overlap + 4 * margin + 4))
    pieces = mapped(cuts.select(cut.alias("text"), "key", "id", "n_bytes", "at"), _borders(vocabulary, margin, piece, overlap), f"key long, id {texts.schema['id'].dataType.simpleString()}, n_bytes long, at long, total long, head array<int>, head_tokens array<int>, tail array<int>, tail_tokens array<int>")
    order = Window.partitionBy("key").orderBy("at")
    before = pieces.withColumns({"before": F.lag("tail").over(order), "before_tokens": F.lag("tail_tokens").over(order)})
    meet = F.array_min(F.array_intersect("head", "before"))
    tokens = lambda count, place: F.element_at(count, F.array_position(place, F.col("meet")).cast("int"))
    first, last = F.col("at") == 0, F.col("at") + piece >= F.col("n_bytes")
    # where a piece begins, the tokens of the one before it up to there come in and its own up to there go
    joint = F.when(first, 0).when(F.col("meet").isNotNull(), tokens("before_tokens", F.col("before")) - tokens("head_tokens", F.col("head")))
    steps = before.withColumn("meet", meet).select("key", "id", "n_bytes", (joint + F.when(last, F.col("total")).otherwise(0)).alias("n"))
    return steps.groupBy("key", "id", "n_bytes").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def _borders(vocabulary: str, margin: int, piece: int, overlap: int):
    """Encodes pieces: their number of tokens, and where words begin in their first stretch (head) and in the overlap after their end (tail), as bytes from that stretch's beginning, with the tokens before each."""

    def borders(raw: bytes, at: int, n_bytes: int, t: Tokenizer) -> tuple:
        lead = next(k for k in range(4) if len(raw) == k or raw[k] & 0xC0 != 0x80)
        text = raw[lead:].decode("utf-8", "ignore")
        whole = at + len(raw) >= n_bytes
        e = t.encode(text, add_special_tokens=False)
        words = np.array(e.word_ids, np.int64)
        start = np.flatnonzero(words[1:] != words[:-1]) + 1
        place = np.array([a for a, _ in e.offsets], np.int64)[start]
        stable = np.ones(len(place), bool) if whole else place <= len(text) - margin
        size = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (size >= 0x80).astype(np.int64) + (size >= 0x800) + (size >= 0x10000)
        place = (np.cumsum(size) - size)[place] + lead
        head, tail = (place > lead) & (place <= overlap), (place > piece) & (place <= piece + overlap) & stable
        return len(words), place[head], start[head], place[tail] - piece, start[tail]

    def run(batches):
        t = _tokenizer(vocabulary)
        for b in batches:
            raw, at, n_bytes = (b.column(c) for c in ("text", "at", "n_bytes"))
            rows = [borders(raw[i].as_py(), at[i].as_py(), n_bytes[i].as_py(), t) for i in range(b.num_rows)]
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), n_bytes, at, pa.array([r[0] for r in rows], pa.int64()), *lists], names=["key", "id", "n_bytes", "at", "total", "head", "head_tokens", "tail", "tail_tokens"])

    return run
