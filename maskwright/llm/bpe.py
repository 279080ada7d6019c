"""Byte-pair encoding by batched numpy merge rounds, and decoding.

The words of many texts are cut into symbols that lie in one flat array. Each
round looks up all neighbouring symbol pairs by binary search among the sorted
pair keys of the merge list, takes in every word its pair of lowest rank, and
merges it everywhere in that word. Words are encoded once and kept in a cache
bounded in bytes, so texts handled together cost one lookup for each word that
differs; where the cache is full, the words met most often stay.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm.common import configure, per_worker, trim, utf8
from maskwright.llm.shingles import in_chunks

#: The patterns by which the two public vocabularies cut texts into words.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Bytes that a worker's table of encoded words may take, what an entry takes besides its key, and bytes of text that are handled at a time.
CACHE_BYTES, ENTRY_BYTES, CHUNK_BYTES = 128 << 20, 230, 1 << 21

#: What a byte of UTF-8 is: 1 an ASCII letter; 2 the first of a letter's two bytes, unless the second is 0x97 or 0xB7, as in × and ÷; 3 other ASCII; 4 ASCII white space; 0 none of these.
KIND = np.zeros(256, np.uint8)
KIND[:128] = 3
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = 2
KIND[[9, 10, 11, 12, 13, 32]] = 4
#: The rank of symbols that don't merge.
FAR = np.int32(1 << 30)


def _naming(pattern: str, unlike: Newer) -> str:
    """A word pattern whose classes know the newer characters."""
    every = ranges("".join(sorted(unlike.letters + unlike.numbers + unlike.others)))
    kind = lambda own, rest: f"(?:[{own}]|(?![{every}]){rest})" if own else f"(?:(?![{every}]){rest})"
    letter, number = kind(ranges(unlike.letters), r"\p{L}"), kind(ranges(unlike.numbers), r"\p{N}")
    other = kind(ranges(unlike.others), r"[^\p{White_Space}\p{L}\p{N}]")
    for before, after in ((r"[^\s\p{L}\p{N}]", other), (r"[\p{L}]", letter), (r"[\p{N}]", number)):
        pattern = pattern.replace(before, after)
    pattern = re.sub(r"(?<= \?)\\p\{L\}", lambda _: letter, pattern)
    pattern = re.sub(r"(?<= \?)\\p\{N\}", lambda _: number, pattern)
    return re.sub(r"(?<=\|)\\s|(?<=\?!)\\S", lambda m: r"\p{White_Space}" if m[0] == r"\s" else r"\P{White_Space}", pattern)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start:start + length], one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(total)
    return values[at]


@dataclass(frozen=True)
class Newer:
    """What the tokenizers library says of characters that Python's tables and the `regex` module's may know differently, as they are of other versions of Unicode: letters, numbers and others among them, and what they become when folded (where Python has something else)."""

    letters: str = ""
    numbers: str = ""
    others: str = ""
    folded: tuple[tuple[str, str], ...] = ()


@cache
def newer(path: str) -> Newer:
    """Asked of the library itself, of all characters that Unicode has assigned since Python's tables: some ten thousand, in a few calls."""
    known = regex.compile(r"\P{Cn}")
    chars = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
    t = Tokenizer.from_file(path)

    def one_word(before: str) -> np.ndarray:
        """Whether each character makes one word with the one before it."""
        begins = {a for _, (a, _) in t.pre_tokenizer.pre_tokenize_str("".join(f"{before}{c}\n" for c in chars))}
        return np.array([3 * k + 1 not in begins for k in range(len(chars))])

    letter, other = one_word("a"), one_word("!")
    pick = lambda which: "".join(c for c, w in zip(chars, which.tolist(), strict=True) if w)
    folded = []
    if t.normalizer is not None:
        made = t.normalizer.normalize_str("|".join(chars)).split("|")
        folded = [(c, f) for c, f in zip(chars, made, strict=True) if f != unicodedata.normalize("NFC", c).lower()]
    return Newer(pick(letter), pick(~letter & ~other), pick(other), tuple(folded))


def ranges(chars: str) -> str:
    """A class of the sorted characters, without brackets."""
    codes = np.array([ord(c) for c in chars], np.int64)
    first = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    last = np.append(first[1:], len(codes)) - 1
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip(first, last, strict=True))


class Table(dict):
    """Numbers keys in the order in which they are first looked up, and keeps ids for each."""

    def __init__(self):
        self.new: list[str] = []
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)  # texts with such a stretch must be cut as a whole
        self.weight = 0

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of keys that all differ."""
        found = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(found < 0)
        found[fresh] = np.arange(len(self), len(self) + len(fresh))
        new = list(map(keys.__getitem__, fresh.tolist()))
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.new += new
        return found

    def take(self) -> list[str]:
        """The keys numbered since the last call; room for what is kept of them is made."""
        new, self.new = self.new, []
        self.weight += sum(map(sys.getsizeof, new)) + ENTRY_BYTES * len(new)
        more = np.zeros(len(new), np.int64)
        self.start, self.length, self.used = (np.concatenate([x, more]) for x in (self.start, self.length, self.used))
        self.odd = np.concatenate([self.odd, more > 0])
        return new

    def put(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the keys of these numbers, one after the other."""
        self.start[numbers] = len(self.flat) + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys of these numbers, one after the other, and how many each has."""
        size = self.length[numbers]
        return ragged(self.flat, self.start[numbers], size), size

    def shrink(self, limit: int) -> None:
        """Keeps the keys used most often, up to half of `limit` bytes, and gives the memory back."""
        keys = list(self)
        size = np.fromiter(map(sys.getsizeof, keys), np.int64, len(keys)) + ENTRY_BYTES
        order = np.argsort(-self.used, kind="stable")
        kept = np.sort(order[np.cumsum(size[order]) <= limit // 2])
        self.clear()
        self.update(zip(map(keys.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.flat, self.length = self.ids(kept)
        self.used, self.odd = self.used[kept] // 2, self.odd[kept]
        self.start = np.cumsum(self.length) - self.length
        self.weight = int(size[kept].sum())
        del keys, size, order
        trim()


class Bpe:
    """Encodes and decodes as the tokenizers library does with the vocabulary file at path, without added special tokens."""

    def __init__(self, path: str, unlike: Newer | None = None):
        """unlike: newer(path), which one process can find for others."""
        unlike = newer(path) if unlike is None else unlike
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.folds = bool(spec.get("normalizer"))
        self.find = regex.compile((WORD_PATTERN if self.suffix else BYTE_PATTERN).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # texts with newer characters, or any beyond 16 bits, are cut by a pattern that names them; `re` looks up a class of 16 bits in a table
        self.newer = re.compile(f"[{ranges(''.join(c for c in sorted(unlike.letters + unlike.numbers + unlike.others) if ord(c) < 1 << 16))}\\U00010000-\\U0010ffff]").search
        self.to_fold = re.compile(f"[{ranges(''.join(sorted(dict(unlike.folded))))}]").search if unlike.folded else None
        self.odd_find = regex.compile(_naming(WORD_PATTERN if self.suffix else BYTE_PATTERN, unlike)).findall
        self.newer_folds = str.maketrans(dict(unlike.folded))
        self.ascii = re.compile((WORD_PATTERN if self.suffix else BYTE_PATTERN).replace(r"[\p{L}]", "[a-zA-Z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+").replace(r"[^\s", r"[^\t-\r ").replace(r"(?!\S)", r"(?![^\t-\r ])").replace(r"\s+", r"[\t-\r ]+"), re.ASCII).findall
        self.single = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order].astype(np.int32)
        # ranks and results of all pairs of a letter and one after it, as the latter's number or 256 more at a word's end
        self.first_rank, self.first_made = self._look_up((self.single[:, None] * self.size + np.concatenate([self.single, self.last])).ravel())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in enumerate(letters)}
        stands: list[bytes] = [b""] * (max([self.size - 1, *self.special.values()]) + 1)
        for token, i in vocab.items():
            stands[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            stands[i] = token.encode()
        self.bytes = pa.array(stands, pa.large_binary())
        self.table = Table()

    def _look_up(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols (FAR if it doesn't merge) and what it becomes."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], FAR), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one flat array, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
        letters = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.single[letters].astype(np.int32)
        ends = np.cumsum(size)[size > 0] - 1
        symbols[ends] = self.last[letters[ends]]
        done_at, done = [], []
        after = np.append(letters[1:], 0).astype(np.int32)
        after[ends - 1] += 256
        code = letters.astype(np.int32) * 512 + after
        rank, made = self.first_rank[code], self.first_made[code]  # of the pair that begins here, and what it becomes
        rank[ends], fresh = FAR, np.zeros(0, np.int64)
        while len(symbols):
            fresh = fresh[fresh < len(symbols) - 1]
            rank[fresh], made[fresh] = self._look_up(symbols[fresh].astype(np.int64) * self.size + symbols[fresh + 1])
            rank[fresh[owner[fresh] != owner[fresh + 1]]] = FAR
            rank[-1] = FAR
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(owner))))
            open_ = best < FAR
            done_at.append(owner[~open_])
            done.append(symbols[~open_])
            hit = open_ & (rank == best)
            # of overlapping hits (a a a) every other one counts, from the left
            run = hit & np.append(False, hit[:-1])
            if run.any():
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~run, place, -1))
                hit &= (place - begin) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = made[where]
            keep = open_
            keep[where + 1] = False
            symbols, owner, rank, made, hit = symbols[keep], owner[keep], rank[keep], made[keep], hit[keep]
            new = np.flatnonzero(hit)
            fresh = np.concatenate([new, new[new > 0] - 1])
        who, ids = np.concatenate([*done_at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*done, np.zeros(0, np.int64)])
        order = np.argsort(who, kind="stable")
        return ids[order], np.bincount(who, minlength=len(words))

    def fold(self, text: str) -> str:
        if self.folds and text.isascii():
            return text.lower()
        if self.folds and self.to_fold and self.to_fold(text):
            text = text.translate(self.newer_folds)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if self.folds else text

    def words(self, text: str) -> list[str]:
        """The words of a folded text without special tokens, as the vocabulary's pattern cuts it."""
        return (self.ascii if text.isascii() else self.odd_find if self.newer(text) else self.find)(text)

    def _stretches(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The stretches between single spaces of all texts, as keys of the table, so that the pattern runs over new ones alone, and where each text's begin. No text holds NUL or a special token.

        NUL and F marks a text's first stretch, which has no space before it. Where spaces are no part of words, stretches end at any ASCII white space, and other ASCII after a letter begins one, too, as no word holds both in this order: "word,\\n" needs no key besides those of "word" and ",". A text's last character stays with what is before it.
        """
        head, blank = (b"", b"\t\n\v\f\r ") if self.suffix else (b"\0F", b" ")
        folded = [head + self.fold(t).encode() + b" " for t in texts]
        joined = b"".join(folded)
        raw = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded)))
        if self.suffix:
            kind = KIND[raw]
            gap, cut = kind == 4, kind >= 3
            other = np.flatnonzero(kind == 3)
            letter = (kind[other - 1] == 1) | (kind[other - 2] == 2) & (raw[other - 1] != 0x97) & (raw[other - 1] != 0xB7)
            cut[other[~letter]] = False
            cut[ends - 2] = gap[ends - 2]
        else:
            gap = cut = raw == 32
        at = np.flatnonzero(cut)
        gone = gap[at]
        # white space is left out of the keys
        offsets = np.append(0, at - np.cumsum(gone) + gone)
        keys = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, blank))])
        return keys.dictionary_encode(), np.append(0, np.searchsorted(at, ends[:-1]))

    def _keys(self, words: list[str]) -> list[str]:
        """The keys under which single words lie: their stretch's where a word makes one up, else NUL and P before the word."""
        if self.suffix:
            return words
        return [w[1:] if w[0] == " " and len(w) > 1 and not w[1].isspace() else "\0P" + w for w in words]

    def _cut(self, key: str) -> list[str] | None:
        """The words of a key; None if white space at a stretch's edge means that its text must be cut as a whole."""
        if key[:2] == "\0P":
            return [key[2:]]
        first = key[:2] == "\0F"
        text = key[2:] if first else key
        space = "" if first or self.suffix else " "
        if text.isalpha():
            return [space + text]
        if text[:-1].isalpha() and text[-1] in ",.":
            return [space + text[:-1], text[-1]]
        if not self.suffix and (not text or text[0].isspace() or text[-1].isspace()):
            return [] if key == "\0F" else None
        return self.words(space + text)

    def _learn(self) -> None:
        """Finds the ids of the keys met for the first time: single words by merge rounds, others from those of their words."""
        table = self.table
        new = table.take()
        if not new:
            return
        base = len(table) - len(new)
        # most are words of letters, which need no cutting
        rest = [k for k, plain in enumerate(map(str.isalpha, new)) if not plain]
        cut = [self._cut(new[k]) for k in rest]
        long = [j for j, c in enumerate(cut) if c and len(c) > 1]
        parts = list(map(table.__getitem__, chain.from_iterable(self._keys(cut[j]) for j in long)))
        more = len(new)
        new += table.take()
        rest += [k for k in range(more, len(new)) if not new[k].isalpha()]
        cut += [self._cut(new[k]) for k in rest[len(cut) :]]
        at = base + np.array(rest, np.int64)
        table.odd[at] = [c is None for c in cut]
        single = [j for j, c in enumerate(cut) if c and len(c) == 1]
        words = list(filter(str.isalpha, new))
        if not self.suffix:
            words = [" " + w for w in words]
        plain = np.ones(len(new), bool)
        plain[at - base] = False
        table.put(np.concatenate([base + np.flatnonzero(plain), at[np.array(single, np.int64)]]), *self.merge(words + [cut[j][0] for j in single]))
        if long:
            ids, size = table.ids(np.array(parts, np.int64))
            per = np.cumsum([0] + [len(cut[j]) for j in long])
            table.put(at[long], ids, np.add.reduceat(size, per[:-1]))

    def _whole(self, text: str) -> np.ndarray:
        """The ids of a text cut as a whole."""
        out = []
        for x in self.cut.split(text) if self.cut else [text]:
            if x in self.special:
                out.append(np.array([self.special[x]], np.uint32))
            elif x:
                at = np.array(list(map(self.table.__getitem__, self._keys(self.words(self.fold(x))))), np.int64)
                self._learn()
                out.append(self.table.ids(at)[0])
        return np.concatenate([np.zeros(0, np.uint32), *out])

    def rest(self) -> None:
        """Shrinks the table to a quarter, as other workers hold one, too."""
        if self.table.weight > CACHE_BYTES // 4:
            self.table.shrink(CACHE_BYTES // 2)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (unsigned 32-bit)."""
        table = self.table
        if table.weight > CACHE_BYTES:
            table.shrink(CACHE_BYTES)
        whole = ["\0" in t or any(s in t for s in self.special) for t in texts]
        plain = [t for t, w in zip(texts, whole, strict=True) if not w]
        found = iter(self._plain(plain) if plain else [])
        return [self._whole(t) if w or (ids := next(found)) is None else ids for t, w in zip(texts, whole, strict=True)]

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text without NUL or special tokens; None if it must be cut as a whole."""
        table = self.table
        keys, first = self._stretches(texts)
        known = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = table.numbers(known)
        self._learn()
        index = keys.indices.to_numpy()
        table.used[numbers] += np.bincount(index, minlength=len(numbers))
        odd = table.odd[numbers]
        odd = np.logical_or.reduceat(odd[index], first) if odd.any() else np.zeros(len(texts), bool)
        ids, size = table.ids(numbers[index])
        ends = np.cumsum(np.add.reduceat(size, first)).tolist()
        return [None if o else ids[a:b] for o, a, b in zip(odd.tolist(), [0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included (byte-level vocabularies)."""
        return self.bytes.take(pa.array(ids)).buffers()[2].to_pybytes().decode("utf-8", "replace") if len(ids) else ""


def shared_bpe(vocabulary: str, unlike: Newer) -> Bpe:
    """The encoder of this Python worker. unlike: newer(vocabulary). Tasks go from one idle worker to another, so each lets its encoder rest when it ends."""
    return per_worker(("bpe", vocabulary), lambda: Bpe(vocabulary, unlike))


def encoded(bpe: Bpe, column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each UTF-8 text of a column, in order, a bounded number of bytes at a time (a longer text goes alone)."""
    for part in in_chunks([x.as_py() or b"" for x in column], CHUNK_BYTES):
        yield from bpe.encode([t.decode("utf-8", "replace") for t in part])


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every whole text as little-endian unsigned 32-bit integers, and the decoded text in UTF-8.

    Null texts count as empty; null ids and repeated rows keep their own rows; other columns are not read.
    """
    return _mapped(docs, vocabulary, id_column, text_column, lambda ids, text: (ids.tobytes(), text), {"ids": pa.binary(), "decoded": pa.binary()})


def token_digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), from the same encoder and decoder without moving ids and texts. Odd rows count as in encode_documents."""
    return _mapped(docs, vocabulary, id_column, text_column, lambda ids, text: (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()), {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})


def _mapped(docs: DataFrame, vocabulary: str, id_column: str, text_column: str, each, kinds: dict[str, pa.DataType]) -> DataFrame:
    """Rows of each(ids, decoded text in UTF-8), with the ids as little-endian unsigned 32-bit integers."""
    configure(docs.sparkSession)
    kind, unlike = docs.schema[id_column].dataType.simpleString(), newer(vocabulary)

    def run(batches):
        bpe = shared_bpe(vocabulary, unlike)
        for b in batches:
            rows = [each(ids.astype("<u4"), bpe.decode(ids).encode()) for ids in encoded(bpe, b.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True))], names=[id_column, *kinds])
        bpe.rest()

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return docs.select(id_column, utf8(text_column).alias("text")).mapInArrow(run, ", ".join([f"`{id_column}` {kind}", *(f"{c} {names[t]}" for c, t in kinds.items())]))
