"""A class-based bigram language model: P(w | v) = P(class of w | class of v) * P(w | class of w).

1. Exact counts of all words of the training texts.
2. All texts are written once as numbers of the KNOWN most frequent words, with
   the other, rare words beside them.
3. Exchange clustering: the CORE most frequent words move one at a time to the
   class that raises the likelihood of their bigrams most, until none moves (or
   SWEEPS have passed). All other known words, then all rare words of the
   training texts, move by the classes of the words around them; each word's
   move is found in a task, so the clustered vocabulary grows with the corpus.
4. Class transitions, smoothed towards the classes' own shares, and emissions
   score each text. Rare words have classes of their own, of which two next to
   each other see each other's rareness alone; they meet their classes and
   counts in a join, so no table of all words is ever held in memory.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, remainder, stored, utf8

#: Words with numbers of their own (bounds what is broadcast), and those whose exchange runs to its end.
KNOWN, CORE = 60_000, 2_048
#: Classes of known words, and as many of rare ones.
CLASSES, SWEEPS = 48, 100
#: Groups after the known words' classes: a text's end (which also precedes its first word), and words without number.
END, RARE, GROUPS = CLASSES, CLASSES + 1, CLASSES + 2
#: Weight of a class's own share in its transitions.
SMOOTH = 20.0
#: Word counts that a task holds before it passes them on.
HELD = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    return text.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over a column `text` of bytes."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                held.update(tokens(t.as_py()))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return mapped(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word from a square matrix of bigram counts, words by falling frequency."""
    n = len(counts)
    cls = np.arange(n) % classes
    one = np.eye(classes)[cls]
    right, left = counts @ one, counts.T @ one  # word x class: of the next word, of the one before
    table = one.T @ right
    term = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, r, lt, self_ = cls[w], right[w].copy(), left[w].copy(), counts[w, w]
            if not (r.any() or lt.any()):
                continue
            r[a] -= self_
            lt[a] -= self_
            table[a] -= r
            table[:, a] -= lt
            table[a, a] -= self_
            rows, cols = table.sum(1), table.sum(0)
            # what the likelihood has with w in class b, over what it has with w nowhere
            gain = (term(table + r[None, :]) - term(table)).sum(1) + (term(table + lt[:, None]) - term(table)).sum(0)
            d = np.diag(table)
            gain += term(d + r + lt + self_) - term(d + r) - term(d + lt) + term(d)
            gain -= term(rows + r.sum() + self_ + lt) - term(rows) + term(cols + lt.sum() + self_ + r) - term(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += lt
            table[b, b] += self_
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if not moved:
            break
    return cls


def associations(table: np.ndarray) -> np.ndarray:
    """Logarithms of how much more often each two groups follow each other than by chance."""
    t = table + 0.5
    return np.log(t * t.sum() / t.sum(1, keepdims=True) / t.sum(0, keepdims=True))


def best_class(right: np.ndarray, left: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class by which each word's neighbours (word x group counts) gain most, the groups' own table given."""
    gain = associations(table)
    return (right @ gain[:CLASSES].T + left @ gain[:, :CLASSES]).argmax(1)


def numbered(docs: DataFrame, words, id_column: str, text_column: str, held_out) -> DataFrame:
    """(row, id, held_out, n, ids, rare): each text's word numbers (KNOWN for a rare word, KNOWN + 1 for the end) as unsigned 16-bit integers, and its rare words in their order."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        number = {w: i for i, w in enumerate(words.value)}
        for b in batches:
            n, ids, rare = [], [], []
            for t in b.column(3):
                found = tokens(t.as_py())
                x = [number.get(w, KNOWN) for w in found]
                rare.append([w for w, i in zip(found, x, strict=True) if i == KNOWN])
                x.append(KNOWN + 1)
                n.append(len(x))
                ids.append(np.array(x, np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "id", "held_out", "n", "ids", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), held_out.alias("held_out"), utf8(text_column).alias("text"))
    return mapped(rows, run, f"row long, id {kind}, held_out boolean, n long, ids binary, rare array<binary>")


def _ids(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64)


def partial_sums(texts: DataFrame, keys_of, size: int) -> DataFrame:
    """(key, n) of the keys below size that keys_of finds in a batch's word numbers; each task adds them up in one array."""

    def run(batches):
        total, held, n = np.zeros(size, np.int64), [], 0
        for b in batches:
            x = _ids(b.column(0))
            if len(x):
                held.append(keys_of(np.append(KNOWN + 1, x)))
                n += len(held[-1])
            if n > 1 << 21:
                total += np.bincount(np.concatenate(held), minlength=size)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 500_000):
            part = some[at : at + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["key", "n"])

    return mapped(texts.select("ids"), run, "key long, n long")


def summed(texts: DataFrame, keys_of, size: int) -> DataFrame:
    """partial_sums of all tasks, added up."""
    return partial_sums(texts, keys_of, size).groupBy("key").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, shape: tuple) -> np.ndarray:
    """The counts as an array; its size bounds the rows that reach the driver."""
    t = counts.toArrow()
    out = np.zeros(int(np.prod(shape)), np.float32)
    out[t.column("key").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(shape)


def moved(neighbours: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, class, c, at, n): each word's best class by its neighbours, given as rows (word, at, n).

    at: the groups before and after the word, as before * GROUPS + after, n: how often; a group GROUPS stands for a side that a row doesn't tell. c: all n. A word has at most (GROUPS + 1) ** 2 different rows once they are added up; tasks are dealt whole words.
    """
    kind = neighbours.schema["word"].dataType.simpleString()
    rows = neighbours.repartition("word").groupBy("word", "at").agg(F.sum("n").alias("n"))
    words = rows.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def run(batches):
        for b in batches:
            sides = np.zeros((2, len(b), GROUPS + 1))
            word = np.repeat(np.arange(len(b)), b.column(2).value_lengths().to_numpy())
            at, n = (b.column(i).flatten().to_numpy() for i in (2, 3))
            np.add.at(sides[0], (word, at // (GROUPS + 1)), n)
            np.add.at(sides[1], (word, at % (GROUPS + 1)), n)
            found = best_class(sides[1][:, :GROUPS], sides[0][:, :GROUPS], table) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), *b.columns[1:]], names=["word", "class", "c", "at", "n"])

    return mapped(words, run, f"word {kind}, class long, c long, at array<long>, n array<long>")


def transitions(train: DataFrame, cls: np.ndarray) -> np.ndarray:
    """Counts of groups that follow each other."""
    return dense(summed(train, lambda x: cls[x[:-1]] * GROUPS + cls[x[1:]], GROUPS**2), (GROUPS, GROUPS)).astype(np.float64)


def cluster(train: DataFrame, known: int) -> np.ndarray:
    """The group of every word number (KNOWN + 2 of them)."""
    core = min(CORE, known)
    cls = np.full(KNOWN + 2, RARE, np.int64)
    cls[KNOWN + 1] = END
    if not core:
        return cls

    def pairs(x):
        a, b = x[:-1], x[1:]
        both = (a < core) & (b < core)
        return a[both] * core + b[both]

    cls[:core] = exchange(dense(summed(train, pairs, core * core), (core, core)))
    for _ in range(2 if known > core else 0):  # by the core's words around, then by all
        at = cls.copy()

        def around(x):
            a, b = x[:-1], x[1:]
            new, old = (a >= core) & (a < known), (b >= core) & (b < known)
            return np.concatenate([((a[new] - core) * 2) * GROUPS + at[b[new]], ((b[old] - core) * 2 + 1) * GROUPS + at[a[old]]])

        key, g = F.col("key"), F.col("key") % GROUPS
        before = F.floor(key / GROUPS) % 2 == 1
        seen = partial_sums(train, around, (known - core) * 2 * GROUPS).select(
            F.floor(key / (2 * GROUPS)).alias("word"), F.when(before, g * (GROUPS + 1) + GROUPS).otherwise(GROUPS * (GROUPS + 1) + g).alias("at"), "n"
        )
        t = moved(seen, transitions(train, at)).select("word", "class").toArrow()
        cls[core + t.column("word").to_numpy()] = t.column("class").to_numpy()
    return cls


def rare_spots(number: DataFrame, cls: np.ndarray) -> DataFrame:
    """(row, word, at): each rare word of the texts, with the groups before and after it (see `moved`)."""

    def run(batches):
        for b in batches:
            x, lists = _ids(b.column(1)), b.column(2)
            spot, group = np.flatnonzero(x == KNOWN), cls[x]
            at = group[spot - 1] * (GROUPS + 1) + group[spot + 1]  # texts end in END, which is also before the first
            ends = np.append(0, lists.value_lengths().to_numpy().cumsum())
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int64()))], names=["row", "word", "at"])

    some = mapped(number.filter(F.size("rare") > 0).select("row", "ids", "rare"), run, "row long, word array<binary>, at array<long>")
    return some.select("row", F.inline(F.arrays_zip("word", "at")))


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out, the others train. Null and empty texts are their end alone. Repeated rows are counted and scored as often as they occur. Nothing to train on leaves uniform scores over the one unseen word. Class probabilities sum to one over the training words and one unseen word.
    """
    spark = configure(docs.sparkSession)
    held_out = remainder(id_column, 7) == 2
    train_texts = docs.filter(~held_out).select(utf8(text_column).alias("text"))
    counts = stored(count_words(train_texts), "words")
    ends, (words_total, distinct) = train_texts.count(), counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = words_total + ends, distinct + (ends > 0)
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = len(top)
    number = stored(numbered(docs, spark.sparkContext.broadcast([bytes(r.word) for r in top]), id_column, text_column, held_out), "numbered")
    train = number.filter("not held_out")
    cls = cluster(train, known)
    moves = transitions(train, cls)

    # no rare word has more than 1 / KNOWN of the training tokens, so whole words can be dealt to tasks
    rare = stored(moved(rare_spots(train, cls).select("word", "at", F.lit(1).cast("long").alias("n")), moves), "rare-words")
    sides = rare.select("class", F.inline(F.arrays_zip("at", "n"))).groupBy("class", "at").agg(F.sum("n").alias("n")).toArrow()
    kind, at, often = (sides.column(x).to_numpy() for x in ("class", "at", "n"))
    into, after = np.zeros((GROUPS, CLASSES)), np.zeros((CLASSES + 1, GROUPS))  # groups to rare classes, rare classes (and the unseen word) to groups
    np.add.at(into, (at // (GROUPS + 1), kind), often)
    np.add.at(after, (kind, at % (GROUPS + 1)), often)
    sizes = rare.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("types")).toArrow()
    weight = np.zeros(CLASSES)  # rare words count once more than seen, as the unseen word counts once
    weight[sizes.column("class").to_numpy()] = sizes.column("c").to_numpy() + sizes.column("types").to_numpy()

    c = np.zeros(KNOWN + 2)
    c[:known] = [r.n for r in top]
    c[KNOWN + 1] = ends
    own = np.bincount(cls, c, GROUPS)
    own[RARE] = max(0, words_total - c[:known].sum())
    share = np.where((own > 0) | (np.arange(GROUPS) >= END), own + 1, 0)
    share /= share.sum()
    into[RARE] = 0
    kinds = (into + SMOOTH * weight / max(1, weight.sum())) / (into.sum(1, keepdims=True) + SMOOTH) * weight.sum() / (weight.sum() + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        step, after = (np.log10((m + SMOOTH * share) / (m.sum(1, keepdims=True) + SMOOTH)) for m in (moves, after))
        emit = np.log10(np.where(c > 0, c, 1) / np.maximum(own[cls], 1))
        inside = np.where(weight > 0, np.log10(kinds) - np.log10(weight), 0)
    inside = np.append(inside, np.full((GROUPS, 1), -np.log10(weight.sum() + 1)), axis=1)
    emit[KNOWN] = 0  # rare words' own probabilities, and what follows them, come from the join
    step[RARE] = 0
    base = np.log10((c + 1) / (n + v + 1))
    base[KNOWN] = 0
    tables = spark.sparkContext.broadcast((cls, step, emit, base))

    def run(batches):
        cls, step, emit, base = tables.value
        for b in batches:
            x, size = _ids(b.column(3)), b.column(2).to_numpy()
            at = np.cumsum(size) - size
            k = cls[x]
            last = np.append(END, k[:-1])
            last[at] = END
            known_ = np.add.reduceat((x != KNOWN) & (x <= KNOWN + 1) & ~((x == KNOWN + 1) & (ends == 0)), at) if len(x) else np.zeros(0)
            s = np.add.reduceat(step[last, k] + emit[x], at) if len(x) else np.zeros(0)
            u = np.add.reduceat(base[x], at) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(known_.astype(np.int64)), pa.array(u.astype(np.float64)), pa.array(s.astype(np.float64))], names=["row", "held_out", "n", "known", "base", "score"])

    common = mapped(number.select("row", "held_out", "n", "ids"), run, "row long, held_out boolean, n long, known long, base double, score double").select("row", "known", "base", "score")
    # (class, at): what a rare word adds but for its own count; a few thousand rows for each of the classes
    whole = inside.T[:, :, None] + after[:, None, :]
    code = np.arange(GROUPS)[:, None] * (GROUPS + 1) + np.arange(GROUPS)
    adds = spark.createDataFrame(pa.table({"class": np.repeat(np.arange(CLASSES + 1), GROUPS**2), "at": np.tile(code.ravel(), CLASSES + 1), "adds": whole.ravel()}))
    seen = rare_spots(number, cls).join(rare.select("word", "class", "c"), "word", "left").select("row", "at", F.coalesce("class", F.lit(CLASSES)).alias("class"), F.coalesce("c", F.lit(0)).alias("c"))
    more = F.col("adds") + F.when(F.col("c") > 0, F.log10(F.col("c") + 1)).otherwise(0)
    joined = seen.join(F.broadcast(adds), ["class", "at"]).groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("known"), F.sum(F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base"), F.sum(more).alias("score")
    )
    parts = common.unionByName(joined).groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return number.select("row", "id", "held_out", "n").join(parts, "row").select(
        F.col("id").alias(id_column), "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
