"""Model-backed entities: what a model finds in a text becomes a column of artifacts, and that becomes spans.

A backend gets lists of windows of ASCII text and returns (label, start, end,
score) for each. This module folds texts, cuts them, maps what comes back to
byte offsets of the original and cleans it; it brings no model.
"""

from __future__ import annotations

import logging
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Backend = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]
Span = tuple[str, int, int, float]
#: (start, end) of the tokens of a text, without special ones, and how many tokens it has with them.
Tokenizer = Callable[[str], tuple[list[tuple[int, int]], int]]
ARTIFACTS = "array<struct<entity_type:string,start:int,end:int,score:double>>"
#: Runes of a word at most, when a span grows to its edges; windows to a call of the model; tokens that neighbouring windows share.
WORD, BATCH, SHARED = 100, 32, 32


@dataclass(frozen=True)
class Settings:
    """cut: whole, lines or fields. window, overlap: bytes of a folded window and what neighbours share. tokenizer, budget: windows of at most so many tokens instead. low: types whose scores are multiplied by low_factor (0: not). buckets: lengths (characters, or tokens) that windows are rounded up to; those of a length go to the model together, whatever texts they are of."""

    mapping: dict[str, str] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    low: tuple[str, ...] = ()
    low_factor: float = 0.0
    cut: str = "whole"
    window: int = 248
    overlap: int = 96
    tokenizer: Tokenizer | None = None
    budget: int = 256
    buckets: tuple[int, ...] = ()

    def __post_init__(self):
        if self.cut not in ("whole", "lines", "fields"):
            raise ValueError(f"unknown cut {self.cut!r}")


@dataclass(frozen=True)
class ArtifactRecognizer:
    """Takes its spans from a model's artifacts. entities: the types it may give (None: any)."""

    entities: tuple[str, ...] | None = None
    name: str = "ArtifactRecognizer"
    language: str = "en"

    def supports(self, entities: list[str] | None) -> bool:
        return entities is None or (bool(entities) if self.entities is None else any(e in entities for e in self.entities))

    def wanted(self, entities: list[str] | None) -> list[str] | None:
        own = None if self.entities is None else list(self.entities)
        return own if entities is None else entities if own is None else [e for e in own if e in entities]


def is_word(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind == "Nd"


def fold(text: str) -> str:
    """One ASCII character for each character of the text: its base letter, or x where it has none."""
    if text.isascii():
        return text
    base = (unicodedata.normalize("NFD", c)[0] for c in text)
    return "".join(b if b.isascii() else "x" for b in base)


def segments(text: str, cut: str) -> list[tuple[int, int]]:
    """Parts that make up the text, each ending after a separator; those without a letter or digit are left out."""
    ends = [len(text)] if cut == "whole" else [i + 1 for i, c in enumerate(text) if c == "\n" or (c == "\t" and cut == "fields")]
    edges = sorted({0, *ends, len(text)})
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if any(unicodedata.category(c)[0] == "L" or c.isdecimal() for c in text[a:b])]


def windows(size: int, width: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of at most `width` over 0..size, each beginning `overlap` before the end of the last."""
    width = max(1, width)
    starts = range(0, max(1, size - width + max(1, width - overlap)), max(1, width - overlap))
    return [(s, min(s + width, size)) for s in starts]


def token_windows(text: str, tokenizer: Tokenizer, budget: int) -> list[tuple[int, int]]:
    """Windows that have at most `budget` tokens each, special ones included; each begins SHARED tokens before the last one's end. As a cut can make more tokens of a word, a window is counted anew and shortened until it fits."""
    spans, size = tokenizer(text)
    if size <= budget or not spans:
        return [(0, len(text))]
    own, out, first = max(1, budget - (size - len(spans))), [], 0
    while True:
        take = min(own, len(spans) - first)
        while take > 1 and (over := tokenizer(text[spans[first][0] : spans[first + take - 1][1]])[1] - budget) > 0:
            take = max(1, take - over)
        out.append((spans[first][0], spans[first + take - 1][1]))
        if first + take >= len(spans):
            return out
        first += max(1, take - SHARED)


def merged(spans: list[Span]) -> list[Span]:
    """By start; of equal spans of a type the best score, and none that lies in a wider one of its type."""
    out: list[Span] = []
    far: dict[str, int] = {}
    for s in sorted(spans, key=lambda s: (s[1], -s[2], s[0], -s[3])):
        if s[2] > far.get(s[0], -1):
            out.append(s)
            far[s[0]] = s[2]
    return out


def _grown(text: str, at: int, way: int) -> int:
    """The edge of the word around `at`, backwards or forwards; `at` itself if that word is too long."""
    a = b = at
    while a > 0 and b - a <= WORD and is_word(text[a - 1]):
        a -= 1
    while b < len(text) and b - a <= WORD and is_word(text[b]):
        b += 1
    return at if b - a > WORD else (a if way < 0 else b)


def snapped(text: str, spans: list[Span]) -> list[Span]:
    """Spans (in characters) grown to the edges of the words they begin and end in; those of a type that then touch become one, with the best score."""
    out: list[Span] = []
    last: dict[str, int] = {}
    wide = []
    for t, a, b, s in spans:
        if 0 <= a < b <= len(text):
            a, b = _grown(text, a, -1) if is_word(text[a]) else a, _grown(text, b, 1) if is_word(text[b - 1]) else b
        wide.append((t, a, b, s))
    for t, a, b, s in sorted(wide, key=lambda x: (x[1], -x[2])):
        k = last.get(t)
        if k is not None and a <= out[k][2]:
            out[k] = (t, out[k][1], max(b, out[k][2]), max(s, out[k][3]))
        else:
            last[t] = len(out)
            out.append((t, a, b, s))
    return out


def mapped(label: str, score: float, o: Settings) -> tuple[str, float] | None:
    """The type and score of a model's label; None if either is to be ignored or nothing is left of the score."""
    entity = o.mapping.get(label, label)
    score = min(1.0, score * (o.low_factor if o.low_factor > 0 and entity in o.low else 1.0))
    return None if label in o.ignore or entity in o.ignore or score <= 0 else (entity, score)


def _calls(jobs: list[tuple[int, int, int, str]], o: Settings) -> Iterator[tuple[list, list[str]]]:
    """The windows of one call of the model after the other, and the texts to call it with. With buckets, those of a call have one rounded length, filled up with blanks where characters count, and there are a power of two of them, so the model meets few shapes."""
    groups: dict[int, list] = {}
    for job in jobs:
        size = o.tokenizer(job[3])[1] if o.tokenizer and o.buckets else len(job[3])
        groups.setdefault(next((b for b in sorted(o.buckets) if b >= size), size) if o.buckets else 0, []).append(job)
    for width, group in sorted(groups.items()):
        for k in range(0, len(group), BATCH):
            part = group[k : k + BATCH]
            given = [w for *_, w in part]
            if o.buckets:
                blank = "" if o.tokenizer else " " * width
                given = [w if o.tokenizer else w.ljust(width) for w in given] + [blank] * ((1 << (len(part) - 1).bit_length()) - len(part))
            yield part, given


def found_in(texts: list[str], backend: Backend, o: Settings) -> list[list[Span]]:
    """The artifacts of each text, in byte offsets."""
    folded, raw = [fold(t) for t in texts], [[] for _ in texts]
    cut = lambda text: token_windows(text, o.tokenizer, o.budget) if o.tokenizer else windows(len(text), o.window, o.overlap)
    jobs = [(n, a + x, a + y) for n, t in enumerate(texts) for a, b in segments(t, o.cut) for x, y in cut(folded[n][a:b])]
    for part, given in _calls([(n, a, b, folded[n][a:b]) for n, a, b in jobs], o):
        for (n, a, b, _), answer in zip(part, backend(given)[: len(part)], strict=True):
            for label, x, y, score in answer:
                x, y = max(a, a + x), min(b, a + y)
                if x < y and (m := mapped(label, score, o)):
                    raw[n].append((m[0], x, y, m[1]))
    out = []
    for t, spans in zip(texts, raw, strict=True):
        spans = snapped(t, merged(spans))
        if not t.isascii() and spans:
            marks = sorted({p for _, a, b, _ in spans for p in (a, b)})
            sizes, at = [0], 0
            for m in marks:
                sizes.append(sizes[-1] + len(t[at:m].encode()))
                at = m
            byte = lambda p: sizes[bisect_right(marks, p)]  # noqa: B023, E731
            spans = [(e, byte(a), byte(b), s) for e, a, b, s in spans]
        out.append(spans)
    return out


def with_artifacts(df: DataFrame, backend: Callable[[], Backend], text_column: str = "text", settings: Settings | None = None, out: str = "artifacts") -> DataFrame:
    """Adds the artifacts of each text by one pass of the model, which backend() makes once for each task. Null texts have none.

    Where the model fails, its texts get none and the failure is logged, so patterns still apply.
    """
    o, at = settings or Settings(), df.columns.index(text_column)
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = backend()
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            try:
                spans = found_in(texts, model, o)
            except Exception:
                logging.getLogger(__name__).exception("the model failed on a batch")
                spans = [[] for _ in texts]
            rows = [[dict(zip(("entity_type", "start", "end", "score"), s, strict=True)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` {ARTIFACTS}")


def artifact_spans(text: Column, artifacts: Column, entities: list[str] | None = None, name: str = "ArtifactRecognizer") -> Column:
    """Spans as analyze gives them, of the artifacts of the wanted types."""
    chosen = F.coalesce(artifacts, F.array().cast(ARTIFACTS))
    if entities is not None:
        chosen = F.filter(chosen, lambda x: x["entity_type"].isin(*entities) if entities else F.lit(False))
    part = lambda x: F.substring(text.cast("binary"), x["start"] + 1, x["end"] - x["start"]).cast("string")
    return F.transform(chosen, lambda x: F.struct(x["entity_type"].alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), part(x).alias("text"), F.lit(name).alias("recognizer")))
