"""Findings of texts of any length: long texts are cut into pieces that any task can analyze.

Cuts lie where no match can reach across (see safe_cut), so a piece's matches
from its cut on are those of the whole text. Before its cut a piece also has
enough of the text for context words and labels; spans that begin there belong
to the piece before it. Spans that overlap lie in one piece, so duplicates
fall there, too. Texts of a recognizer for which no safe cut is known stay
whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import let
from maskwright.functions.patterns import safe_cut
from maskwright.functions.regex import NEW_WORD, REACH
from maskwright.operators.analyze import Context, Options, analyze, findings, rows_of, scans_of
from maskwright.operators.catalog import Recognizer

#: Bytes of a piece, about; what of the text before a piece comes with it if that holds enough words, else the next, else all.
PIECE, LEADS = 1 << 18, (1 << 10, 1 << 16)


def cuts_of(options: Options) -> str | None:
    """Where texts may be cut for these options (see safe_cut); None if nowhere."""
    chosen = [r for r in options.recognizers if r.supports(options.entities)]
    if not all(isinstance(r, Recognizer) and r.accepts is None and not any(python for _, _, python in scans_of(r)) for r in chosen):
        return None
    # what stands before a group like this is one character that no word goes on from
    plain = lambda p: re.sub(r"^\(\?:\^\|\\W\)", "", p)
    return safe_cut([plain(rx) for r in chosen for _, rx, _ in r.patterns])


def _latin(raw: Column, start: Column, size) -> Column:
    """Bytes as characters, so that places in the string are places of bytes; an ASCII character is never part of another in UTF-8."""
    return F.decode(F.substring(raw, start + 1, F.lit(size) if isinstance(size, int) else size), "ISO-8859-1")


def places(raw: Column, n: Column, cut: str, size: int) -> Column:
    """array<int>: the first cut in each stretch of `size` bytes but the first, 0 before and n after them."""

    def first(k: Column) -> Column:
        return let(F.regexp_instr(_latin(raw, k * size, size + 1), F.lit(cut)), lambda at: F.when((at > 0) & (at <= size), k * size + at - 1))

    stretches = F.when(n > size, F.sequence(F.lit(1), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), F.filter(F.transform(stretches, first), lambda x: x.isNotNull()), F.array(n))


def _lead(raw: Column, start: Column) -> Column:
    """How many bytes before start hold the words that spans after it can need, from a whole character on."""

    def of(size: int) -> Column:
        begin = F.greatest(start - size, F.lit(0))
        skip = F.greatest(F.regexp_instr(_latin(raw, begin, 4), F.lit(r"[^\x80-\xBF]")) - 1, F.lit(0))
        return F.greatest(start - begin - skip, F.lit(0))

    enough = lambda size: F.regexp_count(F.substring(raw, start - size + 1, size).cast("string"), F.lit(NEW_WORD)) > REACH
    out = start
    for size in reversed(LEADS):
        out = let(of(size), lambda s, rest=out: F.when(enough(s), s).otherwise(rest))
    return out


def _tail(raw: Column, end: Column, n: Column, size: int) -> Column:
    """How many bytes after end come with a piece, whole characters."""
    if not size:
        return F.lit(0)
    return F.when(end + size >= n, n - end).otherwise(F.length(F.regexp_replace(_latin(raw, end, size), r"[\xC0-\xFF][\x80-\xBF]*\z", "")))


def pieces(df: DataFrame, id_column: str, text_column: str, cut: str, size: int = PIECE, after: int = 0) -> DataFrame:
    """(id, piece): the pieces of each text, as structs of text, offset (bytes of the whole before it), lead and own: bytes of the piece before its own part, and of this. after: bytes that follow its own part. Null texts have none. Time and memory follow the text's size."""

    def one(raw: Column, bounds: Column, n: Column, k: Column) -> Column:
        a, b = F.get(bounds, k), F.get(bounds, k + 1)
        sized = F.struct(a.alias("a"), b.alias("b"), _lead(raw, a).alias("lead"), _tail(raw, b, n, after).alias("tail"))
        return let(sized, lambda p: F.struct(F.substring(raw, p["a"] - p["lead"] + 1, p["lead"] + p["b"] - p["a"] + p["tail"]).cast("string").alias("text"), (p["a"] - p["lead"]).alias("offset"), p["lead"].alias("lead"), (p["b"] - p["a"]).alias("own")))

    n = F.octet_length(text_column)
    parts = let(F.col(text_column).cast("binary"), lambda raw: let(places(raw, n, cut, size), lambda bounds: F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: one(raw, bounds, n, k))))
    return df.filter(F.col(text_column).isNotNull()).select(id_column, F.explode(parts).alias("piece"))


def findings_in_pieces(df: DataFrame, id_column: str, text_column: str = "text", options: Options | None = None, allowed: DataFrame | None = None, size: int = PIECE) -> DataFrame:
    """What findings returns, with texts of more than `size` bytes analyzed in pieces, which are dealt to all tasks; shorter ones aren't moved.

    Ids may be null or repeat; null texts have no findings. Where recognizers leave no safe cut (look-around, conditions of one's own, matches across lines and words, models), texts stay whole.
    """
    o = options or Options()
    cut = cuts_of(o)
    if cut is None:
        return findings(df, id_column, text_column, o, allowed)
    context = Context() if o.context is True else o.context
    after = 120 * (context.after + 1) + 8 if context and context.after > 0 else 0
    long_ = pieces(df.filter(F.octet_length(text_column) > size), id_column, text_column, cut, size, after)
    dealt = long_.repartition(F.xxhash64(id_column), F.col("piece.offset")).select(id_column, "piece.*")
    own = rows_of(analyze(dealt, "text", o), id_column, "offset", "lead", "own").filter("s.start >= lead AND s.start < lead + own")
    moved = own.select(id_column, "s.entity_type", *((F.col(f"s.{c}") + F.col("offset")).alias(c) for c in ("start", "end")), "s.score", "s.text", "s.recognizer")
    if allowed is not None:
        moved = moved.join(allowed.select(F.col(allowed.columns[0]).alias("text")).filter("text is not null").distinct(), "text", "left_anti").select(moved.columns)
    return findings(df.filter(F.octet_length(text_column) <= size), id_column, text_column, o, allowed).unionByName(moved)
