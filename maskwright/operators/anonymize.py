"""Anonymization of spans, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, running

Operator = Callable[[Column, Column], Column]


def mask(ch: str = "*") -> Operator:
    """One ch for each character."""
    return lambda entity, m: F.repeat(F.lit(ch), F.char_length(m))


def mask_keep_last(ch: str, k: int) -> Operator:
    """One ch for each character but the last k; values of up to k characters stay."""
    k = max(0, k)
    return lambda entity, m: F.when(F.char_length(m) <= k, m).otherwise(F.concat(F.repeat(F.lit(ch), F.char_length(m) - k), F.right(m, F.lit(k)) if k else F.lit("")))


def replace() -> Operator:
    """The type in angle brackets."""
    return lambda entity, m: F.concat(F.lit("<"), entity, F.lit(">"))


def replace_with(text: str) -> Operator:
    """A fixed text."""
    return lambda entity, m: F.lit(text)


def redact() -> Operator:
    """Nothing."""
    return replace_with("")


def token() -> Operator:
    """The type and the first eight digits of a SHA-256: equal values get equal tokens."""
    return lambda entity, m: F.concat(entity, F.lit("_"), F.substring(F.sha2(F.concat(entity, F.lit("|"), m), 256), 1, 8))


#: Overlapping spans that are compared one with another; more are swept.
FEW = 16
_PIECE = "struct<start:int,end:int,entity_type:string>"


def _greedy(spans: Column) -> Column:
    """Pieces of a few overlapping spans: by falling score and length, each keeps what those before it leave."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct((-x["score"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"))))
    piece = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), t.alias("entity_type"))

    def left(pieces, k):
        return F.filter(F.flatten(F.transform(pieces, lambda p: F.array(piece(p["start"], F.least(p["end"], k["start"]), p["entity_type"]), piece(F.greatest(p["start"], k["end"]), p["end"], p["entity_type"])))), lambda q: q["end"] > q["start"])

    return F.aggregate(keyed, F.array().cast(f"array<{_PIECE}>"), lambda kept, x: F.concat(kept, F.aggregate(kept, F.array(piece(x["start"], x["end"], x["entity_type"])), left)))


def _indexed(keyed: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(points, ranges): the sorted places where spans begin or end, and struct<i, j> for each span: it covers the stretches from point i up to point j."""
    events = F.array_sort(F.flatten(F.transform(keyed, lambda x, r: F.array(F.struct(x["start"].alias("at"), r.alias("r"), F.lit(0).alias("side")), F.struct(x["end"].alias("at"), r.alias("r"), F.lit(1).alias("side"))))))

    def numbered(es: Column) -> Column:
        count = running(es, F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("n")), "struct<at:int,n:int>", lambda acc, e: F.struct(e["at"].alias("at"), (acc["n"] + F.when(e["at"] == acc["at"], 0).otherwise(1)).alias("n")))
        sides = lambda cs: F.array_sort(F.transform(es, lambda e, k: F.struct(e["r"].alias("r"), e["side"].alias("side"), F.get(cs, k)["n"].alias("n"))))
        ranges = lambda ss: F.transform(F.sequence(F.lit(0), F.size(keyed) - 1), lambda r: F.struct(F.get(ss, 2 * r)["n"].alias("i"), F.get(ss, 2 * r + 1)["n"].alias("j")))
        points = F.transform(F.filter(es, lambda e, k: (k == 0) | (e["at"] != F.get(es, k - 1)["at"])), lambda e: e["at"])
        return let(points, lambda ps: let(let(let(count, sides), ranges), lambda rs: use(ps, rs)))

    return let(events, numbered)


def _swept(spans: Column) -> Column:
    """What _greedy gives, of very many overlapping spans, in time that follows n log(n) squared.

    A stretch between two places belongs to the first span, by falling score and length, of those that cover it. Each span is noted at two runs of 2^k stretches that together are its own; from the longest runs on, each hands the first span noted down to its halves.
    """
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct((-x["score"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"))))
    none = F.lit(2**31 - 1)
    power = lambda k: F.pow(F.lit(2), k).cast("int")

    def pieces(ks: Column, points: Column, ranges: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.size(points) - 2)
        log = lambda n: F.length(F.bin(n)).cast("int") - 1
        noted = F.flatten(F.transform(ranges, lambda x, r: let(log(x["j"] - x["i"]), lambda k: F.array(F.struct(k.alias("k"), x["i"].alias("p"), r.alias("r")), F.struct(k.alias("k"), (x["j"] - power(k)).alias("p"), r.alias("r"))))))

        def handed(above: Column, k: Column, notes: Column) -> Column:
            """The first span of each run of 2^k, from those of runs twice as long."""
            before = power(k)
            given = F.transform(stretches, lambda p: F.struct(p.alias("p"), F.least(F.get(above, p), F.when(p >= before, F.get(above, p - before)).otherwise(none)).alias("r")))
            own = F.transform(F.filter(notes, lambda x: x["k"] == k), lambda x: F.struct(x["p"].alias("p"), x["r"].alias("r")))
            return let(F.array_sort(F.concat(given, own)), lambda all_: F.transform(F.filter(all_, lambda x, i: (i == 0) | (x["p"] != F.get(all_, i - 1)["p"])), lambda x: x["r"]))

        def cut(owner: Column) -> Column:
            begins = F.filter(stretches, lambda p: (p == 0) | (F.get(owner, p) != F.get(owner, p - 1)))
            run = lambda b, p, n: F.struct(F.get(points, p).alias("start"), F.get(points, F.coalesce(F.get(b, n + 1), F.size(points) - 1)).alias("end"), F.get(ks, F.get(owner, p))["entity_type"].alias("entity_type"))
            return let(begins, lambda b: F.filter(F.transform(b, lambda p, n: run(b, p, n)), lambda x: x["entity_type"].isNotNull()))

        levels = F.sequence(log(F.size(points) - 1), F.lit(0), F.lit(-1))
        return let(noted, lambda ns: let(F.aggregate(levels, F.array_repeat(none, F.size(points) - 1), lambda above, k: handed(above, k, ns)), cut))

    return let(keyed, lambda ks: _indexed(ks, lambda points, ranges: pieces(ks, points, ranges)))


def resolve(text: Column, spans: Column) -> Column:
    """Disjoint pieces: spans are cut to the text, ordered by falling score and length, and each keeps what those before it leave.

    Spans are first grouped where they overlap, so that few are compared with each other.
    """

    def pieces(ks: Column) -> Column:
        def cut(ends: Column) -> Column:
            # a group begins where a span begins at or after the end of all before it
            begins = F.filter(F.sequence(F.lit(0), F.size(ks) - 1), lambda i: (i == 0) | (F.get(ks, i)["start"] >= F.get(ends, i - 1)))
            groups = let(begins, lambda b: F.transform(b, lambda i, k: F.slice(ks, i + 1, F.coalesce(F.get(b, k + 1), F.size(ks)) - i)))
            one = lambda g: F.array(F.struct(*(F.get(g, F.lit(0))[c].alias(c) for c in ("start", "end", "entity_type"))))
            return F.array_sort(F.flatten(F.transform(groups, lambda g: F.when(F.size(g) == 1, one(g)).when(F.size(g) <= FEW, _greedy(g)).otherwise(_swept(g)))))

        none = F.array().cast(f"array<{_PIECE}>")
        return F.when(F.size(ks) > 0, let(running(ks, F.lit(-1), "int", lambda far, k: F.greatest(far, k["end"])), cut)).otherwise(none)

    size = F.octet_length(text)
    cut = F.transform(spans, lambda x: F.struct(F.greatest(x["start"], F.lit(0)).alias("start"), F.least(x["end"], size).alias("end"), x["entity_type"].alias("entity_type"), x["score"].alias("score")))
    return let(F.array_sort(F.filter(cut, lambda x: x["end"] > x["start"])), pieces)


def spliced(raw: Column, pieces: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text of the bytes `raw` with put(piece, its text) in place of each of the disjoint, sorted pieces."""
    part = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")

    def join(ps: Column) -> Column:
        each = F.transform(ps, lambda p, i: F.concat(part(F.coalesce(F.get(ps, i - 1)["end"], F.lit(0)), p["start"]), put(p, part(p["start"], p["end"]))))
        rest = F.coalesce(F.get(ps, F.size(ps) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(each, ""), part(rest, F.octet_length(raw)))

    return let(pieces, join)


def anonymize(text: Column, spans: Column, default: Operator | None = None, by_entity: dict[str, Operator] | None = None) -> Column:
    """The text with each piece of a span replaced by its type's operator (default: the type in angle brackets). Null texts stay null."""
    default = default or replace()

    def put(piece: Column, m: Column) -> Column:
        out = default(piece["entity_type"], m)
        for name, op in (by_entity or {}).items():
            out = F.when(piece["entity_type"] == name, (op or default)(piece["entity_type"], m)).otherwise(out)
        return out

    done = let(text.cast("binary"), lambda raw: spliced(raw, resolve(text, spans), put))
    return F.when(text.isNotNull(), F.when(F.size(spans) > 0, done).otherwise(text))


def display(value: Column) -> Column:
    """A value for reports: up to four characters all stars, else two, up to twelve stars, and two."""
    n = F.char_length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.least(n - 4, F.lit(12))), F.right(value, F.lit(2))))
