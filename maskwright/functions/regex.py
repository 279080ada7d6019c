"""RE2 patterns as Java patterns, and all spans of a pattern as a Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, running
from maskwright.functions.chars import NO_WORD_EDGE, WORD_CHARS, WORD_EDGE, chars_of
from maskwright.functions.patterns import holds_a_digit, native
from maskwright.operators import catalog

#: Noncharacters that mark spans; in a text they are first turned into two others of the same length.
OPEN, CLOSE = "﷐", "﷑"
#: Characters before a span that are kept for its context if REACH words begin in them (else more are), and the cuts that these come from: each has a word at least.
BEFORE, REACH = 160, 6
NEW_WORD = r"[^\p{L}\p{Nd}\p{M}][\p{L}\p{Nd}\p{M}]"
#: Characters of a mailbox name but for letters, digits and the underscore.
_SIGN = r"!#$%&'*+\-/=?^`{|}~"


def edge_chars(pattern: str, last: bool = False) -> set[str] | None:
    """The ASCII characters that a match can begin (or end) with; None if it may be empty or is not told."""
    def walk(seq) -> tuple[set[str], bool]:
        """Characters, and whether the sequence can be empty."""
        found: set[str] = set()
        for op, arg in reversed(list(seq)) if last else list(seq):
            name = str(op)
            if name == "AT":
                continue
            if name == "LITERAL":
                return found | {chr(arg)}, False
            if name == "IN":
                return found | chars_of(arg), False
            if name == "SUBPATTERN":
                more, empty = walk(arg[-1])
            elif name == "BRANCH":
                ways = [walk(x) for x in arg[1]]
                more, empty = set().union(*(w for w, _ in ways)), any(e for _, e in ways)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                more, empty = walk(arg[2])
                empty = empty or arg[0] == 0
            else:
                return found | set(map(chr, range(128))), True
            found |= more
            if not empty:
                return found, False
        return found, True

    try:
        found, empty = walk(_parser.parse(pattern.replace(r"\p{Zs}", " "), re.ASCII))
    except re.error:  # syntax of RE2 alone
        return None
    return None if empty else found




def to_java(pattern: str) -> str:
    """The same matches in Java: ASCII word boundaries, RE2's white space, Unicode case folding, no capturing groups."""
    lead, body = lead_and_body(pattern)
    return lead + body


def _java_class(chars: set[str]) -> str:
    """A class of the characters, runs as ranges."""
    out, codes = "", sorted(map(ord, chars))
    while codes:
        n = next((k for k in range(1, len(codes)) if codes[k] != codes[0] + k), len(codes))
        a, b = (re.escape(chr(codes[k])) for k in (0, n - 1))
        out += a if n == 1 else f"{a}-{b}"
        codes = codes[n:]
    return f"[{out}]"


def lead_and_body(pattern: str) -> tuple[str, str]:
    """A pattern in Java as a condition where a match begins, and the match.

    An edge where only a word character can stand inside asks for none outside, and the character itself is looked at first: most places of a text fail at once.
    """
    lead = ""
    if "(?i)" in pattern:
        pattern = pattern.replace("(?i)", "")
        lead = "(?iu)" + ("(?=[a-z])" if pattern.startswith(r"\b[a-z]") else "")
    else:
        inner = re.sub(r"^\\[bB]", "", pattern)
        first = edge_chars(inner) if inner != pattern else None
        if first and (first <= WORD_CHARS if pattern[1] == "b" else not first & WORD_CHARS):
            lead, pattern = f"(?={_java_class(first)})(?<!\\w)", inner
        inner = pattern.removesuffix(r"\b")
        last = edge_chars(inner, last=True) if inner != pattern else None
        if last and last <= WORD_CHARS:
            pattern = inner + r"(?!\w)"
    pattern = pattern.replace(r"[^\s", r"[^\t\n\f\r ").replace(r"\s", r"[\t\n\f\r ]")
    pattern = pattern.replace(r"\b", WORD_EDGE).replace(r"\B", NO_WORD_EDGE)
    return lead, re.sub(r"\\.|\[(?:\\.|[^\]\\])+\]|\((?!\?)", lambda m: "(?:" if m[0] == "(" else m[0], pattern)


#: The scan for words with a digit, which all patterns of such words share.
WORDS = ("words", 0, False)


def word_pattern(pattern: str) -> str | None:
    """A Java pattern for whole words, if all matches of the pattern are words (runs of letters, digits and underscores) that hold a digit; else None."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    if pattern != rf"\b{inner}\b" or "(?i)" in pattern or r"\b" in inner or r"\p" in inner:
        return None
    digit = False

    def only_words(seq) -> bool:
        nonlocal digit
        for op, arg in seq:
            name = str(op)
            if name in ("LITERAL", "IN"):
                chars = {chr(arg)} if name == "LITERAL" else chars_of(arg)
                digit |= chars <= set("0123456789")
            elif name == "MAX_REPEAT" and len(arg[2]) == 1 and str(arg[2][0][0]) in ("LITERAL", "IN"):
                op, arg, low = arg[2][0][0], arg[2][0][1], arg[0]
                chars = {chr(arg)} if str(op) == "LITERAL" else chars_of(arg)
                digit |= low > 0 and chars <= set("0123456789")
            elif name == "SUBPATTERN":
                if not only_words(arg[-1]):
                    return False
                continue
            else:
                return False
            if not chars <= WORD_CHARS:
                return False
        return True

    try:
        return f"^{lead_and_body(inner)[1]}$" if only_words(_parser.parse(inner, re.ASCII)) and digit else None
    except re.error:
        return None


def java_email() -> tuple[str, str]:
    """The mailbox pattern as what stands before a match and the match, in time proportional to the text.

    A match can only begin at the first word edge of a run of mailbox characters (or right after the match before it): later ones of the run meet the same end. Without nested repeats, as these overflow Java's regex stack.
    """
    run, sign = rf"[\w.{_SIGN}]", rf"[{_SIGN}]"
    head = rf"\G{WORD_EDGE}(?={sign})|(?:\G|(?<!{run}))[.{_SIGN}]*+(?=\w)"
    return head, rf"{run}++(?<!\.)@(?=\w++(?:-\w++)*+\.\w)\w++(?:[-.]\w++)*+"


@cache
def _built_in() -> set[str]:
    return {rx for r in catalog.RECOGNIZERS for _, rx, _ in r.patterns}


def marking(pattern: str, group: int) -> tuple[str, str]:
    """A Java pattern and a replacement that puts marks around the spans of a pattern."""
    if pattern == WORDS[0]:
        return r"(?<!\w)([a-zA-Z_]*+\d\w*+)", OPEN + "$1" + CLOSE
    if pattern not in _built_in() and (parts := native(pattern, group)):
        flag = "(?iu)" if parts[0].startswith("(?iu)") else ""
        return f"{flag}({parts[0].removeprefix(flag)})({parts[1]})({parts[2]})", "$1" + OPEN + "$2" + CLOSE + "$3"
    if pattern == catalog.EMAIL:
        head, body = java_email()
        return f"({head})({body})", "$1" + OPEN + "$2" + CLOSE
    if group:
        # what precedes the span is one character that is no part of a word, or the text's start
        body, edge = re.fullmatch(r"\(\?:\^\|\\W\)\((.*)\)(\\b)", pattern).groups()
        return f"(?={_java_class(edge_chars(body))})(?<!\\w)({lead_and_body(body + edge)[1]})", OPEN + "$1" + CLOSE
    lead, body = lead_and_body(pattern)
    return f"{lead}({body})", OPEN + "$1" + CLOSE


def to_duckdb(pattern: str) -> str:
    """The pattern for DuckDB, whose regular expressions are RE2."""
    return pattern.replace("'", "''")


def gate(pattern: str) -> tuple[str, ...]:
    """A cheap condition that every text with a match meets: texts one of which it holds, or 'digits' and how many stand in a row, or 'like' and a pattern."""
    if pattern == WORDS[0] or pattern not in _built_in() and holds_a_digit(pattern):
        return ("digits", "1")
    if pattern not in _built_in():
        return ("like", "".join(native(pattern) or (to_java(pattern),)))
    if pattern == catalog.EMAIL:
        return ("@",)
    if "https?" in pattern:
        return ("://", "www.")
    if "0x" in pattern:
        return ("0x",)
    if r"\B\+" in pattern:
        return ("+",)
    if pattern == r"\b[A-Z0-9]{7}\b":
        return ("like", "[A-Z0-9]{7}")
    if "{25,34}" in pattern:
        return ("like", "[a-zA-Z0-9]{26}")
    if "{1,4}:){7}" in pattern:
        return ("like", "(?:[0-9a-fA-F]{1,4}:){7}")
    if "{8}-" in pattern:
        return ("like", "[0-9a-fA-F]{8}-")
    if "25[0-5]" in pattern:
        return ("like", r"[0-9]\.[0-9]")
    runs = [int(n) for n in re.findall(r"(?:\\d|\[0-9\])\{(\d+)", pattern)]
    return ("digits", str(max(runs, default=1)))


def gate_condition(key: tuple[str, ...], text: Column, two_digits: Column) -> Column:
    """two_digits: whether the text holds two digits in a row."""
    if key[0] == "digits":
        n = int(key[1])
        return text.rlike("[0-9]") if n < 2 else two_digits if n == 2 else two_digits & text.rlike(f"[0-9]{{{n}}}")
    if key[0] == "like":
        return text.rlike(key[1])
    held = [text.contains(x) for x in key]
    return held[0] if len(held) == 1 else held[0] | held[1]


def cuts(pattern: str, group: int, text: Column, open_: Column) -> Column:
    """array<string>: the text with all matches marked, cut where they begin; null without a match, or where the text doesn't meet open_. text must be free of the marks (see cleared)."""
    marked = F.regexp_replace(text, *marking(pattern, group))
    return F.when(open_, let(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), F.split(m, OPEN))))


def spans_of(parts: Column, about: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """An array of about(start, end, text, before) for all matches that the cuts show, leftmost first, as byte offsets; before: what precedes the match, enough for REACH words.

    Offsets are running sums of the cuts' sizes, and each cut is read once for its own match and at most REACH times for what precedes later ones, so time follows the text's size.
    """

    def preceding(i: Column) -> Column:
        whole = F.concat(*(F.coalesce(F.get(parts, i - k), F.lit("")) for k in range(REACH, 0, -1)))
        near = lambda w: let(F.right(w, F.lit(BEFORE)), lambda x: F.when(F.regexp_count(x, F.lit(NEW_WORD)) < REACH, w).otherwise(x))
        return F.translate(let(whole, near), CLOSE, "")

    def each(ends: Column) -> Column:
        def one(i: Column) -> Column:
            start = F.get(ends, i - 1) + 3
            hit = F.substring_index(F.get(parts, i), CLOSE, 1)
            return about(start, start + F.octet_length(hit), hit, preceding(i))

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one)

    # each cut but the first has a mark of three bytes, as the marks that were cut at had
    found = let(running(parts, F.lit(0), "int", lambda at, part: at + F.octet_length(part) - 3), each)
    return F.when(F.size(parts) > 1, F.filter(found, lambda x: x["end"] > x["start"]))


def cleared(text: Column) -> Column:
    """The text with the marks replaced, null as empty."""
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "﷒﷓")).otherwise(F.coalesce(text, F.lit("")))
