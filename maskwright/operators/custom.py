"""Recognizers of one's own: from code, dicts or JSON files, with look-around, any span group and checks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.patterns import Unknown, flat, parsed
from maskwright.functions.regex import BEFORE, REACH
from maskwright.operators.catalog import Recognizer

_NEW_WORD = regex.compile(r"[^\p{L}\p{Nd}\p{M}][\p{L}\p{Nd}\p{M}]")

#: Seconds a pattern may take on one text; the matches found until then count.
SECONDS = 1.0


def recognizer(entity: str, patterns: list[tuple[float, str, int]], context: list[str] | None = None, name: str | None = None, language: str = "en", validator: Callable[[Column], Column] | str | None = None, accepts: Callable[[Column], Column] | None = None) -> Recognizer:
    """A recognizer of one's own. Patterns mean what they mean in RE2 (ASCII classes and word edges) and run in the JVM if their form shows that Java finds the same in time that follows the text's size; others run in Python, with a time limit, and those with look-around or back references know Unicode's letters and digits. validator: a function from the span's text to a condition, or the name of a built-in check; accepts: a function from the span, with the text before it, to a condition."""
    for score, pattern, group in patterns:
        if not 0 <= score <= 1:
            raise ValueError(f"score {score} of {entity} isn't between 0 and 1")
        if not 0 <= group <= regex.compile(pattern).groups:
            raise ValueError(f"pattern {pattern!r} of {entity} has no group {group}")
    return Recognizer(entity, name or f"{entity}Recognizer", language, list(patterns), list(context or []), validator, [], True, accepts)


def from_specs(specs: list[dict]) -> list[Recognizer]:
    """Recognizers of dicts: entity, patterns (each regex, score and group, or 0), and if wanted name, language, context, validator."""
    return [recognizer(s["entity"], [(float(p.get("score", 0.5)), p["regex"], int(p.get("group", 0))) for p in s["patterns"]], s.get("context"), s.get("name"), s.get("language", "en"), s.get("validator")) for s in specs]


def from_file(path: str) -> list[Recognizer]:
    with open(path, encoding="utf-8") as f:
        return from_specs(json.load(f))


def compiled_for_python(pattern: str) -> regex.Pattern:
    """The pattern as RE2 takes it where RE2 has all of it, else as it is."""
    try:
        names = {str(op) for op, _ in flat(parsed(pattern))}
    except Unknown:
        names = {"ASSERT"}
    if names & {"ASSERT", "ASSERT_NOT", "GROUPREF", "GROUPREF_EXISTS", "ATOMIC_GROUP", "POSSESSIVE_REPEAT"}:
        return regex.compile(pattern)
    as_re2 = {"$": r"\Z", r"\s": r"[\t\n\f\r ]"}
    return regex.compile(regex.sub(r"\\.|\[(?:\\.|[^\]\\])+\]|\$", lambda m: as_re2.get(m[0], m[0]), pattern), regex.ASCII)


def _before(text: str, a: int) -> str:
    """What precedes a span: as many characters as hold enough words for its context."""
    size = BEFORE
    while size < a and len(_NEW_WORD.findall(text, a - size, a)) < REACH:
        size *= 4
    return text[max(0, a - size) : a]


def spans_of(pattern: regex.Pattern, group: int, text: str, seconds: float = SECONDS) -> list[tuple[int, int, str, str]]:
    """(start, end, text, before) of all non-empty matches, in bytes."""
    out, at, size = [], 0, 0
    try:
        for m in pattern.finditer(text, timeout=seconds):
            a, b = m.span(group)
            if a < 0 or a == b:
                continue
            # a group inside a look-behind may lie before the last one
            size = size + len(text[at:a].encode()) if a >= at else len(text[:a].encode())
            at = a
            out.append((size, size + len(text[a:b].encode()), text[a:b], _before(text, a)))
    except TimeoutError:
        pass
    return out


def lookaround_matches(pattern: str, group: int, text: Column) -> Column:
    """array<struct<start, end, text, before>> as the native scan gives, by an Arrow function."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string,before:string>>")
    def run(texts: pd.Series) -> pd.Series:
        compiled = compiled_for_python(pattern)
        return pd.Series([[{"start": a, "end": b, "text": t, "before": p} for a, b, t, p in spans_of(compiled, group, x or "")] for x in texts])

    return run(text)
