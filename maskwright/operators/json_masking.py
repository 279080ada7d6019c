"""Masking inside JSON values and prompts, with counts by type."""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import let
from maskwright.operators.analyze import Options, analyze, set_aside
from maskwright.operators.anonymize import display, spliced
from maskwright.sources.shared import BATCH_BYTES, small_batches

#: Keys whose strings are paths and stay as they are.
PATH_KEYS = ["filenames", "filePath", "file_path", "path"]
#: Findings of these types don't count; scores from THRESHOLD do.
IGNORE, THRESHOLD = ("DATE_TIME", "URL"), 0.5


def masked(text: Column, spans: Column) -> Column:
    """struct<masked, types>: the text with the union of all spans in the form of reports, and the type of each span that had a part of its own.

    Spans are taken from the last start to the first, longer ones first, and each is cut where the one after it begins: of spans that begin alike the longest remains.
    """
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("b"), x["entity_type"].alias("entity_type"))))
    first = lambda ks: F.filter(ks, lambda k, i: (i == 0) | (k["start"] > F.get(ks, i - 1)["start"]))
    cut = lambda ks: F.transform(ks, lambda k, i: F.struct(k["start"].alias("start"), F.least(-k["b"], F.coalesce(F.get(ks, i + 1)["start"], -k["b"])).alias("end"), k["entity_type"].alias("entity_type")))

    def put(ps: Column) -> Column:
        done = let(text.cast("binary"), lambda raw: spliced(raw, ps, lambda p, m: display(m)))
        return F.struct(done.alias("masked"), F.reverse(F.transform(ps, lambda p: p["entity_type"])).alias("types"))

    return F.when(F.size(spans) > 0, let(let(let(keyed, first), cut), put)).otherwise(F.struct(text.alias("masked"), F.array().cast("array<string>").alias("types")))


def summarized(types: Column) -> Column:
    """'EMAIL_ADDRESS ×2, CREDIT_CARD ×1': counts of an array of types, largest first, then by name."""
    counted = F.transform(F.array_distinct(types), lambda t: F.struct((-F.size(F.filter(types, lambda x: x == t))).alias("n"), t.alias("t")))
    return F.array_join(F.transform(F.array_sort(counted), lambda c: F.concat(c["t"], F.lit(" ×"), (-c["n"]).cast("string"))), ", ")


def _analyzed(df: DataFrame, column: str, options: Options | None, ignore: tuple[str, ...]) -> DataFrame:
    found = analyze(df, column, options or Options(threshold=THRESHOLD), out="_found")
    if ignore:
        found = found.withColumn("_found", F.filter("_found", lambda x: ~x["entity_type"].isin(*ignore)))
    return found.withColumn("_masked", masked(F.coalesce(F.col(column), F.lit("")), F.col("_found"))).drop("_found")


_TOKEN = re.compile(r'[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)|([\[\]{},:]))')
_LONE = re.compile("[\ud800-\udfff]")


def _read(literal: str) -> str:
    """The string of a JSON literal; halves of surrogate pairs that stand alone become U+FFFD."""
    return _LONE.sub("\ufffd", json.loads(literal)) if "\\" in literal else literal[1:-1]


def literals(text: str | None) -> list[tuple[int, int]] | None:
    """Where the literals of the strings to mask lie, in order: all but keys and those under a key of paths; list items are under their list's key. None if the text isn't JSON.

    Read token by token, so depth, sizes of numbers and repeated keys don't matter.
    """
    if text is None:
        return None
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, str | None]] = []  # the bracket and the key that holds where it was opened
    key, want, at = None, "value", 0
    while want != "nothing":
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        string, scalar, sign = m.groups()
        at, done = m.end(), False
        if sign in ("}", "]"):
            if not stack or stack[-1][0] + sign not in ("{}", "[]") or want not in ("more", "key or end" if sign == "}" else "value or end"):
                return None
            key, done = stack.pop()[1], True
        elif want.startswith("key") and string:
            key, want = _read(string), "colon"
        elif want == "colon" and sign == ":":
            want = "value"
        elif want == "more" and sign == ",":
            key, want = stack[-1][1], "key" if stack[-1][0] == "{" else "value"
        elif want.startswith("value") and sign in ("{", "["):
            stack.append((sign, key))
            want = "key or end" if sign == "{" else "value or end"
        elif want.startswith("value") and (string or scalar):
            if string and key not in PATH_KEYS:
                found.append(m.span(1))
            done = True
        else:
            return None
        if done:
            want = "more" if stack else "nothing"
    return None if text[at:].strip(" \t\n\r") else found


def leaves(text: str | None) -> list[str] | None:
    """The strings to mask, in order; None if the text isn't JSON."""
    found = literals(text)
    return None if found is None else [_read(text[a:b]) for a, b in found]


def rebuilt(text: str, new: list[str]) -> str:
    """The JSON text with the strings to mask replaced by new ones where these differ; every other character stays."""
    out, at = [], 0
    for (a, b), s in zip(literals(text), new, strict=True):
        if s != _read(text[a:b]):
            out += [text[at:a], json.dumps(s, ensure_ascii=False)]
            at = b
    return "".join([*out, text[at:]])


def mask_json(df: DataFrame, id_column: str, json_column: str = "json", options: Options | None = None, ignore: tuple[str, ...] = IGNORE) -> DataFrame:
    """(id, json, summary): each JSON value with personal data in its strings masked, and the counts by type. Only the literals of strings with findings are written anew: numbers, escapes, white space, the order of keys and repeated keys stay as they are.

    Where nothing is found, or the column is null or no JSON, the value stays as it is and the summary is empty; ids may repeat or be null.
    An Arrow function sends a row's value and then its strings, which are analyzed natively in that order, and another puts them together: nothing is shuffled, and a worker holds a batch of bounded bytes, or one row with its strings.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def out(batches):
        for b in batches:
            rows: list[tuple] = []
            used = 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _, _ in rows], pa.int64())), pa.array([s is None for _, _, s in rows], pa.bool_()), pa.array([t for _, t, _ in rows], pa.string()), pa.array([s for _, _, s in rows], pa.string())], names=["id", "head", "json", "leaf"])  # noqa: B023

            for k, value in enumerate(b.column(1)):
                t = value.as_py()
                rows.append((k, t, None))
                rows += [(k, None, s) for s in leaves(t) or ()]
                used += len(t or "")
                if used > BATCH_BYTES // 4:
                    yield batch()
                    rows, used = [], 0
            yield batch()

    def back(batches):
        held = None

        def done():
            i, t, new, types = held
            found = Counter(types)
            return i, rebuilt(t, new) if found else t, ", ".join(f"{k} ×{n}" for k, n in sorted(found.items(), key=lambda x: (-x[1], x[0])))

        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), b.column(0).type), pa.array(list(cols[1]), pa.string()), pa.array(list(cols[2]), pa.string())], names=[id_column, json_column, "summary"])

        for b in batches:
            rows, used = [], 0
            for x in zip(*b.columns, strict=True):
                i, head, t, m, types = (v.as_py() for v in x)
                if head:
                    if held:
                        rows.append(done())
                        used += len(held[1] or "")
                    held = (i, t, [], [])
                else:
                    held[2].append(m)
                    held[3].extend(types)
                if used > BATCH_BYTES // 4:
                    yield batch(rows)
                    rows, used = [], 0
            yield batch(rows)
        if held:
            yield batch([done()])

    small_batches(df.sparkSession)
    strings = df.select(id_column, json_column).mapInArrow(out, f"id {kind}, head boolean, json string, leaf string")
    found = _analyzed(strings, "leaf", options, ignore).select("id", "head", "json", "_masked.masked", "_masked.types")
    return found.mapInArrow(back, f"`{id_column}` {kind}, `{json_column}` string, summary string")


def mask_tool_events(df: DataFrame, id_column: str, skip_tools: tuple[str, ...] = ("Read",), options: Options | None = None) -> DataFrame:
    """(id, json, summary) of rows (id, tool_name, tool_response): the masked response of each event with findings. Events of skipped tools have no row."""
    chosen = df.filter(F.col("tool_name").isNull() | ~F.col("tool_name").isin(*skip_tools)) if skip_tools else df
    return mask_json(chosen.select(id_column, F.col("tool_response").alias("json")), id_column, "json", options).filter("summary <> ''")


def guard_prompts(df: DataFrame, prompt_column: str = "prompt", mode: str = "warn", options: Options | None = None, ignore: tuple[str, ...] = IGNORE) -> DataFrame:
    """df with decision, summary and masked: prompts with findings get the mode (warn or block) as decision and, to block, a masked view; others get nulls. Nothing is shuffled."""
    if mode not in ("warn", "block"):
        raise ValueError(f"unknown mode {mode!r}")
    df, given = set_aside(df)
    prompt_column = {name.lower(): held for held, name in given.items()}.get(prompt_column.lower(), prompt_column)
    found = _analyzed(df, prompt_column, options, ignore)
    hit = F.size("_masked.types") > 0
    return found.withColumns({"decision": F.when(hit, F.lit(mode)), "summary": F.when(hit, summarized(F.col("_masked.types"))), "masked": F.when(hit & F.lit(mode == "block"), F.col("_masked.masked"))}).drop("_masked").withColumnsRenamed(given)
