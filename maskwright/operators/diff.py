"""Unified diffs: the lines they add, and the findings in these."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.arrays import let
from maskwright.operators.analyze import Options, analyze, rows_of
from maskwright.operators.anonymize import display
from maskwright.operators.pieces import places
from maskwright.sources.files import file_rows
from maskwright.sources.shared import BATCH_BYTES, small_batches

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))?", re.ASCII)


def glob_to_regex(glob: str) -> str:
    """A shell pattern as a regular expression for whole names: * and ? stay within a folder, [a-z] and [^a-z] are classes, a backslash takes the next character as it is."""
    out, rest = "", glob
    while rest:
        found = re.match(r"\\(.)|\[(\^?)((?:\\.|[^\]\\])+)\]|(.)", rest, re.DOTALL)
        quoted, negated, inside, plain = found.groups()
        if inside:
            out += f"[{negated}{inside.replace('[', chr(92) + '[')}]"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(plain, re.escape(quoted or plain))
        rest = rest[found.end() :]
    return out


def exclusion(globs: list[str]) -> re.Pattern | None:
    """One regular expression for the paths that globs leave out: by full path, by file name, or, for folder/**, by folder. None if there are none."""
    ways = [re.escape(g[:-3]) + "/.*" for g in globs if g.endswith("/**")] + [f"(?:.*/)?{glob_to_regex(g)}" if "/" not in g else glob_to_regex(g) for g in globs]
    return re.compile(f"(?s)(?:{'|'.join(ways)})\\Z") if ways else None


class Reader:
    """What is known at a row of a diff: the file (None: one that is left out, or none yet), the next line's number in it, and the lines left of the hunk. A hunk ends by its stated count, so an added line that looks like a file header is none."""

    def __init__(self, out: re.Pattern | None = None, file=None, number: int = 0, left: int = 0):
        self.out, self.file, self.number, self.left = out, file, number, left

    def name(self, row: str) -> str | None:
        """The file of a header row."""
        name = row[4:].removeprefix("b/")
        return None if name in ("/dev/null", "") or (self.out and self.out.match(name)) else name

    def read(self, row: str) -> tuple | None:
        """(file, line in the new version, content) if the row adds a line."""
        row = row.removesuffix("\r")
        if row.startswith("diff --git "):
            self.left = 0
        elif self.left <= 0 and row.startswith("+++ "):
            self.file = self.name(row)
        elif self.file is None:
            return None
        elif hunk := _HUNK.match(row):
            self.number, self.left = int(hunk[1]), int(hunk[2] or 1)
        elif self.left > 0 and row[:1] in ("+", " "):
            self.number, self.left = self.number + 1, self.left - 1
            return (self.file, self.number - 1, row[1:]) if row[0] == "+" else None
        return None


def added_lines(diff: str, out: re.Pattern | None = None) -> Iterator[tuple[str, int, str]]:
    """(file, line in the new version, content) of each added line of files that `out` doesn't match."""
    reader = Reader(out)
    for row in diff.removesuffix("\n").split("\n") if diff else ():
        if added := reader.read(row):
            yield added


def diff_lines(df: DataFrame, id_column: str, diff_column: str = "diff", exclude: list[str] | None = None) -> DataFrame:
    """(id, file, line, content) of the lines that each row's diff adds, without excluded files. Null and empty diffs add none.

    One diff is read in order by one task; diffs are independent rows, and nothing is shuffled.
    """
    kind, out = df.schema[id_column].dataType.simpleString(), exclusion(exclude or [])

    def run(batches):
        for b in batches:
            for k, text in enumerate(b.column(1)):
                rows = list(added_lines(text.as_py() or "", out))
                files, numbers, contents = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(rows), b.column(0).type), pa.array(files, pa.string()), pa.array(numbers, pa.int32()), pa.array(contents, pa.string())], names=[id_column, "file", "line", "content"])

    return df.select(id_column, diff_column).mapInArrow(run, f"`{id_column}` {kind}, file string, line int, content string")


def scan_diff(df: DataFrame, id_column: str, diff_column: str = "diff", options: Options | None = None, ignore: tuple[str, ...] = ("DATE_TIME", "URL"), exclude: list[str] | None = None) -> DataFrame:
    """(id, file, line, entity_type, value_masked, score): findings in the added lines."""
    found = analyze(diff_lines(df, id_column, diff_column, exclude), "content", options or Options(threshold=0.4))
    rows = rows_of(found, id_column, "file", "line").filter(~F.col("s.entity_type").isin(*ignore) if ignore else F.lit(True))
    return rows.select(id_column, "file", "line", "s.entity_type", display(F.col("s.text")).alias("value_masked"), "s.score")


#: Bytes of a chunk of a large diff, about.
CHUNK = 1 << 20
#: Stands for the file at a chunk's begin.
_SAME = 0
#: Rows that may do more than count as lines of a hunk.
_SETTING = re.compile(r"^(?:\+\+\+ |diff --git |@@ -)", re.MULTILINE)


def summary_of(rows: list[str], out: re.Pattern | None = None) -> dict:
    """What a chunk of rows makes of any state before it; states are [file, number, left].

    Outside of hunks only the file counts, and of it only whether there is one (open) or not (closed). In a hunk, rows count as lines until it is used up or a row comes that sets the state whatever it was: `at` is that row, the first that begins a hunk or a file's diff. Of what lies between, only the last header row can matter, and only where the hunk ended before it, that is, had no more lines left than the rows counted before it (`named`): then `other` is the chunk's end, else `same`.
    """

    def end(file, rows) -> list:
        reader = Reader(out, file)
        for row in rows:
            reader.read(row)
        return [reader.file, reader.number, max(reader.left, 0)]

    at = next((k for k, row in enumerate(rows) if row.startswith("diff --git ") or _HUNK.match(row)), None)
    named, name, counted = -1, None, 0
    for row in rows[:at]:
        if row.startswith("+++ "):
            named, name = counted, Reader(out).name(row.removesuffix("\r"))
        counted += row[:1] in ("+", " ")
    found = {"closed": end(None, rows), "open": end(_SAME, rows), "counted": counted, "named": named, "name": name, "same": None, "other": None}
    if at is not None:
        found |= {"same": end(_SAME, rows[at:]), "other": end(name, rows[at:])}
    return found


def counted_lines(text: str) -> int | None:
    """For a chunk without headers and hunks, which most are, all that its summary tells: how many rows a hunk counts. None for others."""
    return None if _SETTING.search(text) else text.startswith(("+", " ")) + text.count("\n+") + text.count("\n ")


def after_lines(state: list, counted: int) -> list:
    """after() of a chunk that only has counted_lines."""
    file, number, left = state
    return [file, number + counted, max(0, left - counted)] if left > 0 else [file, 0, 0]


def after(state: list, summary: dict) -> list:
    """The state after a chunk, from that before it."""
    file, number, left = state
    if left <= 0:
        found = summary["closed" if file is None else "open"]
    elif left <= summary["named"]:
        found = summary["other"] or [summary["name"], 0, 0]
    else:
        found = summary["same"] or [_SAME, number + summary["counted"], max(0, left - summary["counted"])]
    return [file if found[0] == _SAME else found[0], found[1], found[2]]


def diff_chunks(df: DataFrame, id_column: str, diff_column: str = "diff", size: int = CHUNK) -> DataFrame:
    """(id, key, block, chunk, text): each diff cut at line feeds into chunks, dealt to all tasks. Diffs of one key have the same text."""
    raw, n = F.col(diff_column).cast("binary"), F.octet_length(diff_column)

    def cut(raw: Column) -> Column:
        part = lambda bounds, k: F.substring(raw, F.get(bounds, k) + F.when(k > 0, 2).otherwise(1), F.get(bounds, k + 1) - F.get(bounds, k) - F.when(k > 0, 1).otherwise(0)).cast("string")
        return let(places(raw, n, r"\n", size), lambda bounds: F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: part(bounds, k)))

    chunks = df.filter(n > 0).select(id_column, F.sha2(raw, 256).alias("key"), F.lit(0).cast("long").alias("block"), F.posexplode(let(raw, cut)).alias("chunk", "text"))
    # as chunked_diff_lines joins them, so that the join need not deal them again
    return chunks.repartition("key", "block", "chunk")


def file_chunks(spark: SparkSession, paths: str | list[str], size: int = CHUNK) -> DataFrame:
    """(source, key, block, chunk, text): diff files of any size in chunks of whole rows, read in parallel."""

    def run(batches):
        place, held, used, k, full, filled = None, [], 0, 0, [], 0

        def batch() -> pa.RecordBatch:
            at, chunks, texts = zip(*full, strict=True)
            files = pa.array([file for file, _ in at], pa.string())
            return pa.RecordBatch.from_arrays([files, files, pa.array([block for _, block in at], pa.int64()), pa.array(chunks, pa.int32()), pa.array(texts, pa.string())], names=["source", "key", "block", "chunk", "text"])

        for b in batches:
            for x in zip(*(b.column(c) for c in ("file", "block", "value")), strict=True):
                file, block, value = (v.as_py() for v in x)
                if held and (used > size or place != (file, block)):
                    full.append((place, k, "\n".join(held)))
                    held, filled, used, k = [], filled + used, 0, k + 1
                    if filled > BATCH_BYTES:
                        yield batch()
                        full, filled = [], 0
                if place != (file, block):
                    place, k = (file, block), 0
                held.append(value)
                used += len(value) + 1
        if held:
            full.append((place, k, "\n".join(held)))
        if full:
            yield batch()

    small_batches(spark)
    return file_rows(spark, paths).select("file", "block", "value").mapInArrow(run, "source string, key string, block long, chunk int, text string")


def chunked_diff_lines(chunks: DataFrame, id_column: str = "source", exclude: list[str] | None = None) -> DataFrame:
    """(id, file, line, content): what diff_lines gives, of diffs in chunks that any task can read.

    A first pass sums up each chunk as what it makes of any state before it; a diff's small summaries are applied in order, which gives the state at each chunk's begin; a second pass reads the chunks from there. The text is read twice and moved only if the states are too many to broadcast. Python workers hold a batch of bounded bytes, and the states of a diff pass by one at a time.
    """
    kind, out = chunks.schema[id_column].dataType.simpleString(), exclusion(exclude or [])

    def sums(batches):
        for b in batches:
            rows = {}
            for k, at in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "block", "chunk")), strict=True)):
                if at not in rows:  # equal diffs of several rows have equal summaries
                    text = b.column("text")[k].as_py()
                    n = counted_lines(text)
                    rows[at] = (k, n, json.dumps(summary_of(text.split("\n"), out)) if n is None else None)
            k, counted, summaries = zip(*rows.values(), strict=True) if rows else ((), (), ())
            places = b.select(["key", "block", "chunk"]).take(pa.array(k, pa.int64()))
            yield pa.RecordBatch.from_arrays([*places.columns, pa.array(counted, pa.int64()), pa.array(summaries, pa.string())], names=["key", "block", "chunk", "counted", "summary"])

    def states(batches):
        last, state, begin = (None, None, None), [], []
        for b in batches:
            rows, begins = [], []
            for k, (*at, counted, summary) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if at == last:
                    continue
                begin = [None, 0, 0] if at[0] != last[0] else state
                state = after(begin, json.loads(summary)) if counted is None else after_lines(begin, counted)
                last = at
                rows.append(k)
                begins.append(begin)
            files, numbers, left = zip(*begins, strict=True) if begins else ((), (), ())
            places = b.select(["key", "block", "chunk"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*places.columns, pa.array(files, pa.string()), pa.array(numbers, pa.int64()), pa.array(left, pa.int64())], names=["key", "block", "chunk", "in_file", "number", "left"])

    def run(batches):
        for b in batches:
            rows, of, used = [], [], 0

            def batch() -> pa.RecordBatch:
                files, numbers, contents = zip(*rows, strict=True) if rows else ((), (), ())
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(files, pa.string()), pa.array(numbers, pa.int64()), pa.array(contents, pa.string())], names=[id_column, "file", "line", "content"])  # noqa: B023

            for k, x in enumerate(zip(*b.columns[1:], strict=True)):
                text, *state = (v.as_py() for v in x)
                reader = Reader(out, *state)
                found = [added for row in text.split("\n") if (added := reader.read(row))]
                rows += found
                of += [k] * len(found)
                used += len(text)
                if used > BATCH_BYTES:
                    yield batch()
                    rows, of, used = [], [], 0
            yield batch()

    small_batches(chunks.sparkSession)
    summed = chunks.mapInArrow(sums, "key string, block long, chunk int, counted long, summary string")
    begins = summed.repartition("key").sortWithinPartitions("key", "block", "chunk").mapInArrow(states, "key string, block long, chunk int, in_file string, number long, left long")
    return chunks.join(begins, ["key", "block", "chunk"]).select(id_column, "text", "in_file", "number", "left").mapInArrow(run, f"`{id_column}` {kind}, file string, line long, content string")
