"""Lines and diffs that arrive in parts over a stream: what is open at the end of a micro-batch is kept for the next one."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from maskwright.operators.diff import Reader, exclusion
from maskwright.operators.scan import MOST_BYTES, scan_lines

#: next: the number of the part that is due; waiting: parts that came before it, by number; rest: the line that isn't ended; then what a reader knows.
_STATE = "next long, waiting string, rest string, number long, file string, left long"


def _in_parts(stream: DataFrame, key: str, number: str, text: str, schema: str, read: Callable) -> DataFrame:
    """Rows of read(line, state) for all lines of each source, in order, whatever the order of its parts."""
    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        due, waiting, rest, *state = held.get if held.exists else (0, "{}", "", 0, None, 0)
        parts = json.loads(waiting) | {str(k): None if pd.isna(t) else t for b in batches for k, t in zip(b["number"], b["text"], strict=True) if k >= due}
        out = []
        while str(due) in parts:
            more = parts.pop(str(due))
            due += 1
            # a null part ends the source: its last line needs no line feed
            rows = (rest + (more or "")).split("\n") if more is not None else [rest, ""] if rest else [""]
            rest = rows.pop()
            if len(rest.encode()) >= MOST_BYTES:
                raise ValueError("a line is too long")
            out += [x for row in rows for x in read(row.removesuffix("\r"), state)]
        held.update((due, json.dumps(parts), rest, *state))
        columns = [c.split()[0] for c in schema.split(", ")]
        yield pd.DataFrame(out, columns=columns).assign(**{key: keys[0]})[[key, *columns]]

    rows = stream.select(F.col(key), F.col(number).cast("long").alias("number"), F.col(text).alias("text")).filter(F.col(key).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, {schema}", _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_lines(stream: DataFrame, key: str = "source", number: str = "number", text: str = "text") -> DataFrame:
    """(source, line, content): the lines of each source of a stream of (source, number, text), where `number` counts a source's parts from 0 and parts may end anywhere in a line.

    Parts that come early wait in the state, and so does a line that isn't ended; parts that were read already, repeated ones among them, are left out. A null text ends a source. Rows without a source are left out.
    """

    def read(row: str, state: list) -> list[tuple]:
        state[0] += 1
        return [(state[0], row)]

    return _in_parts(stream, key, number, text, "line long, content string", read)


def stream_diff_lines(stream: DataFrame, key: str = "source", number: str = "number", text: str = "text", exclude: list[str] | None = None) -> DataFrame:
    """(source, file, line, content): the lines that diffs add, as diff_lines gives them, from parts as in stream_lines. The file, the line and the open hunk outlive a micro-batch."""
    out = exclusion(exclude or [])

    def read(row: str, state: list) -> list[tuple]:
        reader = Reader(out, state[1], state[0], state[2])
        added = reader.read(row)
        state[:] = reader.number, reader.file, reader.left
        return [added] if added else []

    return _in_parts(stream, key, number, text, "file string, line long, content string", read)


def scan_stream(stream: DataFrame, key: str = "source", number: str = "number", text: str = "text", **settings) -> DataFrame:
    """(source, line, entity_type, value_masked, score): the findings of scan_lines in the lines of a stream."""
    return scan_lines(stream_lines(stream, key, number, text), key, **settings)
