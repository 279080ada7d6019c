"""Fill-in-middle transformation by DuckDB inside mapInArrow.

Each Arrow batch is registered in the worker's own DuckDB and rewritten by one
SQL statement: texts are cut into units with regexp_extract_all, two cuts and
the form are drawn from a sha256 of the document's id, and the parts are put
together from slices of the unit list. No row passes through Python, and no
row leaves its task: a document's result depends on its own id and text alone,
so a lost executor's tasks give the same rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ARROW_BYTES, configure, mapped, slices, valid

#: Bytes of text that DuckDB handles at a time (a longer text goes alone), and what it may take. It has no folder to spill to.
CHUNK_BYTES, MEMORY = 4 << 20, "1GB"


@dataclass(frozen=True)
class Fim:
    """How documents are transformed. unit: pattern of a text's units (its matches must cover the text). rate: documents of 100 that are transformed; spm: those of 100 of them whose suffix comes first. prefix, suffix, middle: the marks; texts that hold one stay plain."""

    seed: int = 7
    unit: str = r"[^\n]*\n|[^\n]+"
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        first = {m[:1] for m in marks}
        # so no mark can begin inside another or across the end of one, and the parts are found again by their marks
        if not all(marks) or len(set(marks)) < 3 or len(first) > 1 or any(first & set(m[1:]) for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("the marks must differ, begin alike, hold that first character once, and none may begin with another")


SQL = r"""
    WITH drawn AS (
        SELECT id, text, regexp_extract_all(text, $unit) AS units, sha256($seed || ':' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch
    ), numbered AS (
        SELECT id, text, units, CAST(len(units) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k - 7, 8) AS BIGINT) FOR k IN range(1, 5)] AS h FROM drawn
    ), placed AS (
        SELECT id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, $prefix) OR contains(text, $suffix) OR contains(text, $middle) OR h[3] % 100 >= $rate THEN 'plain'
                    WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
        FROM numbered
    ), parts AS (
        SELECT id, text, n, form, array_to_string(list_slice(units, 1, a), '') AS p, array_to_string(list_slice(units, a + 1, b), '') AS m, array_to_string(list_slice(units, b + 1, n), '') AS s FROM placed
    ), made AS (
        SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat($prefix, p, $suffix, s, $middle, m) ELSE concat($suffix, s, $prefix, p, $middle, m) END AS output
        FROM parts
    ), rebuilt AS (
        SELECT *, CASE form WHEN 'plain' THEN output
                   WHEN 'psm' THEN concat(substr(split_part(output, $suffix, 1), length($prefix) + 1), split_part(output, $middle, 2), split_part(split_part(output, $suffix, 2), $middle, 1))
                   ELSE concat(split_part(split_part(output, $prefix, 2), $middle, 1), split_part(output, $middle, 2), substr(split_part(output, $prefix, 1), length($suffix) + 1)) END AS restored
        FROM made
    )
"""


def fill_in_middle(docs: DataFrame, fim: Fim = Fim(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored): each document with its middle moved to the end.

    n: the text's units; form: plain, psm (prefix, suffix, middle) or spm (suffix first); prefix_chars, middle_chars: code points of these parts, null if plain; restored: the text rebuilt from output and form. Null texts count as empty, and empty texts stay plain; bytes that are no UTF-8 become U+FFFD; null ids are drawn for as the empty text; repeated rows keep their own rows; other columns are not read.
    """
    return _mapped(docs, fim, id_column, text_column, {"output": "output", "restored": "restored"})


def fim_digests(docs: DataFrame, fim: Fim = Fim(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """fill_in_middle with the sha256 of output and restored text (hex) in their place, so texts aren't moved. Odd rows count as there."""
    return _mapped(docs, fim, id_column, text_column, {"output_sha256": "sha256(output)", "restored_sha256": "sha256(restored)"})


def _mapped(docs: DataFrame, fim: Fim, id_column: str, text_column: str, made: dict[str, str]) -> DataFrame:
    configure(docs.sparkSession, ARROW_BYTES)
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "n", "form", "prefix_chars", "middle_chars", *made]
    statement = SQL + "SELECT id, n, form, prefix_chars, middle_chars, " + ", ".join(made.values()) + " FROM rebuilt"
    values = {"unit": fim.unit, "seed": str(fim.seed), "rate": fim.rate, "spm": fim.spm, "prefix": fim.prefix, "suffix": fim.suffix, "middle": fim.middle}

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(made)]
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "autoinstall_known_extensions": False}) as db:
            for batch in batches:
                schema = pa.schema([pa.field(c, t) for c, t in zip(names, [batch.schema.field(0).type, *kinds], strict=True)])
                for part in slices(batch, CHUNK_BYTES):
                    db.register("batch", pa.Table.from_batches([part]))
                    found = db.sql(statement, params=values).to_arrow_table()
                    db.unregister("batch")
                    yield from found.rename_columns(names).cast(schema).to_batches()

    rows = docs.select(F.col(id_column).alias("id"), valid(text_column).alias("text"))
    return mapped(rows, run, f"`{id_column}` {kind}, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{c} string" for c in made))
