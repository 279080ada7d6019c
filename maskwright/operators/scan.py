"""Line-wise scanning and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.analyze import Options, analyze, rows_of
from maskwright.operators.anonymize import display


#: Bytes of a line at most.
MOST_BYTES = 10 << 20


def content_of(row: Column) -> Column:
    """A line's content: without a carriage return at its end; MOST_BYTES or more fail the job."""
    return F.when(F.octet_length(row) < MOST_BYTES, F.regexp_replace(row, r"\r\z", "")).otherwise(F.raise_error(F.lit("a line is too long")).cast("string"))


def lines(df: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """(id, line, content): the lines of each text from 1, without a carriage return at their end; a line feed at the text's end begins no line. Null texts have none. A line of MOST_BYTES or more fails the job."""
    parts = F.split(F.regexp_replace(F.col(text_column), r"\n\z", ""), "\n")
    return df.filter(F.octet_length(text_column) > 0).select(id_column, F.posexplode(parts).alias("line", "content")).select(id_column, (F.col("line") + 1).alias("line"), content_of(F.col("content")).alias("content"))


def scan(df: DataFrame, id_column: str, text_column: str = "text", options: Options | None = None, ignore: tuple[str, ...] = ("DATE_TIME", "URL")) -> DataFrame:
    """(id, line, entity_type, value_masked, score): findings by line, without the types to ignore."""
    return scan_lines(lines(df, id_column, text_column), id_column, options=options, ignore=ignore)


def scan_lines(lined: DataFrame, *keys: str, options: Options | None = None, ignore: tuple[str, ...] = ("DATE_TIME", "URL")) -> DataFrame:
    """(keys, line, entity_type, value_masked, score): findings in rows of (keys, line, content)."""
    found = analyze(lined.select(*keys, "line", "content"), "content", options or Options(threshold=0.4))
    rows = rows_of(found, *keys, "line").filter(~F.col("s.entity_type").isin(*ignore) if ignore else F.lit(True))
    return rows.select(*keys, "line", "s.entity_type", display(F.col("s.text")).alias("value_masked"), "s.score")


def summary(found: DataFrame) -> DataFrame:
    """(entity_type, n) of findings."""
    return found.groupBy("entity_type").agg(F.count("*").alias("n"))
