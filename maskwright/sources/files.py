"""Text files of any size as numbered lines, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.operators.scan import content_of


def file_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, row, value): the rows of text files, cut at line feeds. block: where in the file the part begins that a task reads; row: a number that grows from row to row of a block, without gaps."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.make_valid_utf8("value").alias("value"))


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, content): the lines of text files from 1, as lines() gives those of a text.

    Files are read in blocks. The lines of each block are counted first, in a pass that moves a row for each block, and sums of the blocks before it number its lines in the second pass: the content isn't shuffled, and a file may be larger than any task's memory. Empty files have no lines; bytes that are no UTF-8 become U+FFFD. Files must not change between the passes.
    """
    rows = file_rows(spark, paths)
    counted = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    # without hints: Spark broadcasts the blocks if they are few, and moves the rows only if they aren't
    return rows.join(placed, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line"), content_of(F.col("value")).alias("content"))
