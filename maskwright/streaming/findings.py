"""Analysis of streams: the analysis is a narrow projection, so a stream takes it as a table does; counts need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskwright.operators.analyze import Options, analyze, rows_of


def windowed_counts(stream: DataFrame, time_column: str = "ts", text_column: str = "text", window: str = "1 minute", late: str = "10 minutes", options: Options | None = None) -> DataFrame:
    """(start, end, entity_type, n): findings by window of event time and type. Rows later than `late` are dropped by the watermark; works on tables too."""
    timed = analyze(stream.select(time_column, text_column).withWatermark(time_column, late), text_column, options)
    rows = rows_of(timed, time_column)
    counted = rows.groupBy(F.window(time_column, window).alias("w"), F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", "entity_type", "n")


def to_parquet(findings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream's rows to a folder once each; the checkpoint folder must outlast the run."""
    return findings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
