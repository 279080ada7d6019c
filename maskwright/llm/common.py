"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: bounds what a Python worker holds when texts are long.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20


def configure(spark: SparkSession, batch_bytes: int | None = None) -> SparkSession:
    """Settings that the Arrow-based operators rely on. batch_bytes: bytes of an Arrow batch, where these are bounded besides its rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if batch_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where the setting is absent, a local one is made if Spark runs in one process; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm, at = df.sparkSession._jvm, df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _held() -> dict:
    return vars(sys.modules.setdefault("_maskwright_held", types.ModuleType("_maskwright_held"))).setdefault("held", {})


def per_worker(key, make):
    """What make() returns, made once in a Python worker and kept until the worker makes or runs something else."""
    held = _held()
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def trim() -> None:
    """Gives memory that isn't used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Frees what per_worker keeps."""
    if _held():
        _held().clear()
        trim()


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in workers that have first freed what earlier stages kept in them."""

    def alone(batches):
        release()
        return run(batches)

    return df.mapInArrow(alone, schema)


def utf8(column: str) -> Column:
    """The text as bytes, for Arrow without decoding; null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def valid(column: str) -> Column:
    """The text, null as empty, with U+FFFD for bytes that are no UTF-8."""
    return F.make_valid_utf8(F.coalesce(F.col(column), F.lit("")))


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of at most `limit` bytes in its second column, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
