"""Bounded training samples of hashed texts, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, remainder, utf8
from maskwright.llm.subwords import subword_counts


def labels_of(labels: DataFrame, column: str, fold: int = 5) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from: those with crc32(doc_id) mod fold other than 0 and a label; labels met twice count as the larger."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder("doc_id", fold) != 0)).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def hashed_sample(docs: DataFrame, chosen: DataFrame, buckets: int, fold_case: bool, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(y, buckets, counts) of the documents that `chosen` (doc_id, y; a bounded number of rows) names, in a fixed order.

    Whole texts are hashed on the executors; the driver gets at most `buckets` numbers of a text.
    """
    configure(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = subword_counts([t.as_py() for t in b.column(2)], buckets, fold_case)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k.tobytes() for k, _ in rows], pa.binary()), pa.array([c.astype(np.uint16 if c.max(initial=0) < 1 << 16 else np.uint32).tobytes() for _, c in rows], pa.binary())], names=["id", "y", "buckets", "counts"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("text")).join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id").select("doc_id", "y", "text")
    found = mapped(rows, run, "id long, y int, buckets binary, counts binary").toArrow()
    # views of the table's buffers, not copies; counts have two bytes, or four where one is large
    raw = [(np.frombuffer(k.as_buffer(), np.int32), c.as_buffer()) for k, c in zip(found.column("buckets"), found.column("counts"), strict=True)]
    kinds = {2: np.uint16, 4: np.uint32}
    views = [(k, np.frombuffer(c, kinds[c.size // len(k)]) if len(k) else np.zeros(0, np.uint16)) for k, c in raw]
    labels = found.column("y").to_pylist()
    return [(labels[i], *views[i]) for i in np.argsort(found.column("id").to_numpy(), kind="stable")]
