"""Diffs in chunks: no Python call for each diff or chunk, and batches of bounded bytes."""

import random

import pyarrow as pa

from maskwright.operators import diff
from maskwright.sources.shared import BATCH_BYTES
from tests.test_json_batches import Caught
from tests.test_large import diffs

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


class Joined(Caught):
    join = repartition = sortWithinPartitions = lambda self, *rest: self


def test_lines_alone_sum_up_as_whole_summaries():
    r, plain = random.Random(4), 0
    for text in [*diffs(2000, 3), *("\n".join(r.choices(["+a", " b", "-c", "", "+++", " @@ -1 +1 @@"], k=5)) for _ in range(500)), "", "\n", "+", " "]:
        n = diff.counted_lines(text)
        plain += n is not None
        for state in ([None, 0, 0], ["f", 7, 0], ["f", 7, 2], ["f", 7, 90], [None, 7, 2]):
            assert n is None or diff.after_lines(state, n) == diff.after(state, diff.summary_of(text.split("\n")))
    assert plain > 500


def test_states_come_without_a_call_for_each_diff(spark):
    spark.conf.unset(KEY)
    texts = [(k, f"+++ b/{k}\n@@ -0,0 +1,9 @@\n" + "+x\n" * 9) for k in range(50)]
    found = diff.chunked_diff_lines(diff.diff_chunks(spark.createDataFrame(texts, "id long, diff string"), "id", size=8), "id")
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((k, *x) for k, t in texts for x in diff.added_lines(t))
    assert int(spark.conf.get(KEY).removesuffix("b")) <= BATCH_BYTES


def test_lines_of_many_chunks_share_a_batch(spark):
    table = Joined(spark.createDataFrame([], "source string, key string, block long, chunk int, text string"))
    diff.chunked_diff_lines(table)
    run = table.functions[-1]
    texts = ["+" + "x" * 1000] * 10_000
    given = pa.RecordBatch.from_pydict({"source": ["s"] * 10_000, "text": texts, "in_file": ["f"] * 10_000, "number": pa.array([1] * 10_000, pa.int64()), "left": pa.array([1] * 10_000, pa.int64())})
    sent = list(run([given]))
    assert max(b.nbytes for b in sent) < 2 * BATCH_BYTES and len(sent) < 20
    assert [r for b in sent for r in b.to_pylist()] == [{"source": "s", "file": "f", "line": 1, "content": "x" * 1000}] * 10_000


def test_chunks_of_files_share_a_batch(spark, monkeypatch):
    spark.conf.unset(KEY)
    table = Caught(spark.createDataFrame([], "file string"))
    monkeypatch.setattr(diff, "file_rows", lambda *rest: table)
    diff.file_chunks(spark, "x", 500)
    assert int(spark.conf.get(KEY).removesuffix("b")) <= BATCH_BYTES
    values = [f"{k} " + "y" * 300 for k in range(20_000)]
    given = pa.RecordBatch.from_pydict({"file": ["f"] * 15_000 + ["g"] * 5000, "block": pa.array([0] * 20_000, pa.int64()), "value": values})
    sent = list(table.functions[0]([given.slice(0, 7001), given.slice(7001)]))
    assert max(b.nbytes for b in sent) < 2 * BATCH_BYTES and len(sent) < 10
    rows = [r for b in sent for r in b.to_pylist()]
    assert "\n".join(r["text"] for r in rows) == "\n".join(values) and len(rows) > 5000
    assert [r["chunk"] for r in rows] == [*range(sum(r["source"] == "f" for r in rows)), *range(sum(r["source"] == "g" for r in rows))]
