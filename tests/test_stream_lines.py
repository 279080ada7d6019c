"""A stream of parts gives what the whole texts give, also after a restart."""

import random

from pyspark.sql import functions as F

from maskwright.operators import diff
from maskwright.operators.analyze import Options
from maskwright.operators.scan import scan
from maskwright.streaming import lines
from test_large import diffs

MAILS = Options(entities=["EMAIL_ADDRESS"])


def parts(texts, seed):
    """(source, number, text) in an order of chance, some twice, each source ended by null."""
    r, out = random.Random(seed), []
    for k, t in texts:
        n = 0
        while t:
            size = r.randint(1, 40)
            out.append((k, n, t[:size]))
            t, n = t[size:], n + 1
        out.append((k, n, None))
    out += out[:5] + [(None, 0, "j@x.com\n")]
    r.shuffle(out)
    return out


def streamed(spark, tmp_path, rows, make):
    """What a stream gives that reads the rows in five batches and is stopped and started again between them."""
    schema, at = "source int, number int, text string", [str(tmp_path / x) for x in ("in", "out", "state")]
    for k in range(5):
        spark.createDataFrame(rows[k::5], schema).coalesce(1).write.mode("append").parquet(at[0])
        stream = make(spark.readStream.schema(schema).parquet(at[0]))
        stream.writeStream.format("parquet").option("path", at[1]).option("checkpointLocation", at[2]).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at[1])


def test_lines_over_a_stream(spark, tmp_path):
    texts = [(k, t) for k, t in enumerate(["", "one\r\ntwo j@x.com", "\n\n", "mail j@x.com\nand k@x.com\r\n" * 20, "x" * 200])]
    got = streamed(spark, tmp_path, parts(texts, 1), lambda s: lines.scan_stream(s, options=MAILS))
    want = scan(spark.createDataFrame(texts, "source int, text string"), "source", options=MAILS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.withColumn("line", F.col("line").cast("long")).collect())) and got.count() == 41


def test_diffs_over_a_stream(spark, tmp_path):
    texts = [(k, t) for k, t in enumerate(diffs(12, 3))]
    got = streamed(spark, tmp_path, parts(texts, 2), lambda s: lines.stream_diff_lines(s, exclude=["skip.*"]))
    want = sorted((k, *x) for k, t in texts for x in diff.added_lines(t, diff.exclusion(["skip.*"])))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
