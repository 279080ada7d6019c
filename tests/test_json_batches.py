"""What Python workers hold while JSON is masked: batches of bounded bytes, whatever the number of rows."""

import json

import pyarrow as pa

from maskwright.operators import json_masking as jm
from maskwright.plans import large
from maskwright.sources.shared import BATCH_BYTES


class Caught:
    """Stands for a table, and keeps the Arrow functions that it is given."""

    def __init__(self, df):
        self.schema, self.sparkSession, self.functions = df.schema, df.sparkSession, []

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.functions.append(function)
        return self


def caught(spark, monkeypatch):
    table = Caught(spark.createDataFrame([], "id long, json string"))
    monkeypatch.setattr(jm, "_analyzed", lambda df, *rest: df)
    jm.mask_json(table, "id")
    return table.functions


def values(n):
    return [json.dumps({"out": {"lines": [f"{k} " + "x" * 100_000], "path": "p"}}) for k in range(n)]


def rows(batches):
    return [r for b in batches for r in b.to_pylist()]


def test_batches_with_strings_are_small(spark, monkeypatch):
    out, _ = caught(spark, monkeypatch)
    given = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(values(100))], names=["id", "json"])
    sent = list(out([given, given.slice(0, 0)]))
    assert max(b.nbytes for b in sent) < 2 * BATCH_BYTES and sum(b.nbytes for b in sent) > 8 * BATCH_BYTES
    want = [x for k, v in enumerate(values(100)) for x in ({"id": k, "head": True, "json": v, "leaf": None}, {"id": k, "head": False, "json": None, "leaf": json.loads(v)["out"]["lines"][0]})]
    assert rows(sent) == want


def test_batches_of_masked_values_are_small(spark, monkeypatch):
    """Also where a value's strings come in another batch than the value."""
    _, back = caught(spark, monkeypatch)
    given = [x for k, v in enumerate(values(100)) for x in ((k, True, v, None, []), (k, False, None, "masked" if k % 2 else json.loads(v)["out"]["lines"][0], ["A"] * (k % 2)))]
    kinds = [pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*given, strict=True), kinds, strict=True)], names=["id", "head", "json", "masked", "types"])
    sent = list(back([batch.slice(0, 151), batch.slice(151)]))
    assert max(b.nbytes for b in sent) < BATCH_BYTES and sum(b.nbytes for b in sent) > 2 * BATCH_BYTES
    want = [{"id": k, "json": json.dumps({"out": {"lines": ["masked"], "path": "p"}}) if k % 2 else v, "summary": "A ×1" if k % 2 else ""} for k, v in enumerate(values(100))]
    assert rows(sent) == want


def test_spark_sends_small_batches(spark):
    kept = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(kept)
    jm.mask_json(spark.createDataFrame([], "id long, json string"), "id")
    assert int(spark.conf.get(kept).removesuffix("b")) <= BATCH_BYTES
    spark.conf.set(kept, "1000")
    jm.mask_json(spark.createDataFrame([], "id long, json string"), "id")
    assert spark.conf.get(kept).removesuffix("b") == "1000"
    spark.conf.unset(kept)


def test_all_types_in_tiny_batches(spark):
    """The same values whatever the batches are."""
    kept = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(kept)
    found = large.json_all_types(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(kept).removesuffix("b")) <= BATCH_BYTES
    whole = sorted(map(tuple, found.collect()))
    spark.conf.set(kept, "20000")
    assert sorted(map(tuple, large.json_all_types(spark, "/root/testdata/sf0.001").collect())) == whole and any(s for _, s, _ in whole)
    spark.conf.unset(kept)


def test_workers_get_and_send_small_batches(spark, monkeypatch, tmp_path):
    """What the workers of both Arrow functions get and send in a run over all types, one partition of many times the bound."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    table = spark.range(0, 300, 1, 1).selectExpr("id", """concat('{"out": {"lines": ["', id, ' a@b.com ', repeat('some words ', 3000), '"]}}') AS json""")
    plain, at, calls = type(table).mapInArrow, str(tmp_path), []

    def noted(df, function, schema):
        calls.append(k := len(calls))

        def weighed(batches, name):
            for b in batches:
                with open(f"{at}/{name}{k}", "a") as f:
                    f.write(f"{b.nbytes}\n")
                yield b

        return plain(df, lambda batches: weighed(function(weighed(batches, "get")), "send"), schema)

    monkeypatch.setattr(type(table), "mapInArrow", noted)
    found = jm.mask_json(table, "id").collect()
    assert len(found) == 300 and {r.summary for r in found} == {"EMAIL_ADDRESS ×1"}
    assert all(json.loads(r.json)["out"]["lines"][0].split()[0] == str(r.id) and "a@b.com" not in r.json and len(r.json) > 33_000 for r in found)
    for name in ("get0", "send0", "get1", "send1"):
        weights = [int(x) for x in (tmp_path / name).read_text().split()]
        assert max(weights) < 2 * BATCH_BYTES and sum(weights) > 4 * BATCH_BYTES, name
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
