"""Reports whose groups and findings may be of any size."""

import json
import math
import random

from pyspark.sql import functions as F

from maskwright.operators import reports


def test_quantiles(spark):
    r = random.Random(8)
    groups = {"a": [r.choice([1.0, 2.0, 5.0]) for _ in range(500)], "b": [10.0 ** r.randint(-300, 300) * r.choice([-1, 1]) for _ in range(300)], "c": [7.5], "": [1e308, -1e308, 0.0, 5e-324], None: [r.random() for _ in range(1000)], "one far": [float(k) for k in range(100)] + [1e300]}
    rows = [(k, x) for k, xs in groups.items() for x in [*xs, None, math.nan]] + [("empty", None)]
    wanted = {"least": 0.0, "p50": 0.5, "p99": 0.99, "most": 1.0}
    got = reports.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], "x", wanted).collect()
    assert {q.g: tuple(q)[1:] for q in got} == {k: tuple(sorted(xs)[int(p * (len(xs) - 1))] for p in wanted.values()) for k, xs in groups.items()}
    assert reports.quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", wanted).collect() == []


def test_a_report_of_repeated_findings(spark):
    """Each stays a row, and one of the least is the first."""
    one = spark.range(5000).select(F.lit(1).alias("line"), F.lit("A").alias("entity_type"), F.lit("x\"y").alias("value_masked"), F.lit(0.5).alias("score"))
    found = one.unionByName(one.limit(3).withColumn("line", F.lit(2))).unionByName(one.limit(1).withColumn("entity_type", F.lit(None).cast("string")))
    lines = reports.json_report(found)
    assert max(map(len, (r.line for r in lines.collect()))) < 100
    value = json.loads("\n".join(r.line for r in lines.orderBy("place", F.length("line")).collect()))
    assert value["total"] == 5004 and len(value["findings"]) == 5004 and "entity_type" not in value["findings"][0] and value["findings"][-1]["line"] == 2
    assert json.loads("\n".join(r.line for r in reports.json_report(found.limit(0)).orderBy("place").collect())) == {"findings": [], "total": 0}
