import json
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright.operators import artifacts as art
from maskwright.operators import custom, reports
from maskwright.operators import json_masking as jm
from maskwright.operators.analyze import Options, analyze, findings
from maskwright.operators.diff import added_lines, diff_lines, exclusion, scan_diff
from maskwright.sources import corpus, models
from maskwright.streaming.findings import windowed_counts

DIFF = """diff --git a/user.go b/user.go
index 1..2 100644
--- a/user.go
+++ b/user.go
@@ -9,2 +10,4 @@ func main
 keep
+card 4111 1111 1111 1111
+mail jane@example.com
-old bob@example.com
+++ counted as added
diff --git a/gone.txt b/gone.txt
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-x@example.com
"""
MAILS = Options(entities=["EMAIL_ADDRESS", "CREDIT_CARD"], threshold=0.4)


def test_added_lines():
    assert list(added_lines(DIFF)) == [("user.go", 11, "card 4111 1111 1111 1111"), ("user.go", 12, "mail jane@example.com"), ("user.go", 13, "++ counted as added")]
    assert list(added_lines("--- a\n+++ b/x y\n@@ -1 +1 @@\n+one\n+two\n")) == [("x y", 1, "one")]
    assert list(added_lines("")) == []


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.go", "a/b.go", True), ("a/*.go", "a/b.go", True), ("a/*.go", "a/c/b.go", False), ("vendor/**", "vendor/x/y", True), ("vendor/**", "vendors/x", False), ("[ab]?.t", "q/ax.t", True), ("[^ab].t", "a.t", False), (r"\*.t", "*.t", True)])
def test_exclusion(glob, path, hit):
    assert bool(exclusion([glob]).match(path)) == hit


def test_scan_diff(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "id int, diff string")
    rows = scan_diff(df, "id", options=MAILS).collect()
    assert sorted((r.id, r.file, r.line, r.entity_type) for r in rows) == [(1, "user.go", 11, "CREDIT_CARD"), (1, "user.go", 12, "EMAIL_ADDRESS")]
    assert diff_lines(df, "id", exclude=["*.go"]).count() == 0


def test_mask_json(spark):
    given = {"out": "to jane@example.com", "file_path": "/a/bob@example.com", "filenames": ["c@example.com"], "n": [1, None, {"k": "x@example.com y@example.com"}]}
    df = spark.createDataFrame([(1, json.dumps(given)), (2, "not json"), (3, None), (4, '{"a": "clean"}')], "id int, json string")
    rows = {r.id: r for r in jm.mask_json(df, "id", options=MAILS).collect()}
    assert json.loads(rows[1].json) == given | {"out": "to ja************om", "n": [1, None, {"k": "x@*********om y@*********om"}]}
    assert rows[1].summary == "EMAIL_ADDRESS ×3"
    assert [(rows[k].json, rows[k].summary) for k in (2, 3, 4)] == [("not json", ""), (None, ""), ('{"a": "clean"}', "")]
    events = spark.createDataFrame([(1, "Read", '"a@example.com"'), (2, "Grep", '"a@example.com"')], "id int, tool_name string, tool_response string")
    assert [r.id for r in jm.mask_tool_events(events, "id", options=MAILS).collect()] == [2]


def test_json_stays_as_written(spark):
    """Odd values that a tree of values would lose or fail on."""
    odd = r''' {"b":1e400,"a":-0.10, "b" : "\ud800 \/ j@x.com","n":123456789012345678901234567890,"k j@x.com":"\u00e9","path":["p@x.com",{"z":"q@x.com"}], "\u0070ath": "r@x.com", "e":[]} '''
    deep = "[" * 5000 + '"j@x.com"' + "]" * 5000
    rows = dict(enumerate([odd, deep, '"j@x.com"', "j@x.com", '{"a":"j@x.com"', '{"a":"j@x.com",}', '["j@x.com" 1]', '{"a":"j@x.com"}}', '["j@x.com\n"]', "[01]", '{1:"j@x.com"}', "", "[]", '{"a" "j@x.com"}', '["\\x"]', "NaN", '[}', '{]']))
    got = {r.id: (r.json, r.summary) for r in jm.mask_json(spark.createDataFrame(list(rows.items()), "id int, json string"), "id", options=MAILS).collect()}
    assert got[0] == (odd.replace(r'"\ud800 \/ j@x.com"', '"� / j@***om"').replace("q@x.com", "q@***om"), "EMAIL_ADDRESS ×2")
    assert got[1] == (deep.replace("@x.c", "@***"), "EMAIL_ADDRESS ×1") and got[2] == ('"j@***om"', "EMAIL_ADDRESS ×1")
    assert all(got[k] == (rows[k], "") for k in range(3, len(rows)))


def test_json_is_told_from_other_texts():
    r = random.Random(4)
    for _ in range(20_000):
        text = "".join(r.choices(['"', "a", "\\\\", "\\n", "[", "]", "{", "}", ":", ",", "1", "-", ".", "e", "0", " ", "true", "null", '"a"', '"a":', "\\u12aB"], k=r.randint(1, 8)))
        try:
            json.loads(text)
            valid = True
        except ValueError:
            valid = False
        assert (jm.literals(text) is not None) == valid, text


def test_masked_covers_the_union(spark):
    spans = "array<struct<entity_type:string,start:int,end:int>>"
    df = spark.createDataFrame([("abcdefghij", [("A", 2, 5), ("B", 2, 8), ("C", 4, 6)])], f"t string, s {spans}")
    m = df.select(jm.masked(F.col("t"), F.col("s")).alias("m")).first().m
    assert m.types == ["C", "B"] and not set("cdef") & set(m.masked)


def test_guard_prompts(spark):
    df = spark.createDataFrame([(1, "mail a@example.com"), (2, "clean"), (3, None)], "id int, prompt string")
    rows = {r.id: r for r in jm.guard_prompts(df, mode="block", options=MAILS).collect()}
    assert (rows[1].decision, rows[1].summary, rows[1].masked) == ("block", "EMAIL_ADDRESS ×1", "mail a@*********om")
    assert rows[2].decision is None and rows[3].decision is None


def test_custom_recognizers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"entity": "TICKET", "context": ["ticket"], "patterns": [{"regex": r"(?<!\w)TK-(\d{4})(?!\d)", "score": 0.5, "group": 1}]}, {"entity": "TWICE", "patterns": [{"regex": r"(\w\w)\1", "score": 0.3}]}]))
    own = custom.from_file(str(tmp_path / "r.json")) + [custom.recognizer("EVEN", [(0.2, r"\d+", 0)], validator=lambda t: t.cast("long") % 2 == 0)]
    df = spark.createDataFrame([("é ticket TK-1234, xTK-9999 abab",), (None,)], "text string")
    rows = analyze(df, options=Options(recognizers=own)).collect()
    assert [(s.entity_type, s.text, s.start, round(s.score, 2)) for s in rows[0].spans] == [("EVEN", "1234", 13, 1.0), ("TICKET", "1234", 13, 0.85), ("TWICE", "9999", 23, 0.3), ("TWICE", "abab", 28, 0.3)]
    assert rows[1].spans == []
    with pytest.raises(ValueError, match="no group"):
        custom.recognizer("X", [(0.5, "a", 1)])


def test_artifacts(spark):
    def backend():
        return lambda texts: [[("PER", m.start(), m.end(), 0.8) for m in re.finditer("ose|Anna", t)] + [("MISC", 0, 1, 0.9)] for t in texts]

    o = art.Settings(mapping={"PER": "PERSON"}, ignore=("MISC",), low=("PERSON",), low_factor=0.5, cut="lines", window=12, overlap=6)
    df = spark.createDataFrame([("é José and Anna\n---\nAnna",), (None,)], "text string")
    got = art.with_artifacts(df, backend, settings=o).withColumn("spans", art.artifact_spans(F.col("text"), F.col("artifacts"))).collect()
    assert [(s.entity_type, s.text, s.score) for s in got[0].spans] == [("PERSON", "José", 0.4), ("PERSON", "Anna", 0.4), ("PERSON", "Anna", 0.4)]
    assert got[1].spans == []

    def broken():
        def fail(texts):
            raise RuntimeError("no model")

        return fail

    assert art.with_artifacts(df, broken).first().artifacts == []


def test_windows_of_a_length_meet_the_model_together():
    """It sees rounded shapes only, and the artifacts are those without rounding."""
    r, shapes = random.Random(9), set()
    texts = ["".join(r.choice(["Anna ", "x ", "José, ", "\n", "word "]) for _ in range(r.randint(0, 40))) for _ in range(150)]

    def model(given):
        shapes.add((len(given), *sorted({len(w) for w in given})))
        return [[("PER", m.start(), m.end(), 0.5 + len(m[0]) / 10) for m in re.finditer("Anna|Jose|r *$", w)] for w in given]

    plain = art.Settings(cut="lines", window=40, overlap=12)
    want = art.found_in(texts, model, replace(plain, buckets=()))
    assert len(shapes) > 10 and any(want)
    shapes.clear()
    found = art.found_in(texts, model, replace(plain, buckets=(8, 24, 40)))
    names = lambda spans: [[s for s in x if s[3] > 0.85] for x in spans]
    assert names(found) == names(want) and shapes <= {(n, w) for n in (1, 2, 4, 8, 16, 32) for w in (8, 24, 40)} and len(shapes) > 2
    words = lambda t: ([m.span() for m in re.finditer("[^ ]+", t)], len(t.split(" ")) + 2)
    tokens = replace(plain, tokenizer=words, budget=12, buckets=(4, 12))
    assert names(art.found_in(texts, model, tokens)) == names(art.found_in(texts, model, replace(tokens, buckets=())))


def test_cutting_and_snapping():
    text = "a\tb\n\n--\nc"
    assert ["".join(text[a:b]) for a, b in art.segments(text, "fields")] == ["a\t", "b\n", "c"]
    assert art.windows(10, 4, 2) == [(0, 4), (2, 6), (4, 8), (6, 10)] and art.windows(3, 4, 2) == [(0, 3)]
    once = art.snapped("Bandar Seri", [("L", 1, 3, 0.5), ("L", 8, 9, 0.7)])
    assert once == [("L", 0, 6, 0.5), ("L", 7, 11, 0.7)] and art.snapped("Bandar Seri", once) == once
    assert art.snapped("x" * 500, [("L", 5, 9, 1.0)]) == [("L", 5, 9, 1.0)]
    assert art.merged([("P", 0, 5, 0.1), ("P", 0, 5, 0.9), ("P", 1, 3, 1.0), ("Q", 1, 3, 1.0)]) == [("P", 0, 5, 0.9), ("Q", 1, 3, 1.0)]


def test_corpus_and_reports(spark):
    docs = corpus.corpus(spark, 2, sizes={"100B": 100, "1KB": 1024})
    rows = docs.collect()
    assert len(rows) == 12 and {len(r.text) for r in rows} == {100, 1024} and rows == corpus.corpus(spark, 2, sizes={"100B": 100, "1KB": 1024}).collect()
    found = findings(docs.withColumnRenamed("id", "doc_id"), "doc_id", options=MAILS)
    assert found.filter(F.col("doc_id").contains("none")).count() == 0 and found.filter(F.col("doc_id").contains("dense")).count() > 0
    same = reports.agreement(found, found.filter("entity_type = 'CREDIT_CARD'")).collect()
    assert all(r.both == (r.a if r.entity_type == "CREDIT_CARD" else 0) for r in same)
    timed = spark.createDataFrame([("1KB", "none", 1000, float(x)) for x in range(1, 11)], "size_class string, density string, bytes long, us double")
    s = reports.group_stats(timed).first()
    assert (s.docs, s.mean_us, s.p50_us, s.p99_us) == (10, 5.5, 5.0, 9.0)
    assert reports.speed_table(spark.createDataFrame([("a", "1KB", "none", 2.0), ("b", "1KB", "none", 6.0)], "engine string, size_class string, density string, mean_us double"), "a", "b").first().speedup == 3.0
    empty = spark.createDataFrame([], "line int, entity_type string, value_masked string, score double")
    read = lambda df: json.loads("\n".join(r.line for r in reports.json_report(df).orderBy("place").collect()))
    assert read(empty) == {"findings": [], "total": 0}
    some = spark.createDataFrame([(2, "B", "x", 0.5), (1, "A", "x", 0.5), (1, "A", "x", 0.5), (None, "C", "y", 1.0)], empty.schema)
    assert read(some) == {"findings": [{"entity_type": "C", "value_masked": "y", "score": 1.0}, *[{"line": 1, "entity_type": "A", "value_masked": "x", "score": 0.5}] * 2, {"line": 2, "entity_type": "B", "value_masked": "x", "score": 0.5}], "total": 4}


def test_models(spark, tmp_path):
    import hashlib

    (tmp_path / "m" / "onnx").mkdir(parents=True)
    (tmp_path / "m" / "config.json").write_bytes(b"{}")
    (tmp_path / "m" / "onnx" / "model").write_bytes(b"weights")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = {"tiny": {"revision": "r1", "files": {"config.json": {"sha256": sha(b"{}"), "size": 2}, "onnx/model": {"sha256": sha(b"WEIGHTS"), "size": 7}, "gone": {"sha256": sha(b""), "size": 0}}}}
    got = {r.path: r.status for r in models.verify(spark, str(tmp_path / "m"), models.pins(spark, json.dumps(manifest)), "tiny").collect()}
    assert got == {"config.json": "ok", "onnx/model": "digest", "gone": "missing"}


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "a@example.com b@example.com"), ("2024-01-01 00:01:10", "c@example.com"), ("2024-01-01 00:01:20", None)], "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, options=MAILS).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2] == sorted(r.n for r in windowed_counts(df, options=MAILS).collect())


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("x\nmail jane@example.com\n")
    assert cli.main(["scan", "--entities", "EMAIL_ADDRESS", "--json", str(tmp_path / "a.txt")], spark) == 1
    assert json.loads(capsys.readouterr().out)["findings"][0]["line"] == 2
    (tmp_path / "allow").write_text("# known\n jane@example.com \n")
    assert cli.main(["scan", "--entities", "EMAIL_ADDRESS", "--allow-file", str(tmp_path / "allow"), str(tmp_path / "a.txt")], spark) == 0
    assert cli.main(["scan", str(tmp_path / "none")], spark) == 2 and cli.main(["version"], spark) == 0


def test_diff_of_all_documents(spark, tmp_path):
    from maskwright.plans import tools

    spark.createDataFrame([(k, "a\nbc") for k in range(25)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = tools.queries()["diff_all_added_lines"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_bytes) for r in rows) == [(k, 2, 3) for k in range(25)]
