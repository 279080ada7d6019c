"""Files and diffs of any size against the same read whole."""

import json
import random

import pytest

from maskwright import __main__ as cli
from maskwright.operators import diff, scan
from maskwright.sources import files

ROWS = ["diff --git a/x b/x", "--- a/x", "+++ b/x.py", "+++ b/skip.txt", "+++ /dev/null", "+++ y\r", "@@ -1,2 +3,4 @@", "@@ -1 +7 @@", "@@ -0,0 +1,9 @@ def f", "@@ x", "+a", "+b\r", " c", "-d", "", "\\ No newline", "+++ looks like a header", "+@@ -1 +1 @@", " diff --git"]


def diffs(n, seed):
    r = random.Random(seed)
    return ["\n".join(r.choices(ROWS, weights=[1, 1, 2, 1, 1, 1, 2, 1, 2, 1, *[4] * 4, 1, 1, 3, 1, 1], k=r.randint(0, 60))) + r.choice(["", "\n"]) for _ in range(n)]


def test_chunks_compose():
    """Any cut of a diff into chunks: the summaries' states are those of the rows read one after the other."""
    r, out, deep = random.Random(1), diff.exclusion(["skip.*"]), 0
    for text in diffs(3000, 2):
        rows, state, reader = text.split("\n"), [None, 0, 0], diff.Reader(out)
        while rows:
            n = r.randint(1, 12)
            state = diff.after(state, diff.summary_of(rows[:n], out))
            for row in rows[:n]:
                reader.read(row)
            rows = rows[n:]
            assert (state[0], state[2]) == (reader.file, max(reader.left, 0)) and (not state[2] or state[1] == reader.number), text
            deep += state[2] > 0
    assert deep > 1000


def added(texts, out=None):
    return sorted((k, *x) for k, t in texts for x in diff.added_lines(t or "", out))


@pytest.mark.parametrize("size", [20, 300])
def test_diffs_in_chunks(spark, size):
    texts = list(enumerate([None, "", "\n", *diffs(40, size), "\n".join(diffs(60, 7))]))
    texts += [texts[5], (5, texts[6][1])]
    df = spark.createDataFrame(texts, "id long, diff string").repartition(3)
    got = diff.chunked_diff_lines(diff.diff_chunks(df, "id", size=size), "id", exclude=["skip.*"])
    assert sorted(map(tuple, got.collect())) == added(texts, diff.exclusion(["skip.*"]))
    assert diff.chunked_diff_lines(diff.diff_chunks(df.limit(0), "id"), "id").collect() == []


def in_blocks(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    in_blocks(spark, 3000)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_diff_files(spark, small_blocks, tmp_path):
    texts = {f"{k}.diff": "\n".join(diffs(n, k)) for k, n in enumerate([1, 300, 40])}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    chunks = diff.file_chunks(spark, str(tmp_path), 500)
    assert chunks.select("block").distinct().count() > 5
    got = sorted((r.source.rpartition("/")[2], r.file, r.line, r.content) for r in diff.chunked_diff_lines(chunks).collect())
    assert got == added(texts.items()) and len(got) > 1000


def test_lines_of_files(spark, small_blocks, tmp_path):
    r = random.Random(3)
    texts = {f"{k} +.txt": "".join("é日 x"[: r.randint(0, 5)] * r.randint(0, 9) + r.choice(["\n", "\r\n", "\r", "\n\n"]) for _ in range(n)) + end for k, (n, end) in enumerate([(0, ""), (0, "x"), (2000, ""), (900, "no line feed at the end"), (1, "")])}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    found = files.file_lines(spark, str(tmp_path))
    assert files.file_rows(spark, str(tmp_path)).select("file", "block").distinct().count() > 8
    got = sorted((r.file.rpartition("/")[2].replace("%20", " "), r.line, r.content) for r in found.collect())
    assert got == sorted((name, k, row.removesuffix("\r")) for name, t in texts.items() for k, row in enumerate(t.removesuffix("\n").split("\n") if t else [], 1))


def test_a_line_that_is_too_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "MOST_BYTES", 100)
    (tmp_path / "a.txt").write_text("x" * 200)
    with pytest.raises(Exception, match="too long"):
        files.file_lines(spark, str(tmp_path)).collect()


def test_command_line_on_files(spark, small_blocks, tmp_path, capsys):
    """Files that Spark reads in blocks, names that it would take as patterns or pass over, and diffs."""
    for name, n in (("a [1] é+%.txt", 500), (".env", 3), ("_x", 1)):
        (tmp_path / name).write_text("".join(f"line {k}\n" for k in range(n)) + "mail j@x.com\r\n")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    assert cli.main(["scan", *paths], spark) == 1
    lines = capsys.readouterr().out.splitlines()
    assert lines == [f"{p}:{n}  EMAIL_ADDRESS  j@***om  0.85" for p, n in sorted(zip(paths, (4, 2, 501), strict=True))] + ["", "3 finding(s)"]
    assert cli.main(["scan", "--json", *paths, "--entities", "US_SSN"], spark) == 0 and json.loads(capsys.readouterr().out) == {"findings": [], "total": 0}
    (tmp_path / "d.diff").write_text("+++ b/f\n@@ -0,0 +1,900 @@\n" + "+x\n" * 899 + "+j@x.com\n+k@x.com\n")
    assert cli.main(["diff", "--json", str(tmp_path / "d.diff")], spark) == 1
    assert json.loads(capsys.readouterr().out) == {"findings": [{"file": "f", "line": 900, "entity_type": "EMAIL_ADDRESS", "value_masked": "j@***om", "score": 0.5}], "total": 1}
    assert cli.main(["scan", str(tmp_path / "none")], spark) == 2
