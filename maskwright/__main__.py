"""python -m maskwright scan|diff|prompt|hook|models|entities|version: exit code 0 if nothing was found, 1 if something was, 2 on errors."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import maskwright
from maskwright.operators.analyze import Options
from maskwright.operators.catalog import supported_entities
from maskwright.operators.diff import chunked_diff_lines, file_chunks, scan_diff
from maskwright.operators.hooks import answer
from maskwright.operators.json_masking import guard_prompts
from maskwright.operators.scan import scan, scan_lines
from maskwright.sources.files import file_lines
from maskwright.sources.models import verify_local


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("maskwright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "diff", "prompt"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="*", help="files (default: standard input)")
        c.add_argument("--threshold", type=float, default=0.5 if name == "prompt" else 0.4)
        c.add_argument("--ignore", default="DATE_TIME,URL")
        c.add_argument("--entities", default="")
        c.add_argument("--allow-file")
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--json", action="store_true")
        c.add_argument("--no-context", action="store_true")
        c.add_argument("--mode", choices=["warn", "block"], default="warn")
    h = sub.add_parser("hook")
    h.add_argument("event", choices=["post", "prompt"])
    h.add_argument("--threshold", type=float, default=0.5)
    h.add_argument("--ignore", default="DATE_TIME,URL,IP_ADDRESS")
    h.add_argument("--entities", default="")
    h.add_argument("--no-context", action="store_true")
    h.add_argument("--mode", choices=["warn", "block"], default="warn")
    h.add_argument("--skip-tools", default="Read")
    h.add_argument("--chain", default="")
    m = sub.add_parser("models")
    m.add_argument("action", choices=["pins", "verify"])
    m.add_argument("manifest", help="JSON file of pinned models")
    m.add_argument("--model")
    m.add_argument("--folder")
    sub.add_parser("entities")
    sub.add_parser("version")
    return p


def allow_list(path: str) -> list[str]:
    """The values of a file, one a line, without blank lines and those that begin with #."""
    with open(path, encoding="utf-8") as f:
        return [x for line in f if (x := line.strip()) and not x.startswith("#")]


def _text(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


def _by_spark(path: str) -> bool:
    """Whether Spark reads the file; it passes over names that begin like those of its own files. Raises OSError if it can't be read."""
    open(path, "rb").close()
    return not Path(path).name.startswith((".", "_"))


def _named(found: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """The files' addresses as the paths that were given."""
    spark = found.sparkSession
    address = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(p).resolve()}").toUri().toString()
    given = spark.createDataFrame([(re.sub("^file:/+", "/", address(p)), p) for p in dict.fromkeys(paths)], "_at string, _path string")
    at = F.regexp_replace(column, "^file:/+", "/")
    return found.join(given, at == F.col("_at"), "left").withColumn(column, F.coalesce("_path", column)).drop("_at", "_path")


def _found(spark: SparkSession, a: argparse.Namespace, options: Options, ignore: tuple[str, ...]) -> DataFrame:
    """(file, line, entity_type, value_masked, score) of the files, which are read in parallel, and of what only the driver reads: standard input, and files that Spark passes over."""
    paths = [p for p in a.paths if _by_spark(p)]
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", str(Path(p).resolve())) for p in dict.fromkeys(paths)]
    rest = spark.createDataFrame([(p, _text(p)) for p in a.paths if p not in paths] or ([] if paths else [(None, sys.stdin.read())]), "file string, text string")
    if a.command == "diff":
        found = scan_diff(rest.withColumnRenamed("file", "source"), "source", "text", options, ignore, a.exclude).drop("source")
        return found.unionByName(scan_lines(chunked_diff_lines(file_chunks(spark, escaped), exclude=a.exclude), "file", options=options, ignore=ignore)) if paths else found
    found = scan(rest, "file", "text", options, ignore)
    return found.unionByName(_named(scan_lines(file_lines(spark, escaped), "file", options=options, ignore=ignore), "file", paths)) if paths else found


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    options = Options(entities=[x for x in a.entities.split(",") if x] or None, threshold=a.threshold, allow=allow_list(a.allow_file) if a.allow_file else [], context=not a.no_context)
    ignore = tuple(x for x in a.ignore.split(",") if x)
    if a.command == "prompt":
        df = spark.createDataFrame([(_text(p),) for p in a.paths] or [(sys.stdin.read(),)], "text string")
        rows = guard_prompts(df, "text", a.mode, options, ignore).filter("decision is not null").select("decision", "summary", "masked").collect()
        for r in rows:
            print(json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False))
        return int(bool(rows))
    found, n = _found(spark, a, options, ignore).orderBy("file", "line", F.desc("score")), 0
    if a.json:
        print('{"findings": [', end="")
    for n, r in enumerate(found.toLocalIterator(), 1):  # noqa: B007
        if a.json:
            print(", " * (n > 1) + json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False), end="")
        else:
            print(f"{r.file}:{r.line}" if r.file else f"line {r.line}", r.entity_type, r.value_masked, f"{r.score:.2f}", sep="  ")
    if a.json:
        print(f'], "total": {n}}}')
    elif n:
        print(f"\n{n} finding(s)")
    return int(n > 0)


def _models(a: argparse.Namespace) -> int:
    """pins: the manifest's files with their digests; verify: the status of a model's files, 1 if one isn't as pinned."""
    with open(a.manifest, encoding="utf-8") as f:
        manifest = f.read()
    if a.action == "pins":
        for model, spec in sorted(json.loads(manifest).items()):
            for path, x in sorted(spec["files"].items()):
                print(model, spec.get("revision", "-"), path, x["sha256"].lower(), x["size"], sep="  ")
        return 0
    if not a.model or not a.folder:
        raise ValueError("models verify needs --model and --folder")
    found = verify_local(a.folder, manifest, a.model)
    for path, status in found:
        print(path, status, sep="  ")
    return int(any(s != "ok" for _, s in found))


def _hook(a: argparse.Namespace, spark) -> int:
    """Answers the event on standard input; always 0, as an error would break the caller's session."""
    split = lambda x: tuple(y for y in x.split(",") if y)
    options = Options(entities=list(split(a.entities)) or None, threshold=a.threshold, context=not a.no_context)
    more = {"mode": a.mode} if a.event == "prompt" else {"skip_tools": split(a.skip_tools), "chain": a.chain}
    out = answer(spark, a.event, getattr(sys.stdin, "buffer", sys.stdin), options=options, ignore=split(a.ignore), **more)
    if out:
        print(out.rstrip("\n"))
    return 0


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        a = _parser().parse_args(args)
        if a.command == "version":
            print(getattr(maskwright, "__version__", "0.1.0"))
            return 0
        if a.command == "entities":
            print(*supported_entities(), sep="\n")
            return 0
        if a.command == "models":
            return _models(a)
        if spark is None:
            spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        return _hook(a, spark) if a.command == "hook" else run(spark, a)
    except (OSError, ValueError, KeyError) as e:
        print(f"maskwright: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
