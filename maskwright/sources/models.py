"""Pinned model files: their expected digests as a table, and verification of folders against them. Nothing is downloaded."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PINS = "model string, revision string, path string, sha256 string, size long"


def pins(spark: SparkSession, manifest: str) -> DataFrame:
    """(model, revision, path, sha256, size) of a JSON manifest {model: {revision, files: {path: {sha256, size}}}}."""
    spec = json.loads(manifest)
    return spark.createDataFrame([(m, x.get("revision"), p, f["sha256"].lower(), int(f["size"])) for m, x in sorted(spec.items()) for p, f in sorted(x["files"].items())], PINS)


def verify(spark: SparkSession, folder: str, pinned: DataFrame, model: str) -> DataFrame:
    """(path, status) of each pinned file of the model: ok, missing, size or digest. A file whose size differs isn't hashed; one of 2 GB or more can't be read whole and so isn't ok."""
    root = folder.rstrip("/") + "/"
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.expr("substring_index(path, '/', -(size(split(p, '/'))))")
    wanted = pinned.filter(F.col("model") == model).select(F.col("path").alias("p"), "sha256", "size")
    # the manifest is a handful of rows
    met = meta.join(F.broadcast(wanted), F.col("path").endswith(F.concat(F.lit("/" + root.rstrip("/").rpartition("/")[2] + "/"), F.col("p"))) & (at == F.col("p")))
    good = met.select("p", F.when(F.col("length") != F.col("size"), "size").when(F.sha2("content", 256) != F.col("sha256"), "digest").otherwise("ok").alias("status"))
    return wanted.join(F.broadcast(good), "p", "left").select(F.col("p").alias("path"), F.coalesce("status", F.lit("missing")).alias("status"))


def digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a local file of any size, read in blocks."""
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            out.update(part)
    return out.hexdigest()


def verify_local(folder: str, manifest: str, model: str) -> list[tuple[str, str]]:
    """(path, status) of each pinned file of a model in a local folder: ok, missing, size or digest. Raises ValueError for a model that isn't pinned."""
    spec = json.loads(manifest)
    if model not in spec:
        raise ValueError(f"{model!r} has no pinned checksums, so it cannot be verified (pinned: {', '.join(sorted(spec))})")
    out = []
    for name, f in sorted(spec[model]["files"].items()):
        at = os.path.join(folder, name)
        status = "missing" if not os.path.isfile(at) else "size" if os.path.getsize(at) != int(f["size"]) else "ok" if digest(at) == f["sha256"].lower() else "digest"
        out.append((name, status))
    return out


def usable_offline(folder: str, manifest: str | None = None, model: str | None = None, onnx: str | None = None) -> None:
    """Raises ValueError unless a model can be loaded from the folder without a network: a pinned one by its digests, any other by readable config.json, tokenizer.json and one .onnx file (the named one, if given)."""
    if not os.path.isdir(folder):
        raise ValueError(f"offline: no model directory at {folder}")
    if manifest and model in json.loads(manifest):
        if bad := [f"{p} ({s})" for p, s in verify_local(folder, manifest, model) if s != "ok"]:
            raise ValueError(f"offline: {', '.join(bad)} in {folder}")
        return
    found = [os.path.join(d, n) for d, _, names in os.walk(folder) for n in sorted(names) if n.endswith(".onnx") and (onnx is None or n == os.path.basename(onnx))]
    if not found:
        raise ValueError(f"offline: {onnx} is missing from {folder}" if onnx else f"offline: no .onnx file in {folder}")
    for at in (*(os.path.join(folder, n) for n in ("config.json", "tokenizer.json")), found[0]):
        try:
            with open(at, "rb") as f:
                f.read(1)
        except FileNotFoundError:
            raise ValueError(f"offline: {os.path.basename(at)} is missing from {folder}") from None
        except OSError as e:
            raise ValueError(f"offline: cannot read {at}: {e.strerror}") from None
