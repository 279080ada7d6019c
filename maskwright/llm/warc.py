"""WARC archives: a writer that splits long records into segments, and a reader that puts them together again.

The writer's archives are gzip files of the text sink, with the WARC record
separator as line end. The reader takes whole archive files, so files should
stay far below an executor's memory; `records_per_file` bounds the writer's.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import configure, mapped, new_path

#: Bytes of a record's block before it is continued in a further segment, and of a chunk of its transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 65_536, 8_192
#: Payloads from this length on are stored once; later equals refer to them.
DEDUP_BYTES = 1_000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
_RECORD = "rid long, target string, type string, refers string, digest string, length long, origin string, segment int, total long, block binary"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + END


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if framed[at : at + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(framed[end + 2 : at])
        at += 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))) for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def record(key: str, url: str | None, payload: bytes | None, digest: str, length: int, refers: str | None, segment_bytes: int) -> list[bytes]:
    """The WARC records (segments) of a page; payload None makes a revisit record."""
    block = HTTP + chunked(payload) if payload is not None else HTTP
    about = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", length)]
    if payload is None:
        about += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_header([*about, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block]
    out = [_header([*about, ("WARC-Segment-Number", 1), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(parts[0]))]) + parts[0]]
    for n, p in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        out.append(_header([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{n}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<urn:page:{key}>"), ("WARC-Segment-Number", n), *last, ("Content-Length", len(p))]) + p)
    return out


def plan_revisits(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """Adds payload (UTF-8; null: empty), digest, length and keeper: the largest page_id of an equal payload of at least dedup_bytes, null if no other page has it."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    # 'length' takes part in the join so that both sides are dealt out anew, and adaptive execution can split the rows of a payload that many pages have
    same = p.filter(F.col("length") >= dedup_bytes).groupBy("digest").agg(F.max("length").alias("length"), F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return p.join(same, ["digest", "length"], "left")


def write_archives(pages: DataFrame, path: str, dedup_bytes: int = DEDUP_BYTES, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = 8_192) -> None:
    """Writes one WARC record per row of pages (page_id, url, html) as gzip archives under path.

    Null html is an empty payload, a null url leaves out the target; a null page_id makes a record without id. Repeated rows get records of their own. Blocks over segment_bytes go on in continuation records.
    """
    configure(pages.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                page = "" if r["page_id"] is None else r["page_id"]
                revisit = r["keeper"] is not None and r["keeper"] != r["page_id"]
                out += record(f"{page}.{r['row']}", r["url"], None if revisit else r["payload"], r["digest"], r["length"], f"<urn:page:{r['keeper']}>" if revisit else None, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = plan_revisits(pages, dedup_bytes).withColumn("row", F.monotonically_increasing_id())
    lines = mapped(rows, run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(archive: bytes):
    """Yields (fields, block) of each record of an archive, gzip or plain."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        fields = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = f.read(size := int(fields["content-length"]))
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def _number(uri: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)", uri or "")
    return int(m[1]) if m else None


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, continuation records apart."""
    configure(spark)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_buffer().to_pybytes()):
                    own, origin = h.get("warc-record-id"), h.get("warc-segment-origin-id")
                    whole = "warc-segment-number" not in h
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = int(h["warc-payload-length"]) if "warc-payload-length" in h else None
                    if whole and h["warc-type"] == "response":
                        digest, length, block = *measured(block), b""
                    rows.append((_number(origin or own), h.get("warc-target-uri"), h["warc-type"], h.get("warc-refers-to"), digest, length, None if whole else origin or own, int(h.get("warc-segment-number", 1)), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
                    size += len(block)
                    if len(rows) >= 1000 or size > 1 << 24:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return mapped(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), run, _RECORD)


_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[x.split()[1]]) for c, x in zip(cols, _RECORD.split(", "), strict=True)], names=_NAMES)


def measured(block: bytes) -> tuple[str, int]:
    """SHA-1 and length of the payload of an HTTP response, chunked or not."""
    head, _, body = block.partition(END)
    payload = dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body
    return hashlib.sha1(payload).hexdigest(), len(payload)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per response of several segments: (rid, type, refers, digest, length).

    Segments are grouped by origin and joined in the order of their numbers; a gap, or a total that differs from WARC-Segment-Total-Length, fails the read. Segments met twice count once.
    """
    groups = segments.filter("origin is not null").groupBy("origin").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "rid", "type", "refers", "block"))).alias("parts"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                parts = list({p["segment"]: p for p in r["parts"]}.values())
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"{r['origin']}: a segment is missing")
                block = b"".join(p["block"] for p in parts)
                if r["total"] != len(block):
                    raise ValueError(f"{r['origin']}: {len(block)} bytes, {r['total']} expected")
                out.append((parts[0]["rid"], parts[0]["type"], parts[0]["refers"], *measured(block)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["rid", "type", "refers", "digest", "length"])

    return mapped(groups, run, "rid long, type string, refers string, digest string, length long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. Records in one piece bypass the grouping of segments."""
    seen = read_segments(spark, path)
    kept = seen.filter("origin is null").select("rid", "type", "refers", "digest", "length").unionByName(reassemble(seen))
    return kept.select(
        F.col("rid").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.regexp_extract("refers", r"<urn:page:(-?\d+)", 1).try_cast("long").alias("refers_to"),
    )


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages as archives (under path, by default a new folder of the shared one) and reads them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
