"""Queries of the operators for texts, files and diffs of any size and for patterns of one's own, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.regex import to_duckdb
from maskwright.operators import anonymize as anon
from maskwright.operators.analyze import Options, analyze, findings, rows_of
from maskwright.operators.catalog import EMAIL, RECOGNIZERS, Recognizer
from maskwright.operators.custom import recognizer
from maskwright.operators.diff import chunked_diff_lines, diff_chunks, file_chunks
from maskwright.operators.json_masking import mask_json
from maskwright.operators.overlaps import overlapping
from maskwright.operators.pieces import findings_in_pieces
from maskwright.operators.reports import json_report, quantiles
from maskwright.operators.scan import scan, scan_lines
from maskwright.plans import sql, tools, vectors
from maskwright.plans.registry import spread
from maskwright.plans.tools import SHOWN, document_diffs
from maskwright.sources.files import file_lines
from maskwright.sources.shared import shared_path

_MAILS = Options(entities=["EMAIL_ADDRESS"], context=False)

#: Patterns of one's own, each with its span in a group, and context words.
OWN = [
    recognizer("MAIL_DOMAIN", [(0.4, r"@([a-z0-9]+)\.[a-z]{2,}\b", 1)], ["mail", "email", "contact"]),
    recognizer("SUBNET", [(0.3, r"\b\d{1,3}\.(\d{1,3}\.\d{1,3})\.\d{1,3}\b", 1), (0.2, r"\b(\d{1,3})\.\d{1,3}\b", 1)], ["ip", "address", "server"]),
    recognizer("WORD_PAIR", [(0.1, r"(?i)\bthe ([a-z]{9,12})\b", 1)]),
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def findings_of_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in the documents, those of more than 2,000 bytes analyzed in pieces."""
    return findings_in_pieces(_docs(spark, sf_dir), "doc_id", size=2000).withColumn("score", F.round("score", 4))


def custom_recognizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_docs(spark, sf_dir), "doc_id", options=Options(recognizers=OWN)).withColumn("score", F.round("score", 4))


#: Documents whose texts make up a file.
PER_FILE = 200


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Writes the texts of (doc_id, text) one after the other by id, PER_FILE ids to a file, and gives the folder; the files' paths hold part=<number>."""
    path = shared_path(spark, name)
    numbered = rows.select(F.floor(F.col("doc_id") / PER_FILE).alias("part"), "doc_id", "text").repartition("part").sortWithinPartitions("part", "doc_id")
    numbered.select("part", "text").write.partitionBy("part").text(path)
    return path


def _part() -> Column:
    return F.regexp_extract("file", r"part=(\d+)", 1).cast("long")


def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, their last number and bytes of files that hold the documents."""
    found = file_lines(spark, _written(spark, _docs(spark, sf_dir), "text-files"))
    return found.groupBy(_part().alias("part")).agg(F.count("*").alias("n_lines"), F.max("line").alias("last_line"), F.sum(F.octet_length("content")).alias("n_bytes"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses by line in files that hold the documents."""
    found = scan_lines(file_lines(spark, _written(spark, _docs(spark, sf_dir), "text-files")), "file", options=_MAILS)
    return found.groupBy(_part().alias("part"), "line", "value_masked").agg(F.count("*").alias("n"))


def _added(rows: DataFrame, doc_id: Column) -> DataFrame:
    return rows.groupBy(doc_id.alias("doc_id"), "file").agg(F.max("line").cast("int").alias("n_lines"), F.sum(F.octet_length("content")).alias("n_bytes"))


def diff_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What diff_added_lines gives, each diff read in chunks of 500 bytes."""
    return _added(chunked_diff_lines(diff_chunks(document_diffs(spark, sf_dir), "doc_id", size=500), "doc_id", exclude=["docs/*1.txt"]), F.col("doc_id"))


def diff_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What diff_all_added_lines gives, from diff files that hold many documents each, read in chunks."""
    path = _written(spark, document_diffs(spark, sf_dir).select("doc_id", F.col("diff").alias("text")), "diff-files")
    return _added(chunked_diff_lines(file_chunks(spark, path, 10_000)), F.regexp_extract("file", r"docs/(-?\d+)", 1).cast("long"))


def json_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole masked JSON values, findings of all types: each document in a list and under a key of paths, among numbers that no double holds, a repeated key and white space."""
    literal = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    value = F.concat(F.lit('{"out" : {"lines": ['), literal, F.lit('], "path":'), literal, F.lit('}, "n": 1e400, "n": -0.50 }'))
    docs = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", value.alias("json"))
    return mask_json(docs, "doc_id").select("doc_id", "summary", F.sha2("json", 256).alias("json_sha256"))


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _docs(spark, sf_dir).unionByName(spark.createDataFrame(vectors.rows(), "doc_id long, text string"))
    return analyze(both)


def anonymize_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with findings of all types replaced, operators by type; where findings overlap the better one keeps its place and the others what is left of theirs."""
    by_type = {"EMAIL_ADDRESS": anon.mask_keep_last("*", 4), "IP_ADDRESS": anon.token(), "US_BANK_NUMBER": anon.mask("#"), "DATE_TIME": anon.redact(), "URL": anon.replace_with("[link]"), "PHONE_NUMBER": None}
    return _analyzed(spark, sf_dir).select("doc_id", F.sha2(anon.anonymize(F.col("text"), F.col("spans"), by_entity=by_type), 256).alias("masked_sha256"))


def overlapping_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of types that claim the same bytes: how often, and how many bytes."""
    found = rows_of(_analyzed(spark, sf_dir), "doc_id").select("doc_id", "s.entity_type", "s.start", "s.end")
    pairs = overlapping(found, found).filter("a.entity_type < b.entity_type")
    return pairs.groupBy(F.col("a.entity_type").alias("one"), F.col("b.entity_type").alias("other")).agg(F.count("*").alias("n"), F.sum("shared").cast("long").alias("shared"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the JSON report on mail addresses, and how often each stands in it."""
    found = scan(_docs(spark, sf_dir), "doc_id", options=_MAILS).select(F.pmod("doc_id", F.lit(3)).alias("line"), "entity_type", "value_masked", "score")
    return json_report(found).groupBy("place.part", F.col("line").alias("json")).agg(F.count("*").alias("n"))


def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the documents' sizes by language."""
    sized = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.octet_length("text").alias("size"))
    return quantiles(sized, ["lang"], "size", {"least": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p999": 0.999, "most": 1.0})


def queries() -> dict:
    return {f.__name__: f for f in (report_lines, length_quantiles, anonymize_all_types, overlapping_types, json_all_types, findings_of_pieces, custom_recognizers, lines_of_files, scan_files, diff_chunk_lines, diff_file_lines)}


_ALL: list[tuple[int, Recognizer]] = list(enumerate(RECOGNIZERS))


def _rounded(query: str) -> str:
    return f'SELECT doc_id, entity_type, start, "end", round(score, 4) AS score, text, recognizer FROM ({query})'


def oracle_sql() -> dict[str, str]:
    docs = "SELECT doc_id, text FROM documents"
    split = "string_split(coalesce(text, ''), chr(10))"
    lined = rf"""
        WITH s AS (SELECT doc_id, unnest({split}) AS c, generate_subscripts({split}, 1) AS i FROM documents),
        l AS (SELECT doc_id // {PER_FILE} AS part, row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id, i) AS line, regexp_replace(c, '\r\z', '') AS c FROM s)"""
    both = sql.with_vectors()
    place = lambda p, name: f"CAST(s[CAST(floor({p}::DOUBLE * (len(s) - 1)) AS INT) + 1] AS DOUBLE) AS {name}"
    mail_lines = f"SELECT doc_id % 3 AS line, unnest(regexp_extract_all(c, '{to_duckdb(EMAIL)}')) AS v FROM (SELECT doc_id, unnest({split}) AS c FROM documents)"
    return {
        "report_lines": f"""
        WITH m AS ({mail_lines}), j AS (SELECT '{{"line":' || line || ',"entity_type":"EMAIL_ADDRESS","value_masked":"' || {SHOWN} || '","score":0.5}}' AS json, line, {SHOWN} AS shown FROM m),
        n AS (SELECT *, row_number() OVER (ORDER BY line, shown) AS nth FROM j)
        SELECT 1 AS part, CASE WHEN nth > 1 THEN ',' ELSE '' END || json AS json, count(*) AS n FROM n GROUP BY ALL
        UNION ALL SELECT 0, '{{"findings": [', 1 UNION ALL SELECT 2, '], "total": ' || (SELECT count(*) FROM m) || '}}', 1""",
        "length_quantiles": "SELECT lang, " + ", ".join(place(p, n) for n, p in (("least", 0.0), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p999", 0.999), ("most", 1.0))) + " FROM (SELECT lang, list_sort(list(octet_length(encode(text)))) AS s FROM documents WHERE text IS NOT NULL GROUP BY lang)",
        "anonymize_all_types": f"""
        WITH d AS ({both}), f AS ({sql.spans(both, ["doc_id"], _ALL)}),
        o AS (SELECT doc_id, entity_type, start, "end" AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY f.score DESC, "end" - start DESC, start, entity_type) AS nth FROM f),
        c AS (SELECT doc_id, start AS spot FROM o UNION SELECT doc_id, stop FROM o),
        e AS (SELECT doc_id, spot, lead(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS until FROM c),
        w AS (SELECT e.doc_id, spot, until, min(nth) AS nth FROM e JOIN o ON o.doc_id = e.doc_id AND o.start <= spot AND o.stop >= until GROUP BY ALL),
        g AS (SELECT *, CASE WHEN lag(nth) OVER x = nth AND lag(until) OVER x = spot THEN 0 ELSE 1 END AS fresh FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY spot)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY spot) AS piece FROM g),
        p AS (SELECT r.doc_id, piece, any_value(entity_type) AS t, min(spot) AS a, max(until) AS b FROM r JOIN o ON o.doc_id = r.doc_id AND o.nth = r.nth GROUP BY r.doc_id, piece),
        v AS (SELECT p.*, encode(text) AS raw, coalesce(lag(b) OVER (PARTITION BY p.doc_id ORDER BY a), 0) AS since FROM p JOIN d ON d.doc_id = p.doc_id),
        s AS (SELECT *, decode(raw[since + 1 : a]) AS gap, decode(raw[a + 1 : b]) AS v FROM v),
        m AS (SELECT doc_id, string_agg(gap || CASE t WHEN 'EMAIL_ADDRESS' THEN CASE WHEN length(v) <= 4 THEN v ELSE repeat('*', length(v) - 4) || right(v, 4) END WHEN 'IP_ADDRESS' THEN t || '_' || substr(sha256(t || '|' || v), 1, 8)
            WHEN 'US_BANK_NUMBER' THEN repeat('#', length(v)) WHEN 'DATE_TIME' THEN '' WHEN 'URL' THEN '[link]' ELSE '<' || t || '>' END, '' ORDER BY a) || decode(any_value(raw)[max(b) + 1 :]) AS masked FROM s GROUP BY doc_id)
        SELECT d.doc_id, sha256(coalesce(masked, text)) AS masked_sha256 FROM d LEFT JOIN m ON m.doc_id = d.doc_id""",
        "overlapping_types": f"""
        WITH f AS ({sql.spans(both, ["doc_id"], _ALL)})
        SELECT a.entity_type AS one, b.entity_type AS other, count(*) AS n, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS shared
        FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end" AND a.entity_type < b.entity_type GROUP BY ALL""",
        "json_all_types": f"""
        WITH f AS ({sql.spans(docs, ["doc_id"], _ALL)}),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY "end" DESC, entity_type) AS nth FROM f WHERE score >= 0.5 AND entity_type NOT IN ('DATE_TIME', 'URL')),
        e AS (SELECT doc_id, entity_type, start, least("end", coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), "end")) AS stop FROM k WHERE nth = 1),
        p AS (SELECT e.*, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since, encode(text) AS raw FROM e JOIN documents USING (doc_id)),
        v AS (SELECT *, decode(raw[since + 1 : start]) AS gap, decode(raw[start + 1 : stop]) AS v FROM p),
        m AS (SELECT doc_id, string_agg(gap || {SHOWN}, '' ORDER BY start) || decode(any_value(raw)[max(stop) + 1 :]) AS masked FROM v GROUP BY doc_id),
        c AS (SELECT doc_id, string_agg(entity_type || ' ×' || n, ', ' ORDER BY n DESC, entity_type) AS summary FROM (SELECT doc_id, entity_type, count(*) AS n FROM v GROUP BY ALL) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(c.summary, '') AS summary, sha256('{{"out" : {{"lines": [' || CAST(to_json(coalesce(m.masked, d.text)) AS VARCHAR) || '], "path":' || CAST(to_json(d.text) AS VARCHAR) || '}}, "n": 1e400, "n": -0.50 }}') AS json_sha256
        FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id) WHERE d.text IS NOT NULL""",
        "findings_of_pieces": _rounded(sql.spans(docs, ["doc_id"], _ALL)),
        "custom_recognizers": _rounded(sql.spans(docs, ["doc_id"], list(enumerate(OWN)))),
        "lines_of_files": f"{lined} SELECT part, count(*) AS n_lines, max(line) AS last_line, CAST(sum(octet_length(encode(c))) AS BIGINT) AS n_bytes FROM l GROUP BY part",
        "scan_files": f"{lined}, m AS (SELECT part, line, unnest(regexp_extract_all(c, '{to_duckdb(EMAIL)}')) AS v FROM l) SELECT part, line, {SHOWN} AS value_masked, count(*) AS n FROM m GROUP BY ALL",
        "diff_chunk_lines": tools.oracle_sql()["diff_added_lines"],
        "diff_file_lines": tools.oracle_sql()["diff_all_added_lines"],
    }
