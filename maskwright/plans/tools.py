"""Queries of the scanning, masking and reporting operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.regex import to_duckdb
from maskwright.operators import anonymize as anon
from maskwright.operators import reports
from maskwright.operators.analyze import Options, analyze, findings
from maskwright.operators.catalog import EMAIL, RECOGNIZERS
from maskwright.operators.diff import diff_lines, scan_diff
from maskwright.operators.json_masking import guard_prompts, mask_json
from maskwright.operators.scan import scan
from maskwright.plans.registry import spread
from maskwright.streaming.findings import windowed_counts

_MAILS = ["EMAIL_ADDRESS"]
_OPTIONS = Options(entities=_MAILS, context=False)
_RE2 = to_duckdb(EMAIL)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a diff that adds a file of its lines."""
    n = F.size(F.split("text", "\n"))
    head = F.concat(F.lit("diff --git a/x b/x\n--- /dev/null\n+++ b/docs/"), F.col("doc_id").cast("string"), F.lit(".txt\n@@ -0,0 +1,"), n.cast("string"), F.lit(" @@\n"))
    # not by ^ in a pattern: Java finds none in an empty text, and none after a line feed that ends the text
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.concat(head, F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+"))).alias("diff"))


def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the files of a glob."""
    return _added(diff_lines(document_diffs(spark, sf_dir), "doc_id", exclude=["docs/*1.txt"]))


def diff_all_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _added(diff_lines(document_diffs(spark, sf_dir), "doc_id"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "file").agg(F.max("line").alias("n_lines"), F.sum(F.octet_length("content")).alias("n_bytes"))


def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_diff(document_diffs(spark, sf_dir), "doc_id", options=_OPTIONS).groupBy("doc_id", "line", "value_masked").agg(F.count("*").alias("n"))


def scan_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", options=_OPTIONS).groupBy("doc_id", "line", "value_masked").agg(F.count("*").alias("n"))


def json_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    events = docs.select("doc_id", F.to_json(F.struct(F.struct(F.array("text").alias("lines"), F.col("text").alias("path")).alias("out"))).alias("json"))
    return mask_json(events, "doc_id", options=_OPTIONS).select("doc_id", "summary", F.sha2(F.get_json_object("json", "$.out.lines[0]"), 256).alias("lines_sha256"), F.sha2(F.get_json_object("json", "$.out.path"), 256).alias("path_sha256"))


def prompt_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = guard_prompts(_table(spark, sf_dir, "conversations", "role", "text"), "text", options=_OPTIONS)
    return asked.groupBy("role").agg(F.count("*").alias("n"), F.count("decision").alias("warned"))


def allow_list_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_counts(spark, sf_dir, Options(entities=["IP_ADDRESS"], context=False, allow=["10.0.0.1", "127.0.0.1"]))


def allow_list_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails whose name begins with other letters than these."""
    return _mail_counts(spark, sf_dir, Options(entities=_MAILS, context=False, allow_regex=["^[a-m]", r"\borg$"]))


def allow_list_invalid_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that don't compile count as texts."""
    return _mail_counts(spark, sf_dir, Options(entities=["IP_ADDRESS"], context=False, allow_regex=["10.0.0.1", "("]))


def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_counts(spark, sf_dir, Options(entities=["EMAIL_ADDRESS", "IP_ADDRESS"], context=False, threshold=0.55))


def _mail_counts(spark: SparkSession, sf_dir: str, options: Options) -> DataFrame:
    return findings(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", options=options).groupBy("doc_id", "entity_type", "text").agg(F.count("*").alias("n"))


def mails_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(_table(spark, sf_dir, "conversations", "role", "text"), options=_OPTIONS)
    return found.groupBy("role").agg(F.sum(F.size("spans")).alias("n"))


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return reports.agreement(findings(docs, "doc_id", options=_OPTIONS), findings(docs.filter("lang = 'en'"), "doc_id", options=_OPTIONS))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "text", "lang", "source", "n_chars")
    return reports.group_stats(docs.select(F.col("source").alias("size_class"), F.col("lang").alias("density"), F.octet_length("text").cast("long").alias("bytes"), F.col("n_chars").cast("double").alias("us")))


def mails_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "ts", "user_id").select("ts", F.format_string("from u%d@example.com", "user_id").alias("text"))
    return windowed_counts(events, window="1 hour", options=_OPTIONS).groupBy("entity_type", "n").agg(F.count("*").alias("hours"))


def _anonymized(operator: anon.Operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = analyze(_table(spark, sf_dir, "documents", "doc_id", "text"), options=_OPTIONS)
        return found.select("doc_id", F.sha2(anon.anonymize(F.col("text"), F.col("spans"), operator), 256).alias("masked_sha256"))

    return run


_OPERATORS = {
    "mask": (anon.mask("#"), "repeat('#', length(m[i]))"),
    "mask_keep_last": (anon.mask_keep_last("*", 4), "CASE WHEN length(m[i]) <= 4 THEN m[i] ELSE repeat('*', length(m[i]) - 4) || right(m[i], 4) END"),
    "hash": (anon.token(), "'EMAIL_ADDRESS_' || substr(sha256('EMAIL_ADDRESS|' || m[i]), 1, 8)"),
}

SHOWN = "CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE left(v, 2) || repeat('*', CAST(least(length(v) - 4, 12) AS INT)) || right(v, 2) END"


def queries() -> dict:
    plain = (diff_added_lines, diff_all_added_lines, diff_findings, scan_mails, json_masking, prompt_guard, allow_list_exact, allow_list_regex, allow_list_invalid_regex, threshold_filter, mails_by_role, parity, doc_stats, mails_by_hour)
    return {f.__name__: f for f in plain} | {f"anonymize_{k}": _anonymized(op) for k, (op, _) in _OPERATORS.items()}


def _ips(ip: list[str], test: str) -> str:
    return f"""
        WITH m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '{ip[0]}'), regexp_extract_all(text, '{ip[1]}'))) AS text FROM documents)
        SELECT doc_id, 'IP_ADDRESS' AS entity_type, text, count(*) AS n FROM m WHERE {test} GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    ip = [to_duckdb(p) for _, p, _ in next(r for r in RECOGNIZERS if r.entity == "IP_ADDRESS").patterns]
    mails = f"SELECT doc_id, lang, unnest(regexp_extract_all(text, '{_RE2}')) AS text FROM documents"
    lined = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents"
    by_line = f"""
        WITH l AS ({lined}), m AS (SELECT doc_id, line, unnest(regexp_extract_all(c, '{_RE2}')) AS v FROM l)
        SELECT doc_id, CAST(line AS INT) AS line, {SHOWN} AS value_masked, count(*) AS n FROM m GROUP BY ALL"""
    found = {
        "diff_added_lines": rf"""
        WITH l AS ({lined})
        SELECT doc_id, 'docs/' || doc_id || '.txt' AS file, CAST(max(line) AS INT) AS n_lines, CAST(sum(octet_length(encode(regexp_replace(c, '\r\z', '')))) AS BIGINT) AS n_bytes
        FROM l WHERE doc_id % 10 <> 1 GROUP BY doc_id""",
        "diff_all_added_lines": rf"""
        WITH l AS ({lined})
        SELECT doc_id, 'docs/' || doc_id || '.txt' AS file, CAST(max(line) AS INT) AS n_lines, CAST(sum(octet_length(encode(regexp_replace(c, '\r\z', '')))) AS BIGINT) AS n_bytes
        FROM l GROUP BY doc_id""",
        "diff_findings": by_line,
        "scan_mails": by_line,
        "json_masking": f"WITH p AS (SELECT doc_id, text, string_split_regex(text, '{_RE2}') AS a, regexp_extract_all(text, '{_RE2}') AS m FROM documents) SELECT doc_id, sha256(array_to_string([a[i] || CASE WHEN i <= len(m) THEN {SHOWN.replace('v', 'm[i]')} ELSE '' END FOR i IN range(1, len(a) + 1)], '')) AS lines_sha256, sha256(text) AS path_sha256, CASE WHEN len(regexp_extract_all(text, '{_RE2}')) > 0 THEN 'EMAIL_ADDRESS ×' || len(regexp_extract_all(text, '{_RE2}')) ELSE '' END AS summary FROM p",
        "prompt_guard": f"SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{_RE2}')) AS warned FROM conversations GROUP BY role",
        "allow_list_exact": _ips(ip, "text NOT IN ('10.0.0.1', '127.0.0.1')"),
        "allow_list_regex": f"WITH m AS ({mails}) SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, text, count(*) AS n FROM m WHERE NOT regexp_matches(text, '^[a-m]|\\borg$') GROUP BY doc_id, text",
        "threshold_filter": _ips(ip, "true"),
        "allow_list_invalid_regex": _ips(ip, "text NOT IN ('10.0.0.1', '(')"),
        "mails_by_role": f"SELECT role, CAST(sum(coalesce(len(regexp_extract_all(text, '{_RE2}')), 0)) AS BIGINT) AS n FROM conversations GROUP BY role",
        "parity": f"WITH m AS ({mails}) SELECT 'EMAIL_ADDRESS' AS entity_type, count(*) AS a, count(*) FILTER (WHERE lang = 'en') AS b, count(*) FILTER (WHERE lang = 'en') AS \"both\" FROM m HAVING count(*) > 0",
        "doc_stats": """
        SELECT source AS size_class, lang AS density, count(*) AS docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, avg(CAST(n_chars AS DOUBLE)) AS mean_us,
               CAST(list_sort(list(n_chars))[CAST(floor(0.5 * (count(*) - 1)) AS INT) + 1] AS DOUBLE) AS p50_us, CAST(list_sort(list(n_chars))[CAST(floor(0.99 * (count(*) - 1)) AS INT) + 1] AS DOUBLE) AS p99_us,
               sum(octet_length(encode(text))) / sum(CAST(n_chars AS DOUBLE)) AS mb_per_sec
        FROM documents GROUP BY source, lang""",
        "mails_by_hour": "WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY h) SELECT 'EMAIL_ADDRESS' AS entity_type, n, count(*) AS hours FROM h GROUP BY n",
    }
    for k, (_, put) in _OPERATORS.items():
        found[f"anonymize_{k}"] = f"""
        WITH p AS (SELECT doc_id, string_split_regex(text, '{_RE2}') AS a, regexp_extract_all(text, '{_RE2}') AS m FROM documents)
        SELECT doc_id, sha256(array_to_string([a[i] || CASE WHEN i <= len(m) THEN {put} ELSE '' END FOR i IN range(1, len(a) + 1)], '')) AS masked_sha256 FROM p"""
    return found
