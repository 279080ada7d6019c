"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.regex import to_duckdb
from maskwright.operators import anonymize as anon
from maskwright.operators.analyze import Options, analyze, findings
from maskwright.operators.catalog import EMAIL, RECOGNIZERS
from maskwright.operators.catalog import supported_entities as catalog_entities
from maskwright.operators.engine import Engine
from maskwright.operators.scan import lines, scan, summary
from maskwright.plans import sql, vectors


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows to all cores where a table is a few files, which few tasks would read; larger tables are left as they are stored."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the texts with test values."""
    return _docs(spark, sf_dir).unionByName(spark.createDataFrame(vectors.rows(), "doc_id long, text string"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_counts(spark, sf_dir)


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every type over all documents."""
    return summary(findings(_docs(spark, sf_dir), "doc_id"))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every recognizer in the documents and the test values, context words included."""
    return findings(_with_vectors(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 4))


def no_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_with_vectors(spark, sf_dir), "doc_id", options=Options(context=False)).withColumn("score", F.round("score", 4))


def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by recognizer and score, with context words and without."""
    both = all_findings(spark, sf_dir).withColumn("context", F.lit(True)).unionByName(no_context(spark, sf_dir).withColumn("context", F.lit(False)))
    return both.groupBy("recognizer", "score", "context").agg(F.count("*").alias("n"))


def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each span in its text's result."""
    found = analyze(_with_vectors(spark, sf_dir)).select("doc_id", F.posexplode_outer("spans").alias("place", "s")).filter("s is not null")
    return found.select("doc_id", "place", "s.entity_type", "s.start", "s.end")


def supported_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that an engine for English and French knows in the language of each document, with the number of documents; null for languages without recognizers."""
    e = Engine("en", "fr")
    known = spark.createDataFrame([(language, t) for language in e.languages() for t in e.supported_entities(language)], "lang string, entity_type string")
    spoken = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n_docs"))
    return spoken.join(F.broadcast(known), "lang", "left").select("lang", "entity_type", "n_docs")


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_docs(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 4))


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_docs(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.max("line").alias("n_lines"), F.sum(F.octet_length("content")).alias("n_bytes"))


def anonymize_email(operator: anon.Operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = analyze(_docs(spark, sf_dir), options=Options(entities=["EMAIL_ADDRESS"]))
        return found.select("doc_id", F.sha2(anon.anonymize(F.col("text"), F.col("spans"), operator), 256).alias("masked_sha256"))

    return run


def credit_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_docs(spark, sf_dir), "doc_id", options=Options(entities=["CREDIT_CARD"])).groupBy("doc_id", "text", "score").agg(F.count("*").alias("n"))


def detect(entity: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return findings(_with_vectors(spark, sf_dir), "doc_id", options=Options(entities=[entity])).withColumn("score", F.round("score", 4))

    run.__doc__ = f"All {entity} in the documents and the test values."
    return run


_ALL = list(enumerate(RECOGNIZERS))


def queries() -> dict:
    found = {f.__name__: f for f in (entity_counts, all_findings, no_context, context_boost, result_order, supported_entities, scan_report, scan_lines, credit_cards)}
    found |= {"anonymize_replace": anonymize_email(anon.replace()), "anonymize_redact": anonymize_email(anon.redact()), "anonymize_replace_with": anonymize_email(anon.replace_with("[mail]"))}
    return found | {f"detect_{e.lower()}": detect(e) for e in catalog_entities()}


def _rounded(query: str) -> str:
    return f'SELECT doc_id, entity_type, start, "end", round(score, 4) AS score, text, recognizer FROM ({query})'


def oracle_sql() -> dict[str, str]:
    found = {f"detect_{e.lower()}": _rounded(sql.spans(sql.with_vectors(), ["doc_id"], [(i, r) for i, r in _ALL if r.entity == e])) for e in catalog_entities()}
    every = lambda context: _rounded(sql.spans(sql.with_vectors(), ["doc_id"], _ALL, context))
    found["all_findings"], found["no_context"] = every(True), every(False)
    found["context_boost"] = f"SELECT recognizer, score, context, count(*) AS n FROM (SELECT *, true AS context FROM ({every(True)}) UNION ALL SELECT *, false FROM ({every(False)})) GROUP BY ALL"
    found["entity_counts"] = f"SELECT entity_type, count(*) AS n FROM ({sql.spans('SELECT doc_id, text FROM documents', ['doc_id'], _ALL)}) GROUP BY entity_type"
    order = ", ".join(f"('{r.name}', {i})" for i, r in _ALL)
    found["result_order"] = f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f.score DESC, start, "end" DESC, o.n) - 1 AS INT) AS place, entity_type, start, "end"
        FROM ({sql.spans(sql.with_vectors(), ['doc_id'], _ALL)}) f JOIN (VALUES {order}) o(name, n) ON o.name = f.recognizer"""
    types = ", ".join(f"('{x}', '{e}')" for x in ("en", "fr") for e in sorted({r.entity for r in RECOGNIZERS}))
    found["supported_entities"] = f"SELECT d.lang, e.entity_type, d.n_docs FROM (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang) d LEFT JOIN (VALUES {types}) e(lang, entity_type) ON e.lang = d.lang"
    lined = r"SELECT doc_id, CAST(line AS INT) AS line, regexp_replace(c, '\r\z', '') AS text FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS c, generate_subscripts(string_split(regexp_replace(text, '\n\z', ''), chr(10)), 1) AS line FROM documents WHERE text <> '')"
    shown = "CASE WHEN length(text) <= 4 THEN repeat('*', length(text)) ELSE left(text, 2) || repeat('*', CAST(least(length(text) - 4, 12) AS INT)) || right(text, 2) END"
    found["scan_report"] = f"SELECT doc_id, line, entity_type, {shown} AS value_masked, round(score, 4) AS score FROM ({sql.spans(lined, ['doc_id', 'line'], _ALL)}) WHERE score >= 0.4 AND entity_type NOT IN ('DATE_TIME', 'URL')"
    for name, put in (("replace", "<EMAIL_ADDRESS>"), ("redact", ""), ("replace_with", "[mail]")):
        found[f"anonymize_{name}"] = f"SELECT doc_id, sha256(regexp_replace(text, '{to_duckdb(EMAIL)}', '{put}', 'g')) AS masked_sha256 FROM documents"
    card = next(r for r in RECOGNIZERS if r.entity == "CREDIT_CARD").patterns[0][1]
    found["credit_cards"] = f"""
        WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{to_duckdb(card)}')) AS text FROM documents),
        d AS (SELECT *, reverse(regexp_replace(text, '[- ]', '', 'g')) AS r FROM m),
        s AS (SELECT *, list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(r[i] AS INT) > 4 THEN CAST(r[i] AS INT) * 2 - 9 ELSE CAST(r[i] AS INT) * 2 END ELSE CAST(r[i] AS INT) END FOR i IN range(1, length(r) + 1)]) AS total FROM d)
        SELECT doc_id, text, CAST(1.0 AS DOUBLE) AS score, count(*) AS n FROM s WHERE total % 10 = 0 GROUP BY ALL"""
    found["scan_lines"] = r"""
        WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS content FROM documents WHERE octet_length(encode(text)) > 0)
        SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(sum(octet_length(encode(regexp_replace(content, '\r\z', '')))) AS BIGINT) AS n_bytes FROM p GROUP BY doc_id"""
    return found
