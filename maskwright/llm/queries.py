"""The registered queries of this subpackage: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm.bpe import token_digests
from maskwright.llm.brown_lm import score_texts
from maskwright.llm.common import table
from maskwright.llm.embeddings import near_vectors
from maskwright.llm.fill_in_middle import fim_digests
from maskwright.llm.importance import importance_resampling
from maskwright.llm.inner_product import nearest_by_inner_product
from maskwright.llm.lsh_forest import near_documents
from maskwright.llm.packing import pack
from maskwright.llm.quality import quality
from maskwright.llm.token_counts import token_counts
from maskwright.llm.toxicity import toxicity
from maskwright.llm.url_rules import judge_pages
from maskwright.llm.warc import warc_round_trip


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file (the folder is set up by the machine, not by this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"), words=4)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_inner_product(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_url_rules, op3_brown_lm, op4_embedding_neardup, op5_lsh_forest, op6_bpe, op7_anisotropic_search, op8_packing, op9_toxicity, op10_quality, op11_fill_in_middle, op12_token_counts, op13_importance)}

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY sha1(h)) AS k FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
               CASE WHEN n < 1000 OR k = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 1000 OR k = page_id THEN NULL ELSE k END AS refers_to
        FROM d
    """,
    # lines come from splitting, and parts from positions: neither patterns nor lists of units as in the operator
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), e AS (
            SELECT doc_id, text, l, CASE WHEN l[len(l)] = '' THEN len(l) - 1 ELSE len(l) END AS n, [CAST('0x' || h[8 * k - 7 : 8 * k] AS BIGINT) FOR k IN [1, 2, 3, 4]] AS h FROM d
        ), f AS (
            SELECT doc_id, text, l, n, h, [least(h[1] % (n + 1), h[2] % (n + 1)), greatest(h[1] % (n + 1), h[2] % (n + 1))] AS c FROM e
        ), g AS (
            SELECT doc_id, text, n, h, [CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(l[1:k], chr(10))) + CASE WHEN k < len(l) THEN 1 ELSE 0 END END FOR k IN c] AS cut FROM f
        ), o AS (
            SELECT doc_id, text, n, cut, substr(text, 1, cut[1]) AS p, substr(text, cut[1] + 1, cut[2] - cut[1]) AS m, substr(text, cut[2] + 1) AS s,
                   CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(cut[1] AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(cut[2] - cut[1] AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM o
    """,
    # crc32 by its table of 256 remainders
    "op13_importance": """
        WITH crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)
        ), w AS (
            SELECT doc_id, row_number() OVER () AS k, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x, true AS doc FROM documents
            UNION ALL
            SELECT NULL, NULL, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), false FROM benchmark
        ), f AS (
            SELECT k, doc, word, count(*) AS n FROM (SELECT k, doc, unnest(x) AS word FROM w) WHERE word <> '' GROUP BY ALL
        ), words AS (
            SELECT DISTINCT word FROM f
        ), hashed AS (
            SELECT word, xor(list_reduce(list_concat([4294967295], [CAST('0x' || hex(encode(word))[2 * j - 1 : 2 * j] AS BIGINT) FOR j IN range(1, octet_length(encode(word)) + 1)]), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, crc
        ), b AS (
            SELECT bucket, sum(CASE WHEN doc THEN n ELSE 0 END) AS s, sum(CASE WHEN doc THEN 0 ELSE n END) AS t FROM f JOIN hashed USING (word) GROUP BY bucket
        ), g AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM b) AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT sum(t) FROM b) AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM b
        ), v AS (
            SELECT k, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS gain FROM f JOIN hashed USING (word) JOIN g USING (bucket) WHERE doc GROUP BY k
        ), a AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (gain - ((gain % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight, CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h
            FROM w LEFT JOIN v USING (k) WHERE w.doc
        ), z AS (
            SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM a
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM z
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM r
    """,
}
