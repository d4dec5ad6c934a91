"""Queries of this subpackage over the driver's tables, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headrace.llm import bpe, decontaminate, divergence, hmm, jaccard, licenses, mincut, minhash, packing, quality, simple8b, warc, whitening
from headrace.llm.common import table

ORACLES: dict[str, str] = {}


def op1_hmm(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.language_scores(table(spark, folder, "documents"))


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # rows that repeat a doc_id are of one class
    prints, sets = minhash.prints_and_sets(docs)
    return prints.join(minhash.duplicate_classes(docs, sets).filter("doc_id IS NOT NULL").distinct(), "doc_id", "left")


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.components(table(spark, folder, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op3_jaccard"] = rf"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    g AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r, ALL),
    links AS (SELECT DISTINCT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY ALL)
    SELECT doc_id, len(s) AS n_shingles, component_id FROM s LEFT JOIN least USING (doc_id)""".replace("GROUP BY a.r, b.r, ALL", "GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items", "spans")


ORACLES["op4_decontamination"] = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    v AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
          FROM i, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p) WHERE len(w) > 0),
    k AS (SELECT DISTINCT k FROM v),
    m AS (SELECT r, p, k, item FROM (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM d, k, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)) x
          JOIN v USING (k, g)),
    hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
    it AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
           coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents")).drop("spans")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op6_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM q LEFT JOIN f USING (payload_digest)"""


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    return simple8b.token_archive(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_sequences(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_mincut(spark: SparkSession, folder: str) -> DataFrame:
    return mincut.main_text(table(spark, folder, "pages"))


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


ORACLES["op12_divergence"] = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS nl FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v, sum(nl) AS al FROM k GROUP BY ALL),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT lang, source, coalesce(sum(n), 0) AS a FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (a + 5 * v) AS p,
            1 + (1000000000::HUGEINT * (nl + 5)) // (al + 5 * v) AS q
          FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(i AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS i FROM x) WHERE part = 'pair' OR i <= 50"""


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whitened(table(spark, folder, "embeddings"))
    # a deviation beyond a long is NULL there and exact in the column after it
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error",
                        F.col("deviation").alias("deviation_exact"))


QUERIES = {f.__name__: f for f in (op1_hmm, op2_minhash, op3_jaccard, op4_decontamination, op5_licenses, op6_warc, op7_quality, op8_simple8b, op9_packing, op10_mincut, op11_bpe, op12_divergence, op13_whitening)}
