"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import base, decontam, html, langid, media, packing, quality, simhash, substring, tokens, warc

#: A tokenizer file installed on every machine.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_warc(spark, sf_dir):
    """A fixity drill: pages as stored WARC segments against a replica with known damage; both are kept."""
    stored = warc.archive(table(spark, sf_dir, "pages"))
    copy = warc.replica(stored, warc.drill)
    return warc.audit(warc.leaves(stored), warc.leaves(copy))


def op2_substring(spark, sf_dir):
    return substring.digests(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.shown(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op8_media(spark, sf_dir):
    return media.digests(table(spark, sf_dir, "documents"))


def op9_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op10_tokens(spark, sf_dir):
    return tokens.digests(table(spark, sf_dir, "documents"), tokenizer())


QUERIES = {f.__name__: f for f in (op1_warc, op2_substring, op3_simhash, op4_quality, op5_decontamination, op6_language, op7_packing, op8_media, op9_html, op10_tokens)}

ORACLES = {
    "op1_warc": r"""
        WITH body AS (
            SELECT page_id, encode(coalesce(html, '')) AS html, coalesce(url, '') AS url FROM pages
        ), rec AS (
            SELECT page_id, encode(
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 2020-01-01T00:00:00Z' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(html) || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(html) || chr(13) || chr(10) || chr(13) || chr(10)
            ) || html || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS data
            FROM body
        ), before AS (
            SELECT page_id, page_id >> 8 AS segment, octet_length(data) AS length, sha256(data) AS digest,
                coalesce(sum(octet_length(data)) OVER (PARTITION BY page_id >> 8 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS put
            FROM rec
        )
        SELECT page_id,
            CASE WHEN page_id % 97 = 13 OR page_id % 101 = 29 THEN 'corrupt' ELSE 'missing' END AS status,
            CAST(segment AS BIGINT) AS segment, CAST(0 AS INTEGER) AS part, CAST(put AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, digest
        FROM before WHERE page_id % 97 = 13 OR page_id % 101 = 29 OR page_id % 103 = 41
    """,
    "op2_substring": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
        ), pos AS (
            SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM docs WHERE len(words) >= 50
        ), win AS (
            SELECT doc_id, i, md5_number(array_to_string(words[i:i + 49], ' ')) AS h FROM pos
        ), hit AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
        ), lost AS (
            SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id
        )
        SELECT docs.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(lost), 0) AS BIGINT) AS n_removed,
            sha256(coalesce(array_to_string(list_filter(words, lambda w, k: lost IS NULL OR NOT list_contains(lost, k)), ' '), '')) AS kept_sha256
        FROM docs LEFT JOIN lost USING (doc_id)
    """,
}


def oracle_sql():
    return dict(ORACLES)
