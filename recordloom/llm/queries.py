"""The queries of this subpackage's operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, exact_dedup, html_text, lexical, licenses, media, mixing, pii, simhash, token_counts, toxicity, warc, whitening
from recordloom.llm.common import documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(spark, warc.write_archive(documents(spark, sf_dir, "pages"))).drop("url")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summaries(licenses.scan_licenses(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = media.store_tiles(media.media_features(media.store_texts(documents(spark, sf_dir))))
    return media.tile_digests(tiles).withColumnRenamed("id", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = toxicity.score(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(documents(spark, sf_dir, "pages"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(documents(spark, sf_dir)), documents(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_licenses, op3_media, op4_mixing, op5_bpe, op6_toxicity, op7_simhash, op8_exact_dedup, op9_token_counts, op10_html, op11_pii, op12_search, op13_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The terms of a text, as the lexical search has them.
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Hex digit number `i` of a lower-case hex string, and five of its bits as a base-32 digit.
_DIGIT = "(instr('0123456789abcdef', substr(h, {0} + 1, 1)) - 1)"
_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((" + _DIGIT.format("(5 * i // 4)") + " * 16 + " + _DIGIT.format("(5 * i // 4 + 1)") + ") >> (3 - 5 * i % 4)) & 31) + 1)::INT, 1)"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, strlen(html) AS payload_bytes, array_to_string([{_BASE32} FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM r""",
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op12_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
             q AS (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark),
             tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
             total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
             w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
             s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
                   FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL),
             o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
}
