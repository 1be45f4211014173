import pytest

from recordloom.llm import queries
from tests.oracle import same

COLUMNS = {
    "op1_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op2_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op3_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9_token_counts": {"doc_id", "n_tokens"},
    "op10_html": {"page_id", "url", "text", "n_chars"},
    "op12_search": {"item_id", "rank", "doc_id", "score"},
    "op13_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op11_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name] <= set(found.columns)
    table = {"page_id": "pages", "item_id": "benchmark", "vec_id": "embeddings"}.get(found.columns[0], "documents")
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count() * {"benchmark": 10, "embeddings": 32}.get(table, 1)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name])
