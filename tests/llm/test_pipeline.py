import hashlib
import struct
from collections import Counter

import corpus_pipeline
from recordloom.llm import pretokens, toxicity
from tests.llm.test_near_copies import stay

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], DIR).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    ids = [sorted(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    grammar = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    left = {i: t for i, t in rows.items() if grammar.score(t) < toxicity.THRESHOLD}
    assert ids[1] == sorted(left)
    last = {}
    for i, t in left.items():
        last[t.translate(A)] = max(i, last.get(t.translate(A), i))
    assert ids[2] == sorted(last.values())
    assert ids[3] == stay([(i, rows[i]) for i in last.values()])
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 2
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.load_ranks(pretokens.default_path()), special_tokens={})
    want = []
    for i in ids[4]:
        found = encoding.encode_ordinary(rows[i])
        want.append((i, len(found), hashlib.sha256(struct.pack(f"<{len(found)}I", *found)).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tables[5].collect()) == want


def test_run_leaves_its_result_only(spark):
    from recordloom.llm import common

    before = common.folders()
    rows = corpus_pipeline.run(spark, DIR)
    assert common.folders() == before + 1 and rows.count() > 0


def test_stages_on_odd_rows(spark, tables, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns, no rows."""
    labels = f"{tmp_path}/sf/labels.parquet"
    spark.createDataFrame([(1, None, 1), (None, 1, 0), (9, 0, 0), (11, 1, None)], "doc_id long, quality int, toxic int").write.parquet(labels)
    for name, table in tables.items():
        docs = table
        for at, (stage, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, docs, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{name}-{at}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{at}")
            assert (docs.count() == 0) == (name == "empty") and (stage == "bpe" or docs.columns == table.columns)
        rows = docs.collect()
        kept = spark.read.parquet(f"{tmp_path}/{name}-2")
        if name != "empty":  # one of the copies, one of the three texts without words
            texts = [r.text or "" for r in kept.collect()]
            assert sum("same" in t.lower() for t in texts) <= 1 and sum(not t.split() for t in texts) == 1 and len(rows) > 0
