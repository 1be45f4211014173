"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All stages but the last return the columns of `docs`, whatever others there are. In all of them a
null text counts as empty, texts are read whole, repeated rows are rows of their own, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from recordloom.llm.common import documents, folders, materialize, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; empty texts stay. It learns from the labelled ones among `docs`, without any it has its lexicon only."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the largest doc_id stays, all empty ones being equal; null ids count as the smallest, of equal rows one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles the one with the smallest doc_id stays; one without an id only if there is no other."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null is a source of its own, empty texts are taken by their share of documents."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe.encode_digests(docs).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("bpe", encode)]

#: The grammar, the linked shingle sets, the cube method and the merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the folders of each stage but its result are deleted once that is written."""
    docs, mark = documents(spark, sf_dir), folders()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, docs)
    return docs
