"""Records' titles in the pages and documents that their links lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.pages import document_column, page_evidence_column


def in_pages(records: DataFrame, versions: DataFrame, key: str, title: str = "title", surnames: str = "surnames") -> DataFrame:
    """key, url and evidence of each record of `records`: of its first version that matches, else of its first.

    versions has the key, rank (a page itself before its other languages), url and html. Records without a version have
    nulls, repeated versions of a rank are taken in the order of their url, null keys meet nothing. A version's page
    moves once, and what a record keeps of its versions is one row, which tasks reduce before it moves.
    """
    asked = records.select(F.col(key).alias("__key"), F.col(title).alias("__title"), F.col(surnames).alias("__names"))
    pages = versions.select(F.col(key).alias("__of"), "rank", "url", "html")
    seen = asked.join(pages, F.col("__key") == F.col("__of")).select("__key", "rank", "url", page_evidence_column(F.col("__title"), F.col("__names"), F.col("html")).alias("evidence"))
    order = F.struct(~F.col("evidence.matched"), "rank", "url")
    best = seen.groupBy("__key").agg(F.min_by(F.struct("url", "evidence"), order).alias("best"))
    return records.select(F.col(key)).join(best, F.col(key) == F.col("__key"), "left").select(key, "best.url", "best.evidence")


def in_documents(records: DataFrame, documents: DataFrame, key: str, title: str = "title", surnames: str = "surnames", year: str = "year") -> DataFrame:
    """key and document (whether title, any surname and year are in it, null without one) of each record; documents has the key and text, the first by text if there are several."""
    texts = documents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__of")).agg(F.min("text").alias("__text"))
    joined = records.select(key, F.col(title).alias("__title"), F.col(surnames).alias("__names"), F.col(year).alias("__year")).join(texts, F.col(key) == F.col("__of"), "left")
    found = joined.where(F.col("__of").isNotNull()).select(key, document_column(F.col("__title"), F.col("__names"), F.col("__year"), F.col("__text")).alias("document"))
    return found.unionByName(joined.where(F.col("__of").isNull()).select(key, F.lit(None).cast(found.schema["document"].dataType).alias("document")))
