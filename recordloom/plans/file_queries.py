"""Queries of record files: tables are written, read back in parts and patched, each with SQL of the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.plans.record_queries import _t
from recordloom.plans.registry import query
from recordloom.sources import records

#: Bytes of a part: small enough that the smallest tables' files have several.
PART = 8 << 20


def shared_folder(spark, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a temporary one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _document_records(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents").select(
        F.col("doc_id").alias(records.ROW), F.lit("article-journal").alias("Item Type"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("Title"), F.concat_ws("; ", "lang", "source").alias("Keywords"),
        F.col("text").alias("Abstract"), F.col("n_chars").cast("string").alias("Size"), F.concat(F.lit("https://h.org/"), F.col("doc_id").cast("string")).alias("Url"),
    )


#: Lines of a text without white space around them, the empty ones left out.
_LINES = "array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@query(rf"""
    SELECT 'Document ' || doc_id AS title, concat_ws('; ', lang, source) AS keywords, {_LINES} AS abstract, n_chars::VARCHAR AS size, 'https://h.org/' || doc_id AS url, 'JOUR' AS item_type FROM documents""")
def ris_round_trip(spark, sf):
    """Documents as RIS files, abstracts line by line, their size as a carried column, read back in parts."""
    path = shared_folder(spark, "ris")
    records.write_records(_document_records(spark, sf), path, "ris")
    found = records.read_fields(spark, f"{path}/*.ris", part=PART)
    cell = lambda name: F.coalesce(F.col("fields").getItem(name), F.lit(""))
    return found.select(cell("Title").alias("title"), cell("Keywords").alias("keywords"), cell("Abstract").alias("abstract"), cell("Size").alias("size"), cell("Url").alias("url"), cell("Item Type").alias("item_type"))


@query(rf"""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Changed ' || doc_id ELSE 'Document ' || doc_id END AS title, CASE WHEN doc_id % 4 = 1 THEN '' ELSE concat_ws('; ', lang, source) END AS keywords, {_LINES} AS abstract, CASE WHEN doc_id % 5 = 0 THEN '10.1234/' || doc_id ELSE '' END AS doi FROM documents""")
def ris_patched(spark, sf):
    """A folder of RIS files whose titles, keywords and DOIs change in some records: only those lines are written anew."""
    path, out = shared_folder(spark, "ris"), shared_folder(spark, "patched")
    records.write_records(_document_records(spark, sf), path, "ris")
    table = records.spread(records.read_fields(spark, f"{path}/*.ris", part=PART))
    key = F.regexp_extract("Url", "[0-9-]+$", 0).cast("long")
    new = table.withColumns({"Title": F.when(key % 3 == 0, F.concat(F.lit("Changed "), key.cast("string"))).otherwise(F.col("Title")), "Keywords": F.when(key % 4 == 1, "").otherwise(F.col("Keywords")), "DOI": F.when(key % 5 == 0, F.concat(F.lit("10.1234/"), key.cast("string"))).otherwise("")})
    records.write_patched(records.patch_ris(spark, f"{path}/*.ris", new, part=PART), out)
    cell = lambda name: F.coalesce(F.col("fields").getItem(name), F.lit(""))
    return records.read_fields(spark, f"{out}/*.ris", part=PART).select(F.regexp_extract(cell("Url"), "[0-9-]+$", 0).cast("long").alias("doc_id"), cell("Title").alias("title"), cell("Keywords").alias("keywords"), cell("Abstract").alias("abstract"), cell("DOI").alias("doi"))


@query(r"""
    WITH t AS (SELECT *, 'k' || page_id % 50 AS k, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS n,
                      trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages)
    SELECT CASE WHEN n = 1 THEN k ELSE k || n END AS key, title, url, page_id::VARCHAR AS page FROM t""")
def bibtex_round_trip(spark, sf):
    """Pages as BibTeX entries with repeated keys and a carried column, read back in parts."""
    path = shared_folder(spark, "bibtex")
    title = F.replace(F.replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    rows = _t(spark, sf, "pages").select(F.col("page_id").alias(records.ROW), F.concat(F.lit("k"), (F.col("page_id") % 50).cast("string")).alias("Key"), F.trim(F.regexp_replace(title, r"\s+", " ")).alias("Title"), F.col("url").alias("Url"), F.col("page_id").cast("string").alias("Page"))
    records.write_records(rows, path, "bibtex")
    cell = lambda name: F.coalesce(F.col("fields").getItem(name), F.lit(""))
    return records.read_fields(spark, f"{path}/*.bib", part=PART).select(cell("Key").alias("key"), cell("Title").alias("title"), cell("Url").alias("url"), cell("Page").alias("page"))


@query(r"""SELECT conv_id || '-' || turn AS key, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS abstract, coalesce(role, '') AS keywords FROM conversations""")
def json_round_trip(spark, sf):
    """Turns of conversations as CSL JSON, an item in a line, read back in parts."""
    path = shared_folder(spark, "json")
    key = F.concat_ws("-", "conv_id", "turn")
    rows = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias(records.ROW), key.alias("Key"), F.lit("T").alias("Title"), F.col("text").alias("Abstract"), F.col("role").alias("Keywords"))
    records.write_records(rows, path, "csl_json")
    cell = lambda name: F.coalesce(F.col("fields").getItem(name), F.lit(""))
    return records.read_fields(spark, f"{path}/*.jsonl", part=PART).select(cell("Key").alias("key"), cell("Abstract Note").alias("abstract"), cell("Keywords").alias("keywords"))
