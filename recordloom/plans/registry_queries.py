"""Queries of registries' answers, mentions of studies and exports of reviews, each with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import studies
from recordloom.operators import filters
from recordloom.plans.record_queries import _t
from recordloom.plans.registry import query
from recordloom.sources import registries


@query("""
    SELECT IF(p_partkey % 2 = 0, 'crossref', 'datacite') AS registry, '10.1/' || p_partkey AS doi,
        CASE WHEN p_partkey % 2 = 0 AND p_size > 25 THEN p_name || ': ' || p_type ELSE p_name END AS title,
        CASE WHEN p_partkey % 2 = 0 AND p_size > 25 THEN p_type ELSE '' END AS subtitle, p_brand AS authors,
        CASE WHEN p_partkey % 2 = 1 OR p_size % 3 = p_partkey % 3 THEN (1990 + p_size % 3)::VARCHAR ELSE (1990 + p_size % 3) || '; ' || (1990 + p_partkey % 3) END AS years,
        IF(p_partkey % 2 = 0, p_brand, '') AS journal, p_type AS publisher
    FROM part""")
def registry_records_of_parts(spark, sf):
    """Stored answers of two registries, written as JSON from all parts and read back as records."""
    dated = lambda year: F.struct(F.array(F.array(year.cast("int"), F.lit(1))).alias("date-parts"))
    first, second = 1990 + F.col("p_size") % 3, 1990 + F.col("p_partkey") % 3
    crossref = F.to_json(F.struct(F.struct(
        F.concat(F.lit("10.1/"), "p_partkey").alias("DOI"), F.array("p_name").alias("title"), F.when(F.col("p_size") > 25, F.array("p_type")).alias("subtitle"),
        F.array(F.struct(F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("family"))).alias("author"),
        dated(first).alias("published-print"), dated(second).alias("published-online"), dated(first).alias("issued"), F.array("p_brand").alias("container-title"), F.col("p_type").alias("publisher"),
    ).alias("message")))
    datacite = F.to_json(F.struct(F.struct(F.struct(
        F.array(F.struct(F.col("p_name").alias("title"))).alias("titles"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("creators"), first.cast("int").alias("publicationYear"), F.col("p_type").alias("publisher"),
    ).alias("attributes")).alias("data")))
    even = F.col("p_partkey") % 2 == 0
    answers = _t(spark, sf, "part").select(F.when(even, "crossref").otherwise("datacite").alias("registry"), F.concat(F.lit("10.1/"), "p_partkey").alias("doi"), F.when(even, crossref).otherwise(datacite).alias("payload"))
    return registries.registry_answers(answers).select("registry", "doi", "title", "subtitle", F.array_join("authors", "; ").alias("authors"), F.array_join(F.col("years").cast("array<string>"), "; ").alias("years"), "journal", "publisher")


@query(r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') || ' See ZA' || (100 + doc_id % 9000) || ', za-0' || (100 + doc_id % 7) || ' and 10.4232/1.' || doc_id || '; ISSP module ' || (1975 + doc_id % 60) || '. In ' || (1990 + doc_id % 5) || ' the issp, ' AS x FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(x, '(?i)\bZA[\s-]?(\d{3,5})\b', 1), lambda v: v::INT))), ',') AS numbers,
        array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(x, '(?i)10\.4232/1\.\d+'), lambda v: lower(v)))), ',') AS dois,
        array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(x, '(?i)\bISSP\b[^0-9]{0,15}(?:19[89]\d|20[0-2]\d)|(?:19[89]\d|20[0-2]\d)[^0-9]{0,15}\bISSP\b'), lambda v: regexp_extract(v, '\d{4}')::INT))), ',') AS years
    FROM t""")
def study_mentions(spark, sf):
    """Archive numbers, dataset DOIs and survey years in all texts, to which mentions are added."""
    n = F.col("doc_id")
    added = F.concat(F.coalesce("text", F.lit("")), F.lit(" See ZA"), 100 + n % 9000, F.lit(", za-0"), 100 + n % 7, F.lit(" and 10.4232/1."), n, F.lit("; ISSP module "), 1975 + n % 60, F.lit(". In "), 1990 + n % 5, F.lit(" the issp, "))
    joined = lambda xs, name: F.array_join(xs.cast("array<string>"), ",").alias(name)
    return _t(spark, sf, "documents").select("doc_id", joined(studies.archive_numbers(added), "numbers"), joined(studies.dataset_dois(added), "dois"), joined(studies.survey_years(added, "ISSP"), "years"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority AS decision FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000 AND lower(o_orderpriority) LIKE '%urgent%'")
def exported_reviews(spark, sf):
    """Orders filtered by the operators of their columns' kinds, without the review column that nobody filled."""
    orders = _t(spark, sf, "orders").withColumn("decision", F.col("o_orderpriority")).withColumn("review_note", F.lit(" "))
    conditions = [("o_totalprice", "between", "1000", "150000"), ("decision", "contains", "URGENT", "")]
    filters.filter_by_kind(orders, conditions)
    return filters.export_frame(orders, ["o_orderkey", "o_orderstatus", "decision", "review_note"], ("decision", "review_note"), conditions)
