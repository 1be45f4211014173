"""Resolving records to candidates: routing of sources, prefix-best with early exit, decisions, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.identifiers import canonical_url, doi

#: Scores from which a candidate is accepted or goes to review; the order of the sources; the languages
#: and types to which some are restricted.
ACCEPT, REVIEW = 92.0, 75.0
SOURCES = ("crossref", "gesis", "openalex", "semantic_scholar", "core", "lens", "openaire", "doaj", "datacite", "dnb", "hal", "cinii", "swisscovery", "libris", "europepmc", "google_books", "arxiv", "pubmed")
LANGUAGES = {"dnb": ("de",), "hal": ("fr",), "cinii": ("ja",), "swisscovery": ("de", "fr", "it"), "libris": ("sv",)}
TYPES = {"google_books": ("book", "chapter")}
#: Families of sources that count as one confirmation.
FAMILIES = {"crossref": "doi_registry", "datacite": "doi_registry", "openalex": "scholarly_graph", "semantic_scholar": "scholarly_graph", "core": "repository", "openaire": "repository", "hal": "repository", "arxiv": "repository", "gesis": "repository", "pubmed": "subject_index", "cinii": "national_catalogue", "dnb": "national_catalogue"}


#: Names of the sources where they aren't the identifier with a capital.
LABELS = {"gesis": "GESIS", "openalex": "OpenAlex", "semantic_scholar": "Semantic Scholar", "core": "CORE", "lens": "Lens.org", "openaire": "OpenAIRE", "doaj": "DOAJ", "datacite": "DataCite", "dnb": "DNB", "hal": "HAL", "cinii": "CiNii", "libris": "LIBRIS", "europepmc": "Europe PMC", "google_books": "Google Books", "arxiv": "arXiv", "pubmed": "PubMed"}


def source_label(source: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(names[source], F.initcap(source))


def source_table(spark, sources=SOURCES) -> DataFrame:
    """source, base_rank, languages, types, family: a dimension of fixed size."""
    rows = [(s, i, list(LANGUAGES.get(s, ())), list(TYPES.get(s, ())), FAMILIES.get(s, s)) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "source string, base_rank int, languages array<string>, types array<string>, family string")


def route(records: DataFrame, record: str, language: Column, family: Column, sources: DataFrame) -> DataFrame:
    """record, source and source_rank of the sources to ask: regional ones of the language first, others of other
    languages and restricted types left out."""
    rows = records.select(record, language.alias("language"), family.alias("item_family"))
    pairs = rows.crossJoin(F.broadcast(sources))  # a fixed number of sources for each record
    regional = F.size("languages") > 0
    fits = F.array_contains("languages", F.col("language"))
    asked = pairs.where((~regional | F.coalesce(fits, F.lit(False))) & ((F.size("types") == 0) | F.coalesce(F.array_contains("types", F.col("item_family")), F.lit(False))))
    order = F.when(regional, 0).otherwise(1) * 1000 + F.col("base_rank")
    return asked.select(record, "source", order.alias("source_rank"))


def best_candidates(candidates: DataFrame, record: str) -> DataFrame:
    """The best candidate of each record after early exit.

    `candidates` has source_rank, cand_pos, score, reference_only and any other columns. Sources are taken in order;
    after each one the best so far (highest score, the earliest of equals) is judged, and the first acceptable one ends
    the search: a reference-only candidate never does. One window finds the running best, an aggregate the cutoff and
    the winner; a record has a bounded number of candidates from each source.
    """
    order = F.struct(F.col("score"), -F.col("source_rank"), -F.col("cand_pos"), ~F.col("reference_only"))
    running = Window.partitionBy(record).orderBy("source_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = candidates.withColumn("__best", F.max(order).over(running))
    accepted = (F.col("__best.score") >= ACCEPT) & F.col("__best.col4")
    whole = Window.partitionBy(record)
    cut = ranked.withColumn("__cut", F.min(F.when(accepted, F.col("source_rank"))).over(whole))
    seen = cut.where(F.col("__cut").isNull() | (F.col("source_rank") <= F.col("__cut")))
    rest = [c for c in candidates.columns if c != record]
    best = F.max_by(F.struct(*rest), order)
    return seen.groupBy(record).agg(best.alias("__c"), F.max("__cut").alias("cutoff")).select(record, "__c.*", "cutoff")


def ranked(candidates: DataFrame, record: str) -> DataFrame:
    """All candidates with their place by score, without early exit; the earliest of equals is first."""
    order = Window.partitionBy(record).orderBy(F.desc("score"), "source_rank", "cand_pos")
    return candidates.withColumn("place", F.row_number().over(order))


def decide(score: Column, reference_only: Column) -> Column:
    """The status of a record's best candidate."""
    return F.when(score >= REVIEW, F.when(reference_only, "matched_no_link").when(score >= ACCEPT, "auto_accepted").otherwise("needs_review")).otherwise("low_confidence")


def results(records: DataFrame, record: str, candidates: DataFrame, failures: DataFrame | None = None, title: str | None = None) -> DataFrame:
    """record, status, source, doi, url, reference_url, matched_title, match_score for every record.

    `candidates` additionally has source, title, doi and url; `failures` has record, source, source_rank and error,
    and only those up to the cutoff count. Without candidates a record is incomplete if a source failed, else
    not_found; without a title (the column `title` blank) it is no_title.
    """
    best = best_candidates(candidates, record).withColumnRenamed("title", "found_title")
    status = decide(F.col("score"), F.col("reference_only"))
    joined = records.join(best, record, "left").withColumn("status", F.when(F.col("score").isNotNull(), status))
    if failures is not None:
        asked = failures.join(best.select(record, "cutoff"), record, "left").where(F.col("cutoff").isNull() | (F.col("source_rank") <= F.col("cutoff")))
        failed = asked.groupBy(record).agg(F.array_sort(F.collect_set("source")).alias("failed_sources"))
        joined = joined.join(failed, record, "left")
    else:
        joined = joined.withColumn("failed_sources", F.array().cast("array<string>"))
    missing = F.when(F.size(F.coalesce("failed_sources", F.array().cast("array<string>"))) > 0, "incomplete").otherwise("not_found")
    blank = F.lit(False) if title is None else F.trim(F.coalesce(F.col(title), F.lit(""))) == ""
    final = F.when(blank, "no_title").otherwise(F.coalesce("status", missing))
    usable = final.isin("auto_accepted", "needs_review")
    return joined.select(
        record,
        final.alias("status"),
        F.coalesce(F.when(~blank, F.col("source")), F.lit("")).alias("source"),
        F.when(usable, F.coalesce("doi", F.lit(""))).otherwise("").alias("doi"),
        F.when(usable, F.coalesce("url", F.lit(""))).otherwise("").alias("url"),
        F.when(final == "matched_no_link", F.col("url")).alias("reference_url"),
        F.when(final == "low_confidence", F.concat(F.lit("(not accepted, for reference only) "), "found_title")).otherwise(F.coalesce("found_title", F.lit(""))).alias("matched_title"),
        F.when(~blank, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("match_score"),
        F.coalesce("failed_sources", F.array().cast("array<string>")).alias("failed_sources"),
    )


def enrich_urls(found: DataFrame, existing_doi: Column, locations: DataFrame) -> DataFrame:
    """Fill blank URLs from `locations` (doi, url) by the found DOI, else by the one that the record had before."""
    own = doi(F.col("doi"))
    keyed = found.withColumn("__own", own).withColumn("__key", F.lower(F.coalesce(F.nullif(own, F.lit("")), F.nullif(doi(existing_doi), F.lit("")))))
    places = locations.select(F.lower(doi(F.col("doi"))).alias("__key"), F.col("url").alias("__url")).where("__key <> '' AND __url <> ''").groupBy("__key").agg(F.min("__url").alias("__url"))
    hit = (F.coalesce("url", F.lit("")) == "") & F.col("__url").isNotNull()
    joined = keyed.join(places, "__key", "left")
    out = {
        "status": F.when(hit & (F.col("__own") == ""), "url_enriched").otherwise(F.col("status")),
        "source": F.when(hit, F.when(F.col("source") == "", "unpaywall").otherwise(F.concat("source", F.lit("+unpaywall")))).otherwise(F.col("source")),
        "doi": F.when(hit & (F.col("doi") == ""), F.col("__key")).otherwise(F.col("doi")),
        "url": F.when(hit, F.col("__url")).otherwise(F.col("url")),
    }
    return joined.withColumns(out).drop("__own", "__key", "__url")


def confirmations(candidates: DataFrame, record: str, required: int) -> DataFrame:
    """The best accepted candidate of each record up to the source at which enough families have confirmed.

    `candidates` has source_rank, cand_pos, family, title_score and total; a candidate counts from a title score of 80
    and a total of 75.
    """
    accepted = candidates.where("title_score >= 80 AND total >= 75")
    upto = Window.partitionBy(record).orderBy("source_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = accepted.withColumn("__n", F.size(F.collect_set("family").over(upto)))
    cut = counted.withColumn("__cut", F.min(F.when(F.col("__n") >= required, F.col("source_rank"))).over(Window.partitionBy(record)))
    seen = cut.where(F.col("__cut").isNull() | (F.col("source_rank") <= F.col("__cut")))
    best = F.max_by(F.struct("source", "total"), F.struct(F.col("total"), -F.col("source_rank"), -F.col("cand_pos")))
    return seen.groupBy(record).agg(best.alias("b"), F.count_distinct("family").alias("families")).select(record, "b.source", "b.total", "families", (F.col("families") >= required).alias("confirmed"))


#: Fixed value: the most that a candidate under an identity conflict can total.
CAPPED = 74.0


def same_identifier(candidates: DataFrame, records: DataFrame, record: str, doi_column: str = "doi", url_column: str = "url") -> DataFrame:
    """Candidates (record, doi, url, total and maybe conflict) that have the record's own DOI or address, totals capped under a conflict."""
    own = records.select(record, F.lower(doi(F.col(doi_column))).alias("__doi"), canonical_url(F.col(url_column)).alias("__url"))
    by_doi = (F.lower(doi(F.col("doi"))) == F.col("__doi")) & (F.col("__doi") != "")
    by_url = (canonical_url(F.col("url")) == F.col("__url")) & (F.col("__url") != "")
    out = candidates.join(own, record).where(by_doi | by_url).drop("__doi", "__url")
    return out.withColumn("total", F.when(F.coalesce("conflict", F.lit(False)), F.least("total", F.lit(CAPPED))).otherwise(F.col("total"))) if "conflict" in candidates.columns else out


def merge_results(records: DataFrame, record: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """Records with new values of the columns where these aren't blank."""
    fresh = found.select(record, *(F.col(c).alias(f"__{c}") for c in columns))
    return records.join(fresh, record, "left").withColumns({c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def scope(df: DataFrame, doi_cell: Column, url_cell: Column, mode: str) -> tuple[DataFrame, DataFrame]:
    """Rows to look up, and rows that are skipped as complete: mode all, missing_only (either) or missing_both."""
    has_doi, has_url = F.coalesce(F.trim(doi_cell) != "", F.lit(False)), F.coalesce(F.trim(url_cell) != "", F.lit(False))
    done = {"all": F.lit(False), "missing_only": has_doi & has_url, "missing_both": has_doi | has_url}[mode]
    return df.where(~done), df.where(done)
