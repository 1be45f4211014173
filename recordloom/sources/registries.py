"""Registries' stored answers for a DOI, read in the JVM into records that verification compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE = "struct<`date-parts`: array<array<int>>>"
#: The parts of the two registries' answers that are read.
CROSSREF = f"message struct<DOI: string, URL: string, title: array<string>, subtitle: array<string>, author: array<struct<family: string>>, `published-print`: {_DATE}, `published-online`: {_DATE}, issued: {_DATE}, type: string, `container-title`: array<string>, publisher: string, volume: string, issue: string, page: string, ISBN: array<string>, ISSN: array<string>>"
DATACITE = "data struct<attributes: struct<doi: string, url: string, titles: array<struct<title: string>>, creators: array<struct<familyName: string, name: string>>, publicationYear: int, types: struct<resourceTypeGeneral: string>, publisher: string>>"

FIELDS = ("title", "main_title", "subtitle", "authors", "years", "item_type", "journal", "publisher", "volume", "issue", "pages", "isbn", "issn")


def _said(cell: Column) -> Column:
    return F.coalesce(cell, F.lit(""))


def _filled(values: Column) -> Column:
    return F.coalesce(F.filter(values, lambda x: x != ""), F.array().cast("array<string>"))


def _record(**fields: Column) -> Column:
    return F.struct(*(fields.get(name, F.lit("")).alias(name) for name in FIELDS))


def _crossref(m: Column) -> Column:
    first = lambda name: _said(F.get(m[name], F.lit(0)))
    main, sub = first("title"), first("subtitle")
    year = lambda name: F.get(F.get(m[name]["date-parts"], F.lit(0)), F.lit(0))
    joined = lambda name: F.array_join(F.coalesce(m[name], F.array().cast("array<string>")), ";")
    return _record(
        title=F.concat_ws(": ", F.nullif(main, F.lit("")), F.nullif(sub, F.lit(""))), main_title=main, subtitle=sub,
        authors=_filled(F.transform(m["author"], lambda a: a["family"])),
        years=F.array_distinct(F.array_compact(F.array(year("published-print"), year("published-online"), year("issued")))),
        item_type=_said(m["type"]), journal=first("container-title"), publisher=_said(m["publisher"]), volume=_said(m["volume"]),
        issue=_said(m["issue"]), pages=_said(m["page"]), isbn=joined("ISBN"), issn=joined("ISSN"),
    )


def _datacite(a: Column) -> Column:
    title = _said(F.get(a["titles"], F.lit(0))["title"])
    names = F.transform(a["creators"], lambda c: F.coalesce(F.nullif(c["familyName"], F.lit("")), c["name"], F.lit("")))
    return _record(
        title=title, main_title=title, authors=F.coalesce(names, F.array().cast("array<string>")),
        years=F.array_compact(F.array(a["publicationYear"])), item_type=_said(a["types"]["resourceTypeGeneral"]), publisher=_said(a["publisher"]),
    )


def registry_answers(answers: DataFrame) -> DataFrame:
    """registry, doi, url and FIELDS for each stored answer (registry, doi, payload as JSON text) that holds a record.

    The title is the main title with the subtitle; the years are those of print, online and issue, each once. A null or
    broken payload, an answer without a record, and a registry other than crossref and datacite give no row; what a
    record doesn't say is empty. Repeated answers give repeated rows, which registry_records() joins into one.
    """
    crossref = F.from_json("payload", CROSSREF)["message"]
    datacite = F.from_json("payload", DATACITE)["data"]["attributes"]
    parsed = answers.select("registry", F.col("doi").alias("asked"), F.when(F.col("registry") == "crossref", crossref).alias("c"), F.when(F.col("registry") == "datacite", datacite).alias("d")).where("c IS NOT NULL OR d IS NOT NULL")
    own = lambda x, y: F.coalesce(F.nullif(F.col(x), F.lit("")), F.nullif(F.col(y), F.lit("")))
    doi = F.coalesce(own("c.DOI", "d.doi"), F.col("asked"))
    record = F.when(F.col("c").isNotNull(), _crossref(F.col("c"))).otherwise(_datacite(F.col("d")))
    return parsed.select("registry", doi.alias("doi"), F.coalesce(own("c.URL", "d.url"), F.concat(F.lit("https://doi.org/"), "asked")).alias("url"), record.alias("r")).select("registry", "doi", "url", "r.*")
