"""Column expressions for identifiers, links and HTTP answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.cells import clean, fold, title_key

_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"


def doi(cell: Column) -> Column:
    """A DOI without resolver or `doi:` and without trailing `.,;)`; case stays."""
    return F.regexp_replace(F.trim(F.regexp_replace(clean(cell), _PREFIX, "")), r"[.,;)]+$", "")


def strict_doi(cell: Column) -> Column:
    """A folded DOI of the form 10.nnnn/..., blank for all else."""
    text = fold(F.regexp_replace(F.trim(F.regexp_replace(clean(cell), _PREFIX, "")), r"[.,; ]+$", ""))
    return F.when(text.rlike(r"^10\.\d{4,9}/"), text).otherwise("")


def doi_of_url(cell: Column) -> Column:
    """The DOI in a resolver's URL, with percent signs decoded; blank for other URLs."""
    path = F.regexp_extract(clean(cell), r"(?i)^https?://(?:dx\.|www\.)?doi\.org/([^?#]+)", 1)
    return doi(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def match_value(cell: Column) -> Column:
    """A key for loose matching: `doi:` and the folded DOI, else the title key."""
    found = doi(cell)
    return F.when(F.startswith(found, F.lit("10.")), F.concat(F.lit("doi:"), fold(found))).otherwise(title_key(F.regexp_replace(clean(cell), r"^(-?\d+)\.0+$", "$1")))


def canonical_url(cell: Column) -> Column:
    """Lower-case host and decoded path without trailing slashes; query and fragment go."""
    text = clean(cell)
    host = F.lower(F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.concat(host, F.regexp_replace(decoded, "/+$", ""))


def record_link(url: Column, identifier: Column) -> Column:
    """The URL if there is one, else the DOI as a link."""
    bare = F.regexp_replace(clean(identifier), r"(?i)^doi:\s*", "")
    link = F.when(bare == "", "").when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://doi.org/"), bare))
    return F.coalesce(F.nullif(clean(url), F.lit("")), link)


def urls_in(cell: Column) -> Column:
    """Distinct http(s) URLs in order; trailing punctuation goes, and a closing bracket that the URL doesn't open."""
    found = F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit("(?i)https?://[^\\s<>\"']+"), F.lit(0))

    def trim(url: Column) -> Column:
        bare = F.regexp_replace(url, r"[.,;:!?]+$", "")
        for opening, closing in (("(", ")"), ("[", "]")):
            opened, closed = F.size(F.split(bare, "\\" + opening)), F.size(F.split(bare, "\\" + closing))
            bare = F.when(F.endswith(bare, F.lit(closing)) & (closed > opened), F.regexp_replace(bare, rf"\{closing}[.,;:!?]*$", "")).otherwise(bare)
        return F.regexp_replace(bare, r"[.,;:!?]+$", "")

    return F.array_distinct(F.transform(found, trim))


def access_status(code: Column) -> Column:
    """What an HTTP status says of a link."""
    return (
        F.when(code.between(200, 399), "reachable")
        .when(code.isin(401, 403), "access_blocked")
        .when(code == 429, "rate_limited")
        .when(code.isin(404, 410), "broken")
        .when(code >= 500, "temporarily_unavailable")
        .otherwise("http_error")
    )
