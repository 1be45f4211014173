"""Links in notes, and whether a found abstract belongs to its record."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.cells import clean, split_any, surnames
from recordloom.functions.identifiers import record_link, strict_doi, urls_in
from recordloom.functions.pages import plain
from recordloom.functions.similarity import author_bonus, contained_score, normalize, partial_ratio

#: A note's pieces: links as elements, bare addresses, other markup.
_PIECE = re.compile(r"(?P<link><a\b[^>]*>.*?</a>)|(?P<url>https?://[^\s<>\"']+)|(?P<markup></?\w[^>]*>)", re.I | re.S)
_TARGET = re.compile(r"href\s*=\s*[\"']([^\"']*)", re.I)
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Stands for a removed link until the note is tidied around it.
_GONE = "\0"
#: What goes with a removed link: brackets and elements around nothing else.
_AROUND = re.compile(rf"\(\s*{_GONE}\s*\)|\[\s*{_GONE}\s*\]|(?:<|&lt;)\s*{_GONE}\s*(?:>|&gt;)|<(p|div|span|li|ul|ol)\b[^>]*>(?:\s|<br\s*/?>|&nbsp;)*{_GONE}(?:\s|<br\s*/?>|&nbsp;|{_GONE})*</\1>", re.I)


def trim_url(url: str) -> str:
    """An address without the punctuation behind it; closing brackets stay where the address opened them."""
    open_: list[str] = []
    keep = 0
    for place, sign in enumerate(url, 1):
        if sign in _PAIRS.values():
            open_.append(sign)
        elif sign in _PAIRS:
            if _PAIRS[sign] not in open_:
                continue
            open_.remove(_PAIRS[sign])
        elif sign in ".,;:!?>":
            continue
        keep = place
    return url[:keep]


def _same(url: str) -> str:
    return unescape(url).strip().casefold().rstrip("/")


def remove_links(note: str, links: list[str]) -> tuple[str, int]:
    """A note without the given links, bare or as elements, and their number; what encloses nothing else goes too."""
    given = {_same(x) for x in links if x}
    out, at, removed = [], 0, 0
    for piece in _PIECE.finditer(note) if given else ():
        if piece.lastgroup == "markup":
            continue
        if piece["link"]:
            target, end = _TARGET.search(piece[0]), piece.end()
            address = target[1] if target else ""
        else:
            address = trim_url(piece[0])
            end = piece.start() + len(address)
        if _same(address) in given:
            out += [note[at : piece.start()], _GONE]
            at, removed = end, removed + 1
    if not removed:
        return note.strip(), 0
    text = "".join(out) + note[at:]
    while (around := _AROUND.sub(_GONE, text)) != text:
        text = around
    # punctuation that followed a link has nothing to follow at a line's or paragraph's start
    text = re.sub(rf"(?:(?<=\n)|(?<=>)|\A)[ \t]*{_GONE}[ \t]*[.,;:]*[ \t]*", "", text)
    text = re.sub(rf"[ \t]*{_GONE}(?=[ \t])|{_GONE}", "", text).strip()
    return (text if plain(text) else ""), removed


_CLEANED = T.StructType([T.StructField("note", T.StringType()), T.StructField("removed", T.IntegerType())])


@F.pandas_udf(_CLEANED)
def _remove(note: pd.Series, links: pd.Series) -> pd.DataFrame:
    rows = []
    for text, urls in zip(note, links, strict=True):
        done = [remove_links(line, list(urls)) for line in (text or "").split("\n")]
        count = sum(n for _, n in done)
        rows.append(("\n".join(x for x, n in done if x or not n).strip() if count else text or "", count))
    return pd.DataFrame(rows, columns=["note", "removed"])


def is_only(note: Column, marker: str) -> Column:
    """Whether nothing but one word stands in a note, markup and punctuation apart."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(note, F.lit("")), "<[^>]+>", " "), "&nbsp;", " ")
    return text.rlike(rf"(?iU)^[\W_]*{re.escape(marker)}[\W_]*$")


def recover_links(df: DataFrame, note: str, url: str, doi: str, remove: bool = False, marker: str | None = None) -> DataFrame:
    """Rows with note_urls, link_added, and the URL column filled by the note's first URL where there was neither.

    `remove` takes links that the record now has out of its note, `marker` blanks notes that hold only that word.
    """
    found = urls_in(F.replace(F.col(note), F.lit("&amp;"), F.lit("&")))
    had = record_link(F.col(url), F.col(doi)) != ""
    out = df.withColumn("note_urls", found).withColumn("link_added", ~had & (F.size("note_urls") > 0)).withColumn(url, F.when(F.col("link_added"), F.get("note_urls", F.lit(0))).otherwise(clean(F.col(url))))
    if remove:
        links = F.array(record_link(F.col(url), F.col(doi)), F.col(url), clean(F.col(doi)))
        touched = _remove(F.col(note), links)
        out = out.withColumn("__n", touched).withColumn(note, F.col("__n.note")).withColumn("links_removed", F.col("__n.removed")).drop("__n")
    if marker:
        out = out.withColumn(note, F.when(is_only(F.col(note), marker), "").otherwise(F.col(note)))
    return out


def link_counters(df: DataFrame, note: str, url: str, doi: str) -> DataFrame:
    """One row: how many records have links, notes, both, and links only in their notes."""
    link, has_note = record_link(F.col(url), F.col(doi)) != "", clean(F.col(note)) != ""
    in_note = F.size(urls_in(F.col(note))) > 0
    conditions = {"records": F.lit(True), "with_link": link, "with_note": has_note, "with_both": link & has_note, "note_without_link": ~link & has_note, "url_in_note_only": ~link & has_note & in_note}
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()))


def recovery_counters(before: DataFrame, after: DataFrame, record: str, note: str, url: str, doi: str) -> DataFrame:
    """link_counters() of a table, and what recover_links() did to it: urls found, notes with one or several, links added, removed and changed notes, blanked ones."""
    columns = ["note_urls", "link_added", *(["links_removed"] if "links_removed" in after.columns else [])]
    both = before.select(record, F.col(note).alias("__old")).join(after.select(record, F.col(note).alias("__new"), *columns), record)
    n, removed = F.size("note_urls"), F.col("links_removed") if len(columns) > 2 else F.lit(0)
    old, new = clean(F.col("__old")), clean(F.col("__new"))
    sums = {"urls_found": F.sum(n), "notes_with_url": F.count_if(n > 0), "notes_with_several": F.count_if(n > 1), "links_added": F.count_if("link_added"), "links_removed": F.sum(removed), "notes_cleaned": F.count_if(removed > 0), "notes_changed": F.count_if(old != new), "notes_blanked": F.count_if((old != "") & (new == "")), "still_without_link": F.count_if(~F.col("link_added") & (n == 0))}
    return link_counters(before, note, url, doi).crossJoin(both.agg(*(F.coalesce(x, F.lit(0)).cast("long").alias(k) for k, x in sums.items())))


#: Tags of a found abstract by its check.
REVIEW_TAGS = {"possible_mismatch": "abstract_found_possible_mismatch", "insufficient_metadata": "abstract_found_needs_review", "matched": "abstract_match_confirmed"}


def replace_review_tag(cell: Column, status: Column, tags: dict[str, str] | None = None) -> Column:
    """A tag cell without earlier review tags and with the one of the status."""
    tags = tags or REVIEW_TAGS
    own = F.filter(split_any(cell), lambda x: ~x.isin(*tags.values()))
    new = F.lit(None).cast("string")
    for name, tag in tags.items():
        new = F.when(status == name, tag).otherwise(new)
    return F.array_join(F.when(new.isNull(), own).otherwise(F.array_append(own, new)), "; ")


#: The least title score, and years that may lie between.
LEAST_TITLE, YEARS = 80, 1


def identity(title: str, names: list[str], year: str, doi: str, page: dict) -> dict:
    """Title score, matches (None where a side is blank), status and message of a page against a record.

    A check that fails is a conflict; without conflicts, a title or author that couldn't be checked leaves it open.
    """
    text, heading = normalize(page.get("text")), plain(page.get("title"))
    writers = [x for x in map(plain, page.get("authors") or []) if x]
    page_year = page.get("year") or ""
    dois = [x for x in map(_bare_doi, page.get("dois") or []) if x]
    score = None
    if title and (heading or text):
        score = contained_score(title, heading) if heading else round(partial_ratio(normalize(title), text), 2)
    checks = {
        "title": None if score is None else score >= LEAST_TITLE,
        "author": None if not names or not (writers or text) else author_bonus(names, writers)[0] > 0 if writers else any(normalize(n) in text for n in names),
        "year": abs(int(year) - int(page_year)) <= YEARS if year and page_year else None,
        "doi": doi in dois if doi and dois else None,
    }
    said = {
        "title": lambda: f"title {score:.1f} of 100, less than {LEAST_TITLE}",
        "author": lambda: "no author stands on the page",
        "year": lambda: f"year {page_year} on the page, {year} in the record",
        "doi": lambda: f"DOI {', '.join(dois)} on the page, {doi} in the record",
    }
    conflicts = [said[k]() for k, ok in checks.items() if ok is False]
    open_ = (["the record has no title"] if not title else ["the page has no title to compare"] if score is None else []) + (["the page has no authors to compare"] if names and checks["author"] is None else [])
    status = "possible_mismatch" if conflicts else "insufficient_metadata" if open_ else "matched"
    return {"title_score": score, **{f"{k}_match": checks[k] for k in ("author", "year", "doi")}, "status": status, "message": "; ".join(conflicts or open_)}


def _bare_doi(text: str) -> str:
    """A DOI of a page's metadata, folded; blank if it is none."""
    found = re.fullmatch(r"(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{4,9}/.*?)[.,; ]*", text.strip().casefold())
    return found[1] if found else ""


_IDENTITY = T.StructType([T.StructField("title_score", T.DoubleType()), *(T.StructField(n, T.BooleanType()) for n in ("author_match", "year_match", "doi_match")), T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])


@F.pandas_udf(_IDENTITY)
def _identity(title: pd.Series, names: pd.Series, year: pd.Series, doi: pd.Series, page: pd.DataFrame) -> pd.DataFrame:
    rows = [identity(t or "", list(n if n is not None else ()), y or "", d or "", {k: (list(v) if hasattr(v, "tolist") else v) for k, v in p.items()}) for t, n, y, d, p in zip(title, names, year, doi, page.to_dict("records"), strict=True)]
    return pd.DataFrame(rows, columns=_IDENTITY.names).astype({n: "boolean" for n in ("author_match", "year_match", "doi_match")})


def assess_identity(title: Column, author: Column, year: Column, doi: Column, page: Column) -> Column:
    """A struct with the check of a page_column() against a record's cells."""
    first_year = F.regexp_extract(F.coalesce(year.cast("string"), F.lit("")), r"\b(?:18|19|20|21)\d{2}\b", 0)
    return _identity(clean(title), surnames(author), first_year, strict_doi(doi), page)


#: Fixed value: the score from which a source's abstract is accepted without the record's DOI.
ACCEPTED = 92.0


def accepted_sources(candidates: DataFrame, records: DataFrame, record: str, doi_column: str = "doi") -> DataFrame:
    """Sources for find_abstracts(): of each source's candidates (record, source, source_rank, cand_pos, doi, score, abstract) the best accepted one.

    One with the record's DOI is accepted, one with another DOI isn't, any other from a score of ACCEPTED on. The DOI
    counts before the score.
    """
    own = records.select(record, F.lower(strict_doi(F.col(doi_column))).alias("__own"))
    theirs = F.lower(strict_doi(F.col("doi")))
    rows = candidates.join(own, record).withColumn("__same", (theirs != "") & (theirs == F.col("__own"))).withColumn("__other", (theirs != "") & (F.col("__own") != "") & (theirs != F.col("__own")))
    fit = rows.where(F.length(F.trim(F.coalesce("abstract", F.lit("")))) >= 40).where(F.col("__same") | (~F.col("__other") & (F.col("score") >= ACCEPTED)))
    best = F.max_by("abstract", F.struct(F.col("__same"), F.col("score"), -F.col("cand_pos")))
    return fit.groupBy(record, "source", "source_rank").agg(best.alias("abstract")).withColumn("accepted", F.lit(True))


def find_abstracts(records: DataFrame, record: str, abstract: str, cached: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """The abstract of each record with where it comes from: its own, a cache, a source (first by rank), its page.

    Each step joins only what the steps before left, so pages are read for the rest alone. `cached` has record and
    abstract, `sources` record, source, source_rank, accepted and abstract, `pages` record and html.
    """
    from recordloom.functions.pages import page_column

    own = records.where(clean(F.col(abstract)) != "").select(record, clean(F.col(abstract)).alias("abstract"), F.lit("existing").alias("origin"))
    rest = records.select(record).join(own, record, "left_anti")
    hit = rest.join(cached.where(clean(F.col("abstract")) != ""), record).groupBy(record).agg(F.min("abstract").alias("abstract")).withColumn("origin", F.lit("cache"))
    rest = rest.join(hit, record, "left_anti")
    best = sources.where("accepted").where(F.length("abstract") >= 40).groupBy(record).agg(F.min_by(F.struct("abstract", F.col("source").alias("origin")), "source_rank").alias("b"))
    sourced = rest.join(best, record).select(record, "b.abstract", "b.origin")
    rest = rest.join(sourced, record, "left_anti")
    read = rest.join(pages, record).withColumn("p", page_column(F.col("html"))).where("p.abstract <> ''").groupBy(record).agg(F.min(F.struct(F.col("p.abstract").alias("abstract"), F.col("p.abstract_source").alias("origin"))).alias("b")).select(record, "b.abstract", "b.origin")
    found = own.unionByName(hit).unionByName(sourced).unionByName(read)
    return records.select(record).join(found, record, "left").select(record, F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("origin", F.lit("no_abstract_found")).alias("origin"))


def fetched_abstracts(asked: DataFrame, record: str, url: str, pages: DataFrame) -> DataFrame:
    """record, abstract, origin and status of each asked URL's stored page (url, http_status, html).

    Pages meet URLs by their canonical forms. abstract_found, no_abstract_found, or fetch_failed without a page or with
    a status of 400 and more; of a page's repeated rows the least counts.
    """
    from recordloom.functions.identifiers import canonical_url
    from recordloom.functions.pages import page_column

    key = canonical_url(F.col("url"))
    stored = pages.where(key != "").groupBy(key.alias("__key")).agg(F.min(F.struct("http_status", "html")).alias("__p"))
    rows = asked.select(record, F.nullif(canonical_url(F.col(url)), F.lit("")).alias("__key")).join(stored, "__key", "left")
    lost = F.col("__p").isNull() | (F.coalesce(F.col("__p.http_status"), F.lit(0)) >= 400)
    read = rows.withColumn("__lost", lost).withColumn("__r", page_column(F.when(~F.col("__lost"), F.col("__p.html"))))
    has = ~F.col("__lost") & (F.col("__r.abstract") != "")
    return read.select(record, F.when(has, F.col("__r.abstract")).otherwise("").alias("abstract"), F.when(has, F.col("__r.abstract_source")).otherwise("").alias("origin"), F.when(F.col("__lost"), "fetch_failed").when(has, "abstract_found").otherwise("no_abstract_found").alias("status"))
