"""Stored answers of each source, in the shapes that the services document."""

import json

import pytest

from recordloom.sources import candidates, catalogues

DC = "<searchRetrieveResponse xmlns='http://www.loc.gov/zing/srw/'><records><record><recordData><x:dc xmlns:x='http://x' xmlns:d='http://purl.org/dc/elements/1.1/'>{}</x:dc></recordData><recordIdentifier>991</recordIdentifier></record></records></searchRetrieveResponse>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom' xmlns:a='http://arxiv.org/schemas/atom'><entry><id>http://arxiv.org/abs/1</id><title>A\n title</title><summary> Sum </summary><published>2003-01-02</published><author><name>Jane Doe</name></author><a:doi>10.1/x</a:doi></entry><entry><title/></entry></feed>"
#: source: (payload, (title, doi, url, reference only, authors, year, abstract) of each candidate)
ANSWERS = {
    "crossref": ({"message": {"items": [{"title": ["A", "title"], "DOI": "10.1/x", "author": [{"family": "Doe"}, {"name": "Team"}], "issued": {"date-parts": [[2001, 2]]}, "abstract": "<p>x</p>"}]}}, [("A title", "10.1/x", "https://doi.org/10.1/x", False, ["Doe"], 2001, "<p>x</p>")]),
    "openalex": ({"results": [{"title": "T", "id": "https://openalex.org/W1", "publication_year": 2004, "authorships": [{"author": {"display_name": "Jane Doe"}}], "abstract_inverted_index": {"a": [1], "b": [0, 2]}}, {"title": "U", "doi": "https://doi.org/10.1/x"}]}, [("T", "", "https://openalex.org/W1", True, ["Doe"], 2004, "b a b"), ("U", "10.1/x", "https://doi.org/10.1/x", False, [], None, "")]),
    "datacite": ({"data": [{"attributes": {"titles": [{"title": "T"}, {"title": "Other"}], "doi": "10.1/d", "creators": [{"familyName": "Doe"}, {"name": "Max Roe"}], "publicationYear": 2005, "descriptions": [{"descriptionType": "Other", "description": "no"}, {"descriptionType": "Abstract", "description": "yes"}]}}]}, [("T", "10.1/d", "https://doi.org/10.1/d", False, ["Doe", "Roe"], 2005, "yes")]),
    "semantic_scholar": ({"data": [{"title": "T", "externalIds": None, "openAccessPdf": {"url": "http://p"}, "url": "http://s", "authors": [{"name": "Jane Doe"}], "year": 2001}, {"title": None}, {"title": "U", "openAccessPdf": None, "url": "http://s"}]}, [("T", "", "http://p", False, ["Doe"], 2001, ""), ("U", "", "http://s", False, [], None, "")]),
    "gesis": ({"results": {"bindings": [{"id": {"value": "http://id"}, "title": {"value": "T"}, "names": {"value": "Doe|Roe"}, "investigators": {"value": "Poe"}, "date": {"value": "2009-01"}}, {"id": {"value": "i"}, "title": {"value": "U"}, "doi": {"value": "https://doi.org/10.4232/1"}}]}}, [("T", "", "http://id", True, ["Doe", "Roe", "Poe"], 2009, ""), ("U", "10.4232/1", "https://doi.org/10.4232/1", False, [], None, "")]),
    "core": ({"results": [{"title": "T", "doi": None, "downloadUrl": "", "sourceFulltextUrls": ["http://f"], "authors": [{"name": "J Doe"}, "Max Roe"], "yearPublished": 2001}, {"title": "U", "id": 7}]}, [("T", "", "http://f", False, ["Doe", "Roe"], 2001, ""), ("U", "", "7", True, [], None, "")]),
    "openaire": ({"results": [{"mainTitle": "T", "pids": [{"scheme": "handle", "value": "1/2"}, {"scheme": "DOI", "value": "10.1/o"}], "instances": [{"urls": ["http://l"]}], "authors": [{"fullName": "Jane Doe"}], "publicationDate": "2010-05-01", "descriptions": ["d1", "d2"]}]}, [("T", "10.1/o", "https://doi.org/10.1/o", False, ["Doe"], 2010, "d1")]),
    "dnb": (DC.format("<d:title>T</d:title><d:creator>Doe, Jane [Verfasser]</d:creator><d:creator>Max Roe</d:creator><d:date>[1999]</d:date><d:identifier type='idn'>123456789</d:identifier><d:description>one</d:description><d:description>two</d:description>"), [("T", "", "https://d-nb.info/123456789", False, ["Doe", "Roe"], 1999, "one two")]),
    "hal": ({"response": {"docs": [{"title_s": ["T", "V"], "authFullName_s": ["Jane Doe"], "producedDate_s": "2011", "uri_s": "https://hal/1", "abstract_s": ["a", "b"]}]}}, [("T", "", "https://hal/1", False, ["Doe"], 2011, "a b")]),
    "cinii": ({"@graph": [{"@id": "https://cir/1", "dc:title": "T", "dc:creator": "Doe Jane", "prism:publicationDate": "2012-03"}]}, [("T", "", "https://cir/1", False, ["Doe Jane"], 2012, "")]),
    "swisscovery": (DC.format("<d:title>T</d:title><d:identifier>https://doi.org/10.1/s</d:identifier>"), [("T", "10.1/s", "https://doi.org/10.1/s", False, [], None, "")]),
    "libris": ({"xsearch": {"list": [{"title": "T", "creator": "Doe, Jane, 1950-", "date": ["2013"], "identifier": "http://libris/1"}]}}, [("T", "", "http://libris/1", False, ["Doe"], 2013, "")]),
    "doaj": ({"results": [{"bibjson": {"title": "T", "author": [{"name": "Jane Doe"}], "identifier": [{"type": "eissn", "id": "1"}, {"type": "DOI", "id": "10.1/j"}], "link": [{"url": "http://j"}], "year": "2014", "abstract": "abs"}}]}, [("T", "10.1/j", "https://doi.org/10.1/j", False, ["Doe"], 2014, "abs")]),
    "europepmc": ({"resultList": {"result": [{"title": "T", "authorList": {"author": [{"lastName": "Doe"}, {"fullName": "The Group"}]}, "pubYear": "2015", "fullTextUrlList": {"fullTextUrl": [{"url": "http://e"}]}}]}}, [("T", "", "http://e", False, ["Doe", "The Group"], 2015, "")]),
    "google_books": ({"items": [{"volumeInfo": {"title": "T", "subtitle": "S", "authors": ["Jane Doe"], "publishedDate": "2016-01", "infoLink": "http://g"}}]}, [("T: S", "", "http://g", False, ["Doe"], 2016, "")]),
    "lens": ({"data": [{"title": "T", "authors": [{"last_name": "Doe"}], "external_ids": [{"type": "pmid", "value": "1"}], "open_access": {"locations": [{"pdf_urls": ["http://p"]}]}, "year_published": 2017}]}, [("T", "", "http://p", False, ["Doe"], 2017, "")]),
    "arxiv": (ATOM, [("A title", "10.1/x", "https://doi.org/10.1/x", False, ["Doe"], 2003, "Sum")]),
    "pubmed": ({"records": [{"title": "T", "uid": "5", "authors": [{"name": "Doe J"}], "pubdate": "2018 Mar", "articleids": [{"idtype": "pii", "value": "x"}], "abstract": "a"}]}, [("T", "", "https://pubmed.ncbi.nlm.nih.gov/5/", False, ["Doe"], 2018, "a")]),
}


@pytest.mark.parametrize("source", sorted(catalogues.SOURCES))
def test_stored_answers(source):
    payload, want = ANSWERS[source]
    found = list(catalogues.candidates(source, payload if isinstance(payload, str) else json.dumps(payload)))
    assert [tuple(x[k] for k in ("title", "doi", "url", "url_is_reference_only", "authors", "year", "abstract")) for x in found] == want
    assert list(catalogues.candidates(source, "<feed/>" if catalogues.SOURCES[source].xml else "{}")) == []


def test_all_sources_as_a_relation(spark):
    rows = [("r", s, p if isinstance(p, str) else json.dumps(p)) for s, (p, _) in ANSWERS.items()] + [("r", "crossref", None)]
    found = candidates.parse_payloads(spark.createDataFrame(rows, "record string, source string, payload string")).collect()
    assert len(found) == sum(len(w) for _, w in ANSWERS.values()) and {r.source for r in found} == set(catalogues.SOURCES)


@pytest.mark.parametrize("source", sorted(catalogues.SOURCES))
def test_requests(source):
    asked = catalogues.request(source, 'A "long" title [sic] of words', "Doe", keys={"core": "k", "lens": "k", "semantic_scholar": "k"}, mail="a@b.c")
    text = json.dumps([asked.url, asked.params, asked.headers, asked.body])
    assert asked.url.startswith("http") and "title" in text and ("Doe" in text) == (source not in ("openalex", "gesis"))
    assert (asked.body is not None) == (source == "lens")
    if source in catalogues.KEYED:
        assert catalogues.request(source, "T") is None and catalogues.ask(source, lambda r: 1 / 0, "T") == (None, None)


def test_steps_and_errors():
    answers = {"esearch": {"esearchresult": {"idlist": ["5", "6"]}}, "esummary": {"result": {"uids": ["5", "6"], "5": {"title": "T"}, "6": {"title": "U"}}}}
    xml = "<S><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Abstract><AbstractText Label='AIM'>x <i>y</i></AbstractText><AbstractText>z</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>"

    def http(request):
        step = request.url.rsplit("/", 1)[1].split(".")[0]
        return (json.dumps(answers[step]).encode(), None) if step in answers else (xml.encode(), None)

    payload, error = catalogues.ask("pubmed", http, "A title")
    assert error is None and [(x["title"], x["abstract"]) for x in catalogues.candidates("pubmed", payload)] == [("T", "AIM: x y z"), ("U", "")]
    broken = lambda r: (None, "HTTP 500") if "efetch" in r.url else http(r)
    assert [x["abstract"] for x in catalogues.candidates("pubmed", catalogues.ask("pubmed", broken, "A title")[0])] == ["", ""]
    assert catalogues.ask("doaj", lambda r: (None, "HTTP 503"), "T") == (None, "HTTP 503")
    assert catalogues.ask("pubmed", lambda r: (b"<html>", None), "T")[1] and catalogues.request("gesis", "a of to") is None


def test_attempts_end_at_once_without_a_budget():
    told, waits = [], []
    limiter = candidates.Limiter(0, clock=lambda: 0.0, sleep=waits.append)
    answers = iter([(500, None, b""), (429, "2", b""), (200, None, b"ok")])
    assert candidates.with_retry(lambda: next(answers), limiter, tell=told.append) == (b"ok", None) and len(told) == 2
    assert candidates.with_retry(lambda: (429, None, b"", "0"), limiter, tell=told.append)[1].endswith("used up") and len(told) == 3
    assert candidates.with_retry(lambda: (501, None, b""), limiter) == (None, "HTTP 501")


def test_pages_are_fetched_with_care():
    resolve = lambda host: ["10.0.0.1" if host == "inside" else "8.8.8.8"]
    pages = {"http://a/": (302, {"Location": "/b"}, []), "http://a/b": (200, {}, [b"x" * 10, b"y"]), "http://c/": (301, {"location": "http://inside/"}, []), "http://d/": (302, {"location": "http://d/"}, [])}
    get = lambda url: (pages[url][0], pages[url][1], iter(pages[url][2]))
    assert candidates.safe_get("http://a/", get, resolve=resolve) == (200, "http://a/b", b"x" * 10 + b"y")
    for url, limit in (("http://a/", 10), ("http://c/", 100), ("http://d/", 100), ("ftp://a/", 100)):
        with pytest.raises(ValueError):
            candidates.safe_get(url, get, limit, resolve=resolve)


def test_abstract_payloads():
    long = "An abstract that is long enough to be used here, surely."
    assert catalogues.abstract_text(f"<p>{long}</p>") == f"<p>{long}</p>" and catalogues.abstract_text("short") == ""
    assert catalogues.abstract_text([long, "b"]) == f"{long} b" and catalogues.abstract_text({"value": long}) == long and catalogues.abstract_text([{"text": long}, None]) == long
    assert catalogues.abstract_text(None) == "" and catalogues.abstract_text({}) == ""
