import json

import pytest
from pyspark.sql import functions as F

from recordloom.functions import studies
from recordloom.operators import filters, verify
from recordloom.sources import registries


def test_answers_become_records(spark):
    full = {"message": {"DOI": "10.1/A", "URL": "http://x", "title": ["Main", "other"], "subtitle": ["Sub"], "author": [{"family": "Roe"}, {"name": "Group"}, {"family": ""}], "published-print": {"date-parts": [[2001, 2]]}, "published-online": {"date-parts": [[2000]]}, "issued": {"date-parts": [[2001]]}, "type": "book", "container-title": ["J"], "publisher": "P", "volume": "1", "issue": "2", "page": "3-4", "ISBN": ["1", "2"], "ISSN": ["3"]}}
    bare = {"message": {"title": [], "subtitle": ["Only sub"], "published-print": {"date-parts": [[None]]}}}
    dataset = {"data": {"attributes": {"doi": "10.2/b", "titles": [{"title": "Data"}], "creators": [{"familyName": "Doe", "name": "Doe, J."}, {"name": "Lab"}], "publicationYear": 1999, "types": {"resourceTypeGeneral": "Dataset"}, "publisher": "Q"}}}
    rows = [("crossref", "10.1/a", json.dumps(full)), ("crossref", "10.1/c", json.dumps(bare)), ("datacite", "10.2/b", json.dumps(dataset)), ("datacite", "10.2/e", json.dumps({"data": {"attributes": {}}})), ("crossref", "10.1/x", None), ("crossref", "10.1/y", "{broken"), ("crossref", "10.1/z", "{}"), ("other", "10.1/a", json.dumps(full))]
    found = {r.doi: r for r in registries.registry_answers(spark.createDataFrame(rows, "registry string, doi string, payload string")).collect()}
    assert set(found) == {"10.1/A", "10.1/c", "10.2/b", "10.2/e"}
    a = found["10.1/A"]
    assert (a.title, a.main_title, a.subtitle, a.authors, a.years, a.isbn, a.issn, a.pages, a.url) == ("Main: Sub", "Main", "Sub", ["Roe"], [2001, 2000], "1;2", "3", "3-4", "http://x")
    assert (found["10.1/c"].title, found["10.1/c"].years, found["10.1/c"].authors, found["10.1/c"].url) == ("Only sub", [], [], "https://doi.org/10.1/c")
    b = found["10.2/b"]
    assert (b.title, b.authors, b.years, b.item_type, b.publisher, b.journal) == ("Data", ["Doe", "Lab"], [1999], "Dataset", "Q", "")
    assert found["10.2/e"].title == "" and found["10.2/e"].years == []
    raw = registries.registry_answers(spark.createDataFrame([*rows, ("datacite", "10.1/A", json.dumps({"data": {"attributes": {"titles": [{"title": "Late"}]}}}))], "registry string, doi string, payload string"))
    assert {r.doi: r.title for r in verify.registry_records(raw, {"crossref": 0, "datacite": 1}).collect()}["10.1/a"] == "Main: Sub"


def test_mentions_of_studies(spark):
    text = "ZA4700, za-04700; ZA 123 and XZA999, ZA123456. 10.4232/1.1 10.4232/1.10 10.4232/1.1. ISSP 1999; the 2004 ISSP. ISSP 1970, ISSP 12 2001"
    row = spark.createDataFrame([(text,), (None,), ("",)], "x string").select(studies.archive_numbers(F.col("x")).alias("n"), studies.dataset_dois(F.col("x")).alias("d"), studies.survey_years(F.col("x"), "ISSP").alias("y")).collect()
    assert row[0] == ([123, 4700], ["10.4232/1.1", "10.4232/1.10"], [1999, 2004]) and row[1] == row[2] == ([], [], [])


def test_operators_by_kind_and_exports(spark):
    df = spark.createDataFrame([("1", "x", "", None), ("2", "y", " ", None), (None, "z", "", None)], "n string, t string, note string, decision string")
    assert filters.operators_for(df, ["n", "t", "note"]) == {"n": (*filters.NUMERIC, "between"), "t": filters.TEXT, "note": filters.TEXT}
    assert filters.filter_by_kind(df, [("n", ">=", "2", "")]).count() == 1 and filters.filter_by_kind(df, []).count() == 3
    for bad, error in ((("n", "contains", "1", ""), ValueError), (("t", ">", "1", ""), ValueError), (("q", ">", "1", ""), KeyError), (("n", ">", "x", ""), ValueError)):
        with pytest.raises(error):
            filters.filter_by_kind(df, [bad])
    assert filters.export_frame(df, review=("note", "decision", "absent")).columns == ["n", "t"]
    noted = df.withColumn("note", F.when(F.col("t") == "z", "seen"))
    assert filters.export_frame(noted, ["t", "note"], ("note",), [("t", "equals", "z", "")]).collect() == [("z", "seen")]
    assert filters.export_frame(noted, ["t", "note"], ("note",), [("t", "equals", "x", "")]).columns == ["t"]
