import json

import pytest
from pyspark.sql import functions as F

from recordloom.functions import cells
from recordloom.operators import notes, semantic
from recordloom.sources import records, sheets, translators

SHARED = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Title</t></si><si><r><t>Two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>"""


def test_workbooks_round_trip(spark, tmp_path):
    rows = [["a <&> b", "é\n中", ""], ["", "", "x"], ["\x00ctl", "1.0", None]]
    got = list(sheets.read_rows(sheets.write_table(["T", "U", "V"], rows)))
    assert got == [["T", "U", "V"], ["a <&> b", "é\n中"], ["", "", "x"], ["ctl", "1.0"]]
    assert [sheets.column_number(sheets.column_name(i)) for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702] and sheets.column_name(702) == "AAA"
    df = spark.createDataFrame([(i, f"t{i}", None if i % 2 else "x") for i in range(25)], f"{records.ROW} long, Title string, Note string")
    records.write_records(df, f"{tmp_path}/out", "excel")
    back = records.read_records(spark, f"{tmp_path}/out/*.xlsx")
    assert [(r[records.ROW], r.Title, r.Note) for r in back.orderBy(records.ROW).collect()] == [(i, f"t{i}", "" if i % 2 else "x") for i in range(25)]


def test_workbooks_of_other_programs():
    import io
    import zipfile

    data = sheets.write_table(["x"], [])
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="str"><v>Title</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1999.0</v></c><c r="C2" t="b"><v>1</v></c></row><row/></sheetData></worksheet>"""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, sheet if "sheet1" in name else old.read(name))
        new.writestr("xl/sharedStrings.xml", SHARED)
    assert list(sheets.read_table(out.getvalue())) == [{"Title": "Two runs", "Unnamed: 1": "1999", "Title.1": "TRUE"}]


def test_translation_services():
    asked = []

    def http(url, params, headers, body):
        asked.append((url, params, headers, body))
        if "microsoft" in url:
            return 200, json.dumps([{"translations": [{"text": x["text"].upper()}]} for x in body]).encode()
        if "deepl" in url:
            return (456, b"") if len(asked) > 3 else (200, json.dumps({"translations": [{"text": t[::-1]} for t in body["text"]]}).encode())
        text = params["q"]
        return 200, json.dumps({"responseStatus": 200, "responseData": {"translatedText": f"<{text}>"}} if "stop" not in text else {"responseStatus": "429", "responseData": {"translatedText": "YOU USED ALL AVAILABLE FREE TRANSLATIONS FOR TODAY. NEXT AVAILABLE IN 05 HOURS 10 MINUTES"}}).encode()

    assert translators.translate(["a", None, " ", "b"], "en", "azure", http, "k", "r") == ["A", "", " ", "B"] and asked[0][2]["Ocp-Apim-Subscription-Region"] == "r"
    with pytest.raises(translators.TranslationError) as refused:
        translators.translate(["ab", "cd", "ef", "gh"], "en", "deepl", http, "k:fx", batch=1)
    assert refused.value.done == ["ba", "dc"] and "quota" in str(refused.value) and "api-free" in asked[1][0]
    with pytest.raises(translators.TranslationError, match="renewed in 05 h 10 min; an e-mail"):
        translators.translate(["fine", "stop"], "de", "mymemory", http)
    assert translators.translate(["One. " + "w" * 600], "de", "mymemory", http, "a@b.c")[0].startswith("<One.>")
    assert translators.quota_message("ok") is None
    with pytest.raises(ValueError):
        translators.translate([], "en", "x", http)
    stats = translators.Stats(3)
    stats.add("translated", 2)
    stats.add("empty")
    assert list(stats.lines("T")) == ["T: 3 rows", "  empty: 1", "  translated: 2"]


def test_languages_of_texts(spark):
    texts = {"The aim of the work is to show that": "en", "Die Arbeit ist nicht für den Zweck": "de", "Les travaux de la ville et des pays": "fr", "El trabajo de los años y las vidas": "es", "xq zz": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.l for r in df.select("t", cells.language_of(F.col("t")).alias("l")).collect()} == texts


def test_stored_pages_give_abstracts(spark):
    long = "An abstract that is long enough to count as one here."
    stored = spark.createDataFrame([("http://H.org/a/?x=1", 200, f"<meta name=description content='{long}'>"), ("http://h.org/b", 200, "<p>x"), ("http://h.org/c", 404, f"<meta name=description content='{long}'>"), ("http://h.org/b", 200, "<p>y"), ("", 200, "z")], "url string, http_status int, html string")
    asked = spark.createDataFrame([(1, "http://h.org/a"), (2, "http://h.org/b"), (3, "http://h.org/c"), (4, "http://h.org/d"), (5, None)], "i int, link string")
    rows = {r.i: (r.status, r.abstract) for r in notes.fetched_abstracts(asked, "i", "link", stored).collect()}
    assert rows == {1: ("abstract_found", long), 2: ("no_abstract_found", ""), 3: ("fetch_failed", ""), 4: ("fetch_failed", ""), 5: ("fetch_failed", "")}


def test_models_and_missing_models(spark):
    df = spark.createDataFrame([([1.0, 0.0], "a"), ([0.0, 1.0], "a")], "v array<double>, gold string")
    topics = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "topic string, topic_vector array<double>")
    found = semantic.optional_nearest(df, "v", topics)
    assert semantic.optional_nearest(df, "v", None).select("accepted", "topic").distinct().collect()[0].accepted is False
    rows = {r.model: r.top1 for r in semantic.compare_models({"one": found, "two": found.where("topic = 'a'")}, "gold").collect()}
    assert rows == {"one": 0.5, "two": 1.0}
