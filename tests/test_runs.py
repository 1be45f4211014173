import pytest
from pyspark.sql import functions as F

from recordloom.functions import cells, pages
from recordloom.operators import compare, evaluate, notes, profile, resolve, runs, tagging
from recordloom.sources import records


def test_settings_are_merged(tmp_path, spark):
    path = f"{tmp_path}/a/settings.json"
    assert runs.load_settings(path) == {} and runs.save_settings(path, {"x": 1, "y": "é"}) == {"x": 1, "y": "é"}
    assert runs.save_settings(path, {"x": 2}) == {"x": 2, "y": "é"} == runs.load_settings(path)
    open(path, "w").write("[1]")
    assert runs.load_settings(path) == {} and runs.data_file(spark, "a.json").endswith("/.recordloom/a.json")


def test_journals_and_snapshots(tmp_path, spark):
    (tmp_path / "j.jsonl").write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2\n\n{"k": "c", "n": 3}\n')
    entries = runs.read_journal(spark, f"{tmp_path}/j.jsonl", "k string, n int")
    assert sorted((r.k, r.n) for r in entries.collect()) == [("a", 1), ("c", 3)]
    path = f"{tmp_path}/s"
    runs.write_snapshot(entries, path)
    for _ in range(2):
        now = spark.read.parquet(path)
        runs.write_snapshot(now.withColumn("n", F.col("n") + 1), path)  # reads what it replaces
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [3, 5] and [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["s"]


def test_converting_and_exporting(tmp_path, spark):
    df = spark.createDataFrame([("A", "2001", "x"), ("B", "2002", "")], "Title string, Year string, Own string")
    assert runs.convert(df, f"{tmp_path}/o", "ris", ["Title", "Own"], [("Year", "equals", "2001", "")]) == (1, ["Title"])
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("part-*"))
    assert "TI  - A" in text and "Own = " in text
    with pytest.raises(ValueError):
        runs.convert(df, f"{tmp_path}/p", "ris", [])
    with pytest.raises(ValueError):
        runs.convert(df, f"{tmp_path}/p", "docx", ["Title"])
    (tmp_path / "r.ris").write_text("TY  - JOUR\nTI  - A\nXX  - kept\nER  - \n\n")
    old = records.read_records(spark, f"{tmp_path}/r.ris")
    assert runs.export(old.withColumn("Title", F.lit("C")), f"{tmp_path}/r.ris", f"{tmp_path}/x") == "patched"
    assert "XX  - kept" in "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert runs.export(old.union(old), f"{tmp_path}/r.ris", f"{tmp_path}/y") == "rewritten"


def test_previews_samples_and_fields(spark):
    df = spark.range(20_000).withColumns({"title": F.lit("t"), "author": F.lit("a"), "year": F.lit("y")})
    assert runs.preview(df).count() == 250
    one, two = (sorted(r.id for r in runs.sampled(df.repartition(n), "id", 0.1, 3).collect()) for n in (2, 7))
    assert one == two and abs(len(one) - 2000) < 200 and one != sorted(r.id for r in runs.sampled(df, "id", 0.1, 4).collect())
    row = runs.select_fields(df, ["title", "author", "year"], ["year"]).first()
    assert (row.title, row.author, row.year) == ("t", "", "y") and runs.select_fields(df, ["title", "author", "year"]).first().author == "a"


def test_progress_and_cancelling(spark):
    times = iter([0.0, 10.0, 20.0])
    progress = runs.Progress(100, clock=lambda: next(times))
    assert progress.add(20) == "20 of 100, 2.0 a second, 0:00:40 left" and progress.add(60).endswith("0:00:05 left")
    assert runs.duration(3725.4) == "1:02:05"
    with runs.cancellable(spark, "job"):
        assert "job" in spark.getTags()
    assert "job" not in spark.getTags()
    work, done = spark.range(4), spark.createDataFrame([(1, "ok")], "id long, status string")
    assert sorted((r.id, r.status) for r in runs.cancelled(work, done, "id").collect()) == [(0, "cancelled"), (1, "ok"), (2, "cancelled"), (3, "cancelled")]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tags_and_languages(spark):
    lit = F.lit
    rule = lambda t: cells.names_country(t, ("Germany", "South Africa"), ("US",))
    kept, gone = cells.keep_tags(F.array(*map(lit, ["germany west", "US", "us", "Germanys", "x South Africa y"])), rule)
    row = one(spark, kept.alias("k"), gone.alias("g"), cells.replace_tags(lit("A; DATA - X; B"), lambda t: t.startswith("DATA - "), cells.country_tags(F.array(lit("Y"), lit("Z")))).alias("r"), cells.non_blank_places(F.array(lit("a"), lit(" "), lit(None), lit("b"))).alias("p"), cells.language_code(lit("DE-at")).alias("c"), cells.language_label(lit("pt_BR")).alias("l"), cells.language_label(lit("xx")).alias("x"), resolve.source_label(lit("openalex")).alias("s"), resolve.source_label(lit("crossref")).alias("t"))
    assert row.k == ["germany west", "US", "x South Africa y"] and row.g == ["us", "Germanys"]
    assert (row.r, row.p, row.c, row.l, row.x, row.s, row.t) == ("A; B; DATA - Y; DATA - Z", [0, 3], "de", "Portuguese", "xx", "OpenAlex", "Crossref")


def test_evaluation_against_a_gold_table(spark):
    gold = spark.createDataFrame([("10.1234/a", "t", "X; Y; other"), ("", "Same title", "X"), ("10.1234/b", "u", "other"), ("10.1234/c", "v", "Y"), ("10.1234/d", "w", "Y"), ("10.1234/d", "w", "Y")], "doi string, title string, kw string")
    found = spark.createDataFrame([("https://doi.org/10.1234/a", "", "X; Z"), ("", "same  TITLE", "X"), ("10.1234/z", "", "Y")], "d string, t string, tags string")
    both, counts = evaluate.against_gold(gold, found, {"doi": ("doi", "d"), "title": ("title", "t")}, "kw", ("X", "Y", "Z"), "tags")
    assert {(tuple(r.gold), tuple(r.predicted)) for r in both.collect()} == {(("X", "Y"), ("X", "Z")), (("X",), ("X",))}
    assert tuple(counts.first()) == (2, 1, 1)
    row = one(spark, evaluate.gold_countries(F.lit("Germany--West; usa; x"), {"germany": "Germany", "USA": "United States"}).alias("c"))
    assert row.c == ["Germany", "United States"]
    runs_ = spark.createDataFrame([(["X"], ["X", "Y"], ["high", "low"], True, ["DE"], ["DE"]), (["Y"], [], [], False, [], ["FR"])], "g array<string>, p array<string>, c array<string>, a boolean, gp array<string>, pp array<string>")
    rows = {r.subset: r for r in evaluate.blind_run(runs_, "g", "p", "c", F.col("a"), "gp", "pp").collect()}
    assert {k: (r.records, r.tp, r.fp, r.fn) for k, r in rows.items()} == {"all": (2, 1, 1, 1), "with_abstract": (1, 1, 1, 0), "without_abstract": (1, 0, 0, 1), "high_only": (2, 1, 0, 1), "countries": (1, 1, 0, 0)}


def test_titles_are_decoded_once(spark):
    assert pages.read_page("<title>R&amp;amp;D &amp;copy; x&amp</title>")["title"] == "R&amp;D &copy; x&"
    html = F.lit("<title>R&amp;D &amp&amp;amp; &#38; & &quot</title><h1>x</h1>")
    assert one(spark, pages.page_column(pages.whole_references(html)).alias("p")).p.title == "R&D &amp&amp; & & &quot"


def test_queries_of_pages_whose_titles_are_cut_in_a_reference(spark, tmp_path):
    from recordloom.plans import registry
    from tests.oracle import TABLES, same

    heads = ["One two three four five six seven eight&amp;&amp", "Nine ten eleven twelve thirteen&quot", 'token = "5aa25d7d3a0abd29707cad02273"', "plain words"]
    rows = [(i, f"http://h.org/{i}", f"<html><head><title>{heads[i % 4]}</title></head><body><h1>{heads[i % 4]}</h1><p>text") for i in range(24)]
    for name in TABLES:
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("page_titles", "page_evidence"):
        same(spark, str(tmp_path), registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_query_of_pages_whose_headings_stand_late(spark, tmp_path):
    from recordloom.plans import page_queries, registry
    from tests.oracle import TABLES, same

    late = "<html><body><p>" + "a line of no matter. " * 20_000 + "</p><h1>One two three four five six seven eight nine</h1><p>text"
    rows = [(i, f"http://h.org/{i}", late) for i in (0, 2, 3, 5, 6, 8)]
    for name in TABLES:
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    same(spark, str(tmp_path), page_queries.page_evidence, registry.ORACLE_SQL["page_evidence"])


def test_pages_of_publications(spark):
    html = "<meta name=citation_title content='A found title of words'><meta name=citation_author content='Doe, J'><meta name=citation_date content='2003/1'><meta name=citation_journal_title content=J><meta name=citation_firstpage content=1><meta name=citation_lastpage content=9><meta name=citation_doi content='10.1/x'><p>A found title of words by Doe"
    found = pages.page_candidate(html, "http://p")
    assert (found["title"], found["years"], found["journal"], found["pages"], found["doi"], found["publisher"]) == ("A found title of words", [2003], "J", "1-9", "10.1/x", "")
    assert pages.page_evidence("A found title of words", ["Doe"], [("a", "<p>nothing"), ("b", html)]) == "b" and pages.page_evidence("A found title of words", ["Doe"], []) is None
    assert pages.document_match("A found title", ["Poe", "Doe"], "2003", "by doe (2003): a found title") == {"title": True, "author": True, "year": True}
    assert not any(pages.document_match("Other thing", ["Poe"], "2004", "by doe 12003").values())
    assert [r.e for r in spark.createDataFrame([("A found title of words", ["Doe"], html), (None, None, None)], "t string, n array<string>, h string").select(pages.evidence_column(F.col("t"), F.col("n"), F.col("h")).alias("e")).collect()] == [True, False]


def test_counters_and_sets(spark):
    before = spark.createDataFrame([(1, "see http://x.org/a.", "", ""), (2, "http://x.org/b http://x.org/c", "http://x.org/b", ""), (3, "", "", "10.1/x")], "i int, note string, url string, doi string")
    after = notes.recover_links(before, "note", "url", "doi", remove=True)
    row = notes.recovery_counters(before, after, "i", "note", "url", "doi").first()
    assert (row.records, row.urls_found, row.notes_with_url, row.notes_with_several, row.links_added, row.links_removed, row.notes_cleaned) == (3, 3, 2, 1, 1, 2, 2) and len(row) == 15
    sets = compare.key_sets(before.selectExpr("i AS k"), spark.createDataFrame([(2,), (2,), (9,), (None,)], "k int"), "k")
    assert sorted((r.key, r.found) for r in sets.collect()) == [(1, "only A"), (2, "both"), (3, "only A"), (9, "only B")]
    table = profile.cross_table(spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("a", "y")], "r string, c string"), "r", "c", "categorical", "categorical")
    assert [tuple(r) for r in profile.sparse_rows(table).collect()] == [("b", "x", 2), ("a", "x", 1), ("a", "y", 1)]
    assert [r.x for r in spark.createDataFrame([("one two " * 8,), ("<b>x</b> " * 20,), (None,)], "t string").select(tagging.readable_column(F.col("t")).alias("x")).collect()] == [True, False, False]


def test_secondary_sources_and_abstracts(spark):
    own = spark.createDataFrame([(1, "10.1234/a", ""), (2, "", "http://h.org/x/"), (3, "", "")], "i int, doi string, url string")
    found = spark.createDataFrame([(1, "https://doi.org/10.1234/A", "", 90.0, True), (1, "10.1234/b", "", 90.0, False), (2, "", "http://H.org/x?q", 90.0, False), (3, "", "", 90.0, False)], "i int, doi string, url string, total double, conflict boolean")
    assert sorted((r.i, r.total) for r in resolve.same_identifier(found, own, "i").collect()) == [(1, 74.0), (2, 90.0)]
    long = "x" * 50
    offers = spark.createDataFrame([(1, "s", 1, 0, "10.1234/a", 10.0, "A" + long), (1, "s", 1, 1, "", 99.0, "B" + long), (1, "t", 2, 0, "10.1234/z", 99.0, "C" + long), (2, "s", 1, 0, "10.1234/z", 92.0, "D" + long), (3, "s", 1, 0, "", 91.9, "E" + long), (3, "t", 2, 0, "", 95.0, "short")], "i int, source string, source_rank int, cand_pos int, doi string, score double, abstract string")
    assert sorted((r.i, r.source, r.abstract[0], r.accepted) for r in notes.accepted_sources(offers, own, "i").collect()) == [(1, "s", "A", True), (2, "s", "D", True)]


def test_translating_what_a_memory_lacks(spark):
    from recordloom.operators import state
    from recordloom.sources.translators import TranslationError

    def service(texts):
        if "stop" in texts:
            raise TranslationError("the quota is used up", [t.upper() for t in texts[: texts.index("stop")]])
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("b [B]",), ("known",), ("",), ("stop",), ("a",)], "t string")
    rows = {r.text: (r.translated, r.error) for r in state.translated(df, "t", spark.createDataFrame([("known", "x")], "text string, translated string"), service, batch=1).collect()}
    assert rows == {"a": ("A", None), "b": ("B", None), "stop": (None, "the quota is used up")}


def test_other_versions_and_older_names():
    from recordloom.sources import formats

    assert pages.alternates("<a hreflang=en href='/en'>", "https://www.jstage.jst.go.jp/a/-char/ja/b") == ["https://www.jstage.jst.go.jp/a/-char/en/b", "https://www.jstage.jst.go.jp/en"]
    note = formats.carried_line("Old name", "x")
    assert formats.restore_carried({"Notes": f"keep\n{note}"}, renamed={"Old name": "New"}) == {"Notes": "keep", "New": "x"}
