import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import cells, identifiers, pages, similarity
from recordloom.operators import chunks, compare, evaluate, filters, notes, profile, resolve, schema, semantic, state, tagging, verify
from recordloom.sources import candidates
from recordloom.streaming import resume


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcß中 ", max_size=30), st.text("abcß中 ", max_size=30))
def test_lcs_equals_dynamic_programming(a, b):
    assert similarity.lcs_length(a, b) == dp(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a) <= 100


def test_similarities():
    assert similarity.token_sort_ratio("b a", "a b") == 100 and similarity.ratio("", "") == 100
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.token_set_ratio("a b", "a b c") == 100
    assert similarity.normalize("<i>Mieriņa</i> – “x”") == "mierina - x" and similarity.normalize("が") == "が"
    s = similarity.score("A title", ["Doe"], "2001", "a title", ["doe"], [1990, 2002])
    assert (s["total"], s["author_bonus"], s["author_match"], s["year_bonus"]) == (100, 15, "exact", 10)
    assert similarity.year_bonus("2019.0", [2019]) == (0, None) and similarity.author_bonus(["Li"], ["Liang"])[0] == 8


def test_cells(spark):
    lit = F.lit
    r = one(
        spark, cells.clean(lit("\xa0 a ")).alias("clean"), cells.split_profile(lit("a; b,c;;")).alias("p"), cells.split_profile(lit("a, b")).alias("q"), cells.split_items(lit("a,b;\nc")).alias("i"), cells.split_joined(lit("a; b; a")).alias("j"),
        cells.number(lit("12d")).alias("n"), cells.number(lit(" -1.5e2 ")).alias("m"), cells.number(lit("nan")).alias("nan"), cells.title_key(lit("Straße: É – x")).alias("k"), cells.clean_title(lit("A [b]  c")).alias("t"), cells.surnames(lit("Doe, J; Roe")).alias("s"),
        cells.first_year(lit("c1999, 2001")).alias("y"), cells.item_family(lit("bookSection")).alias("f"), cells.item_family(lit("Journal Article")).alias("g"), cells.title_variants(lit("a b c d; e f g h")).alias("v"), cells.collapse(lit(" 1999.0 ")).alias("c"),
        cells.is_uppercase(lit("2024")).alias("u"), cells.is_uppercase(lit("AB 1")).alias("w"), cells.merge_tags(lit("a, b"), F.array(lit("b"), lit("c"))).alias("mt"), cells.append_missing(lit("a"), lit("b; a; b")).alias("am"),
    )
    assert (r.clean, r.p, r.q, r.i, r.j) == ("a", ["a", "b,c"], ["a", "b"], ["a,b", "c"], ["a", "b"])
    assert (r.n, r.m, r.nan, r.k, r.t, r.s, r.y) == (None, -150.0, None, "strasse x", "A c", ["Doe", "Roe"], 2001)
    assert (r.f, r.g, len(r.v), r.c, r.u, r.w, r.mt, r.am) == ("chapter", "article", 3, "1999", False, True, "a; b; c", "a; b; b")


def test_identifiers(spark):
    r = one(
        spark, identifiers.doi(F.lit("https://dx.doi.org/10.1/Ab).")).alias("d"), identifiers.strict_doi(F.lit("doi: 10.1234/AB.")).alias("s"), identifiers.strict_doi(F.lit("10.1/x")).alias("n"), identifiers.doi_of_url(F.lit("http://doi.org/10.1%2Fx?y")).alias("u"),
        identifiers.match_value(F.lit("DOI:10.5/X")).alias("m"), identifiers.canonical_url(F.lit("HTTP://Ex.org/a%20b/?q#f")).alias("c"), identifiers.urls_in(F.lit("(http://a.org/x_(y)), http://b.org. http://a.org/x_(y)")).alias("x"), identifiers.access_status(F.lit(429)).alias("a"),
        pages.inverted_abstract(F.from_json(F.lit('{"b":[1],"a":[0,2]}'), "map<string,array<int>>")).alias("i"),
    )
    assert (r.d, r.s, r.n, r.u, r.m, r.c) == ("10.1/Ab", "10.1234/ab", "", "10.1/x", "doi:10.5/x", "ex.org/a b")
    assert (r.x, r.a, r.i) == (["http://a.org/x_(y)", "http://b.org"], "rate_limited", "a b a")


def test_filters(spark):
    df = spark.createDataFrame([("5", "A.b"), ("x", " a.B "), (None, None)], "n string, t string")
    count = lambda *c, mode="AND": filters.filter_records(df, list(c), mode).count()
    assert count(("n", "!=", "4", "")) == 1 and count(("t", "contains", ".B", "")) == 2 and count(("t", "is blank", "", "")) == 1
    assert count(("n", ">", "9", ""), ("t", "equals", "a.b", ""), mode="OR") == 2 and count() == 3
    with pytest.raises(KeyError):
        count(("z", "=", "1", ""))
    with pytest.raises(ValueError):
        count(("n", "like", "1", ""))


def test_profile_kinds(spark):
    rows = [(f"t{i}", "a; b" if i % 5 == 0 else "a", str(1990 + i % 20), "", str(i * 1.5), "x" if i % 2 else "y") for i in range(120)]
    got = {r["column"]: (r.kind, r.non_empty, r.unique_values) for r in profile.summarize(spark.createDataFrame(rows, "t string, tags string, y string, e string, n string, c string")).collect()}
    assert got == {"t": ("text", 120, 120), "tags": ("multi_tag", 120, 2), "y": ("year", 120, 20), "e": ("empty", 0, 0), "n": ("numeric", 120, 120), "c": ("categorical", 120, 2)}
    same = profile.histogram(spark.createDataFrame([("3",), ("3",)], "x string"), "x", 4).collect()
    assert sum(r.n for r in same) == 2 and min(r.lower for r in same) == 2.5
    assert profile.histogram(spark.createDataFrame([("z",)], "x string"), "x").count() == 0


def test_greedy_pairs(spark):
    a = spark.createDataFrame([(0, "T", "1"), (1, "t!", None), (2, "T", "2"), (3, "", "1")], "row int, title string, year string")
    b = spark.createDataFrame([(0, "t", "2"), (1, "t", None), (2, "t", "3"), (3, "u", "1")], "row int, title string, year string")
    got = {(r.row_a, r.row_b) for r in compare.match_pairs(a, b, "row", ("title", "title"), [("year", "year")]).collect()}
    assert got == {(0, 1), (1, 0)}
    status = sorted(r.status for r in compare.pair_diff(a, b, "row", ("title", "title"), [("year", "year")], kinds=["text"]).collect())
    assert status == ["Different", "Different", "No title", "Only in B", "Same"]

    extra = compare.pair_diff(a, b, "row", ("title", "title"), [("year", "year")], [("year", "year")], kinds=["text"])
    assert sorted(r.status for r in extra.collect()) == ["Different", "Different", "No title", "Only in A", "Only in B", "Only in B"]


def test_prefix_best_against_a_loop(spark):
    import random

    rng = random.Random(7)
    rows = [(r, s, p, float(rng.choice([60, 74, 75, 80, 91, 92, 95])), rng.random() < 0.4, f"s{s}") for r in range(60) for s in range(4) for p in range(rng.randrange(3))]
    want = {}
    for r in {x[0] for x in rows}:
        pool, best = [], None
        for s in range(4):
            pool += [x for x in rows if x[0] == r and x[1] == s]
            if pool:
                best = max(pool, key=lambda x: (x[3], -x[1], -x[2]))
                if best[3] >= 92 and not best[4]:
                    break
        want[r] = best[1:3]
    df = spark.createDataFrame(rows, "record int, source_rank int, cand_pos int, score double, reference_only boolean, source string")
    assert {x.record: (x.source_rank, x.cand_pos) for x in resolve.best_candidates(df, "record").collect()} == want


def test_evaluation(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], [])], "g array<string>, p array<string>")
    r = evaluate.score_sets(df, "g", "p").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.exact, r.any_hit) == (1, 0, 2, 1.0, 0, 1)
    z = one(spark, evaluate.zipped(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("high")), F.array(F.lit("m"), F.lit("n"))).alias("z")).z
    assert [(x.tag, x.confidence, x.method) for x in z] == [("a", "", "m"), ("b", "", "n")]


VOCABULARY = tagging.Vocabulary(
    names={"religion survey": "RELIG"}, anchored={"environment": "ENV"}, forms={"ENV": "environmental"}, keywords={"HLTH": ("hospital", "doctor")}, phrases={"family": "FAMGEN"},
    countries={"Germany": "Germany", "Guinea": "Guinea", "Papua New Guinea": "Papua New Guinea"}, adjectives={"German": "Germany"}, exact={"US": "USA"},
)


def test_tagging_tiers():
    tags = lambda text, **k: [(x["tag"], x["confidence"], x["method"]) for x in tagging.classify(text, VOCABULARY, **k)]
    assert tags("ZA5800 and ZA0099") == [("HLTH", "high", "archive_number")]
    assert tags("The environment matters. No more.") == [] and tags("The environment module.") == [("ENV", "high", "exact_name")]
    assert tags("An environmental module.") == [("ENV", "medium", "word_form")] and tags("doctor in a hospital", nearest="CIT") == [("HLTH", "medium", "keyword"), ("CIT", "low", "semantic_similarity")]
    assert tags("see 10.4232/1.1234", titles={"10.4232/1.1234": "Family IV"}) == [("FAMGEN", "high", "dataset_doi")]


def test_countries():
    found = lambda t: set(tagging.countries(t, VOCABULARY))
    assert found("We use data from Germany and Papua New Guinea.") == {"Germany", "Papua New Guinea"}
    assert found("German respondents and US data.") == {"Germany", "USA"} and found("German Lopez's survey in us.") == set()
    assert found("Others studied Germany. We collected in 2001.") == set()


def test_tagged_records(spark):
    df = spark.createDataFrame([("A title", "doctor in a hospital " * 5 + ". Sample of Germany.", "x"), ("Only a title", None, None)], "title string, abstract string, tags string")
    rows = tagging.tag_records(df, {"Title": F.col("title"), "Abstract": F.col("abstract")}, {"Abstract"}, VOCABULARY, "tags", "medium").collect()
    assert rows[0].tags == "x; HLTH; DATA - Germany" and rows[0].evidence.locations == ["Abstract"] and rows[0].evidence.status == "Tagged" and rows[0].tags_medium == "HLTH"
    assert rows[1].evidence.status == "Unavailable" and len(rows[0].evidence.quotes[0]) <= 320


HTML = """<html><head><title>T &amp; U</title><meta name="citation_author" content="Doe, J"><meta name="citation_title" content="A found title"><meta name="citation_date" content="2001/02">
<script type="application/ld+json">{"@graph": [{"@type": "Article", "headline": "H", "abstract": "%s", "identifier": {"value": "10.1234/x"}}]}</script>
<link hreflang="en" href="/en/a"></head><body><div class="abstract">short</div></body></html>""" % ("words of an abstract " * 4)


def test_pages_and_identity(spark):
    page = pages.read_page(HTML)
    assert (page["title"], page["authors"], page["year"], page["dois"], page["abstract_source"]) == ("A found title", ["Doe, J"], "2001", ["10.1234/x"], "JSON-LD")
    assert pages.alternates(HTML, "https://x.org/de/a") == ["https://x.org/en/a"]
    assert pages.read_page(None)["abstract"] == "" and pages.chapter_evidence("A found title", ["Doe"], "x A found title by Doe") and not pages.chapter_evidence("A found title", ["Doe"], "nothing here")
    df = spark.createDataFrame([("A found title", "Doe, J", "2002", "10.1234/X", HTML), ("Something else here", "", "1990", "", HTML), ("", "", "", "", None)], "t string, a string, y string, d string, h string")
    rows = [r.i for r in df.select(notes.assess_identity(F.col("t"), F.col("a"), F.col("y"), F.col("d"), pages.page_column(F.col("h"))).alias("i")).collect()]
    assert [r.status for r in rows] == ["matched", "possible_mismatch", "insufficient_metadata"] and rows[0].doi_match is True and rows[0].author_match is True


def test_note_links():
    assert notes.remove_links("<p>https://x.org/a. (M)</p>", ["https://x.org/a"]) == ("<p>(M)</p>", 1)
    assert notes.remove_links('<a href="http://x.org/">x</a>', ["http://x.org"]) == ("", 1) and notes.remove_links("kept http://y.org", ["http://x.org"]) == ("kept http://y.org", 0)


def test_abstract_order(spark):
    records = spark.createDataFrame([(1, "own " * 20), (2, ""), (3, ""), (4, ""), (5, None)], "id int, abstract string")
    long_ = "x" * 50
    cached = spark.createDataFrame([(2, "cached")], "id int, abstract string")
    sources = spark.createDataFrame([(2, "s", 0, True, long_), (3, "b", 2, True, long_), (3, "a", 1, True, long_), (4, "a", 1, False, long_)], "id int, source string, source_rank int, accepted boolean, abstract string")
    found = notes.find_abstracts(records, "id", "abstract", cached, sources, spark.createDataFrame([(4, HTML)], "id int, html string"))
    assert {r.id: r.origin for r in found.collect()} == {1: "existing", 2: "cache", 3: "a", 4: "JSON-LD", 5: "no_abstract_found"}


def test_judging_candidates():
    own = {"titles": ["A long title of things"], "names": ["Doe"], "year": "2001", "item_family": "article", "volume": "1", "pages": "1–9", "issn": "1234-5678"}
    other = {"title": "A long title of things", "main_title": "A long title of things", "subtitle": "", "authors": ["Doe"], "years": [2001], "item_family": "article", "volume": "1", "pages": "1-9", "issn": "12345678"}
    assert verify.judge(own, other)["status"] == "verified" and verify.judge(own, other | {"volume": "2"})["conflicts"] == ["volume"]
    assert verify.judge(own, other | {"years": [1990]})["conflicts"] == ["year"] and verify.judge(own, other | {"title": "X", "main_title": "X"})["status"] == "mismatch"
    book = {"title": "The book of all things", "main_title": "The book of all things", "item_family": "book", "authors": [], "years": []}
    assert verify.judge(own | {"item_family": "chapter", "container": "The book of all things"}, book)["status"] == "container_match"
    assert "Publication year" in verify.mismatch_message("No.", {"conflicts": ["year"]})
    assert verify.publishers_match("Wiley", "John Wiley & Sons") and not verify.containers_match("Nature", "Science of the total environment")


def test_combining_evidence(spark):
    primary = spark.createDataFrame([(1, "verified", "registry"), (2, "unverified", "landing_page"), (3, "invalid", "doi_format"), (4, "verified", "registry")], "id int, status string, rule string")
    secondary = spark.createDataFrame([(2, True, "s"), (3, True, "s"), (4, True, "s")], "id int, confirmed boolean, source string")
    got = lambda thorough: [r.status for r in verify.combine(primary, "id", secondary, thorough).orderBy("id").collect()]
    assert got(False) == ["verified", "verified", "invalid", "verified"] and got(True) == ["unverified", "verified", "invalid", "verified"]


def test_candidates(spark):
    payload = {"message": {"items": [{"title": ["T"], "DOI": "10.1/x", "author": [{"family": "Doe"}], "issued": {"date-parts": [[2001]]}}]}}
    alex = {"results": [{"title": "U", "id": "https://openalex/W1", "abstract_inverted_index": {"b": [1], "a": [0]}, "publication_year": 2002}]}
    df = spark.createDataFrame([("1", "crossref", json.dumps(payload)), ("1", "openalex", json.dumps(alex)), ("2", "crossref", None)], "record string, source string, payload string")
    rows = {r.source: r for r in candidates.parse_payloads(df).collect()}
    assert rows["crossref"].url == "https://doi.org/10.1/x" and rows["openalex"].abstract == "a b" and rows["openalex"].url_is_reference_only
    clock = [0.0]
    limiter = candidates.Limiter(1.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    answers = iter([(429, "5", b""), (503, None, b""), (200, None, b"ok")])
    assert candidates.with_retry(lambda: next(answers), limiter) == (b"ok", None) and clock[0] >= 5
    assert candidates.with_retry(lambda: (404, None, b""), limiter) == (None, "HTTP 404") and candidates.retry_after("999", 0) == 120
    assert not candidates.is_public("http://x", lambda h: ["127.0.0.1"]) and candidates.is_public("http://x", lambda h: ["8.8.8.8"]) and not candidates.is_public("file:///x")


def test_state(spark):
    df = spark.createDataFrame([("Bonjour [Hello]", "fr"), ("Salut", "fr"), ("Hi", "en-GB"), ("", "fr"), ("See [12]", "fr")], "t string, lang string")
    memory = spark.createDataFrame([("Salut", "Hi there"), ("See [12]", "see [12]")], "text string, translated string")
    rows = state.translate_cells(df, "t", memory, F.col("lang"), "en").collect()
    assert sorted((r.t, r.t_status) for r in rows) == [("", "empty"), ("Bonjour [Hello]", "already_translated"), ("Hi", "already_target"), ("Salut [Hi there]", "translated"), ("See [12]", "translated")]
    r = one(spark, state.key(F.lit("a"), F.lit("b")).alias("x"), state.key(F.lit("ab"), F.lit("")).alias("y"))
    assert r.x != r.y
    topics = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, topic_vector array<double>")
    got = semantic.nearest_topics(spark.createDataFrame([([2.0, 0.1],), ([1.0, 1.0],), ([0.0, 0.0],)], "v array<double>"), "v", topics).collect()
    assert [x.accepted for x in got] == [True, False, False] and got[0].topic == 0


def test_resuming_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1,), (1,), (2,)], "k int").write.parquet(src)
    for _ in range(2):
        resume.resumable(spark.readStream.schema("k int").parquet(src), "k", lambda df: df.withColumn("done", F.lit(True)), out, f"{tmp_path}/cp").awaitTermination()
        spark.createDataFrame([(2,), (3,)], "k int").write.mode("append").parquet(src)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(4, 60))
def test_chunks_keep_the_text(text, most):
    assert "".join(chunks.hard_split(text, most)) == text and all(len(c.encode()) <= most for c in chunks.hard_split(text, most))
    packed = chunks.pack(text, most)
    assert all(0 < len(c.encode()) <= most for c in packed) and "".join("".join(packed).split()) == "".join(text.split())


@settings(max_examples=100, deadline=None)
@given(st.text(" \n\u00a0ab.é", max_size=300), st.integers(4, 60))
def test_chunks_keep_the_words(text, most):
    found = chunks.packed(text, most)
    assert [x for x, _ in found] == chunks.pack(text, most) and all(0 < len(x.encode()) <= most for x, _ in found)
    ascii_words = lambda x: [w for w in x.replace("\n", " ").split(" ") if w]
    assert len(ascii_words(chunks.rejoined(*zip(*found)) if found else "")) == len(ascii_words(text))


def test_a_long_sentence_is_cut_between_words(spark):
    text = " ".join(["wörd"] * 300) + " " + "x" * 1000 + "\u00a0y.\u00a0z\nend"
    row = one(spark, chunks.parts(F.lit(text)).alias("p"), chunks.whole(chunks.parts(F.lit(text))).alias("t"))
    words = re.findall(r"[^ \n]+", row.t)
    assert words[:300] == ["wörd"] * 300 and len(words) == 302 and "x" * 1000 in row.t
    assert all(w in ("wörd", "") or "x" in w for x in row.p for w in x.text.split(" ")[:-1])


def test_binding_columns(spark):
    df = spark.createDataFrame([("a", " ", "b", ["x", "y"])], "`Item Title` string, url string, `My DOI` string, tags array<string>")
    assert schema.bind(df, ("title", "doi", "url", "year")) == {"title": "Item Title", "doi": "My DOI", "url": "url", "year": None}
    assert schema.drop_blank(df, ["url", "My DOI"]).columns == ["Item Title", "My DOI", "tags"]
    flat = schema.flatten(df.select(F.struct(F.col("Item Title").alias("t"), "tags").alias("s")), "s", "v_").first()
    assert (flat.v_t, flat.v_tags) == ("a", "x; y") and schema.duration(3725.9) == "1:02:05"
    assert schema.common_columns(df, df.select("url")) == (["url"], ["Item Title", "My DOI", "tags"], [])
    assert one(spark, chunks.chunks(F.lit("A b. C d.")).alias("c")).c == ["A b. C d."]


def test_entry_point():
    import __spark_entry__ as entry
    from recordloom.plans import registry

    assert registry.FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_normalize_signs():
    quotes = [chr(i) for i in (0x27, 0x22, 0x2018, 0x2019, 0x201A, 0x201B, 0x201C, 0x201D, 0x201E, 0x201F, 0x2BC, 0xFF07, 0xAB, 0xBB, 0x2039, 0x203A, 0xFF02)]
    assert all(similarity.normalize(f"a{q}b") == "ab" for q in quotes)
    assert all(similarity.normalize(f"a{chr(d)}b") == "a-b" for d in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212))
    assert all(similarity.normalize(f"a{chr(c)}b") == "a b" for c in (0xA0, 0x2007, 0x202F))
    assert similarity.normalize("a`b\u00b4c") == "a`b \u0301c".replace("\u0301", "")


def test_verification_keeps_one_row_for_each_record(spark):
    blank = {c: "" for c in verify.COMPARED}
    rows = [{"i": i, "titles": ["A title of some words"], "author": "Doe, J", "year": "2001", "doi": "10.1234/x" if i == 0 else None if i % 2 else "", "url": "http://h.org/1" if i < 4 else "", "item_type": "article", **blank} for i in range(40)]
    names = "titles array<string>, author string, year string, doi string, url string, item_type string, " + ", ".join(f"{c} string" for c in verify.COMPARED)
    records = spark.createDataFrame(rows, f"i int, {names}")
    registry = spark.createDataFrame([{"doi": d, "title": t, "main_title": t, "subtitle": None, "authors": ["Doe"], "years": [2001], **blank} for d, t in [("10.1234/X", "A title of some words"), ("10.1234/x", "B other"), *[("", "t"), (None, "u")] * 20]], "doi string, title string, main_title string, subtitle string, authors array<string>, years array<int>, " + ", ".join(f"{c} string" for c in verify.COMPARED))
    pages_ = spark.createDataFrame([("http://h.org/1", 200, True), ("http://h.org/1", 404, False), ("http://h.org/1", 200, True), ("", 200, True), (None, 200, True)], "url string, http_status int, evidence boolean")
    found = {r.i: r for r in verify.verify_primary(records, "i", registry, pages_).collect()}
    assert len(found) == 40 and verify.verify_primary(records, "i", registry, pages_).count() == 40
    assert (found[0].rule, found[0].status) == ("registry", "verified") and found[1].rule == "landing_page" and found[9].rule == "no_identifier"


def plain_greedy(left, right, n):
    out, used = {}, set()
    for row, own in left:
        best, agreed, tied = None, -1, 0
        for other, keys in right:
            pairs = [(x, y) for x, y in zip(own, keys, strict=True) if x and y]
            if other in used or any(x != y for x, y in pairs):
                continue
            best, agreed, tied = (other, len(pairs), 1) if len(pairs) > agreed else (best, agreed, tied + (len(pairs) == agreed))
        if best is not None:
            used.add(best)
            out[row] = (best, agreed, tied)
    return out


def test_greedy_pairs_against_all_candidates():
    import random

    import pandas as pd

    rng = random.Random(2)
    for n in (1, 2, 3):
        for _ in range(60):
            side = lambda: [(i, tuple(rng.choice(["", "x", "y", "z"]) for _ in range(n))) for i in range(rng.randrange(1, 25))]
            left, right = side(), side()
            block = pd.DataFrame([(s, r, list(k)) for s, rows in (("a", left), ("b", right)) for r, k in rows], columns=["side", "row", "keys"])
            got = {r.row_a: (r.row_b, r.note) for r in compare._greedy(n)(block.sample(frac=1, random_state=1)).itertuples()}
            want = plain_greedy(left, right, n)
            assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
            for k, (_, agreed, tied) in want.items():
                assert f"title + {agreed} of" in got[k][1] and (f"{tied} identical" in got[k][1]) == (tied > 1)


def test_greedy_pairs_of_split_titles_against_all_candidates(spark):
    import random

    rng = random.Random(5)
    for n, blank in ((0, 0.0), (1, 0.0), (2, 0.15), (3, 0.3)):
        side = lambda: [(i, rng.choice(["", "s", "t", "u", "v", "w"]), *("" if rng.random() < blank else rng.choice("xyz") for _ in range(n))) for i in range(120)]
        left, right = side(), side()
        schema = ", ".join(["row int", "title string", *(f"k{i} string" for i in range(n))])
        extra = [(f"k{i}", f"k{i}") for i in range(n)]
        got = {r.row_a: (r.row_b, r.note) for r in compare.match_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "row", ("title", "title"), extra).collect()}
        want = {}
        for title in "stuvw":
            of = lambda rows: [(r[0], r[2:]) for r in rows if r[1] == title]  # noqa: B023, E731
            want |= plain_greedy(of(left), of(right), n)
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and want
        for k, (_, agreed, tied) in want.items():
            assert (not n or got[k][1].startswith(f"title + {agreed} of {n} extra key(s)" + (" (others empty)" if agreed < n else ""))) and (f"{tied} identical" in got[k][1]) == (tied > 1)


def test_one_title_of_very_many_rows(spark):
    many = spark.range(200_000).select(F.col("id").alias("row"), F.lit("Same").alias("title"), (F.col("id") % 7).cast("string").alias("year"))
    pairs = compare.match_pairs(many, many, "row", ("title", "title"), [("year", "year")])
    assert pairs.where("row_a = row_b").count() == 200_000
    empty = many.limit(0)
    assert compare.match_pairs(many, empty, "row", ("title", "title"), [("year", "year")]).isEmpty() and compare.match_pairs(empty, many, "row", ("title", "title")).isEmpty()


def test_accuracy_of_the_surest_half(spark):
    import random

    rng = random.Random(1)
    for size, margins in ((0, [1.0]), (1, [0.5]), (7, [0.1, 0.2]), (3001, [i / 500 for i in range(400)])):
        rows = [(f"t{rng.randrange(3)}", f"t{rng.randrange(3)}", ["t0", "t1", "t2"], rng.choice(margins), rng.random() < 0.5) for _ in range(size)]
        df = spark.createDataFrame(rows, "topic string, gold string, ranked array<string>, margin double, accepted boolean")
        got = semantic.accuracy(df, "gold").first()
        best = sorted(((m, t == g) for t, g, _, m, _ in rows), reverse=True)[: max(1, size // 2)]
        assert got.n == size and (got.half_precision is None if not size else abs(got.half_precision - sum(h for _, h in best) / len(best)) < 1e-9)


def test_repeated_entries_and_reviews_add_no_rows(spark):
    work = spark.createDataFrame([(1, "A"), (2, "B")], "k int, status string")
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert [(r.k, r.v) for r in state.hits(work, twice, "k", "v").collect()] == [(1, "x")]
    reviews = spark.createDataFrame([(1, "Accepted", 2), (1, "Not accepted", 1)], "k int, choice string, at int")
    assert sorted((r.k, r.status) for r in schema.overlay_reviews(work, "k", reviews, "at").collect()) == [(1, "accepted"), (2, "B")]
    assert schema.overlay_reviews(work, "k", reviews).count() == 2


def test_kinds_in_one_job(spark):
    rows = [(str(i), f"a{i % 3}", "x; y" if i % 2 else "z, w", str(1990 + i % 9), f"text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "n string, c string, t string, y string, `te.xt` string")
    kinds = profile.kinds_of(df, ["n", "c", "t", "y", "te.xt"])
    assert kinds == {c: profile.kind_of(df, c) for c in kinds} and (kinds["c"], kinds["t"], kinds["y"]) == ("categorical", "multi_tag", "year")
    assert compare.kinds_of_both(df, df, [("n", "n"), ("t", "t"), ("te.xt", "te.xt")]) == [kinds["n"], kinds["t"], kinds["te.xt"]]


def test_pages_and_documents_verify(spark):
    blank = {c: "" for c in verify.COMPARED}
    title = "A title of some words"
    cases = {  # url, doi, registry_failed: status, rule
        "html-seen": ("", False, "verified_via_landing_page", "landing_page"), "html-scored": ("", False, "verified", "landing_page"), "html-other": ("", False, "mismatch", "landing_page"), "html-blank": ("", False, "unverified", "landing_page"),
        "pdf-whole": ("", False, "verified", "landing_page"), "pdf-part": ("", False, "mismatch", "landing_page"), "pdf-none": ("", False, "unverified", "landing_page"), "zip": ("", False, "unverified", "landing_page"),
        "gone": ("", False, "invalid", "landing_page"), "down": ("", False, "unavailable", "landing_page"), "none": ("", False, "unavailable", "landing_page"),
        "doi-page": ("10.1234/q", False, "verified_via_landing_page", "doi_resolution_page"), "doi-failed": ("10.1234/q", True, "unavailable", "doi_resolution_page"), "doi-lost": ("10.1234/q", False, "invalid", "doi_resolution_page"),
    }
    names = ", ".join(f"{c} string" for c in verify.COMPARED)
    records_ = spark.createDataFrame([{"i": k, "titles": [title], "author": "Doe, J", "year": "2001", "doi": d, "url": f"http://h/{k}", "item_type": "article", "registry_failed": f, **blank} for k, (d, f, _, _) in cases.items()], f"i string, titles array<string>, author string, year string, doi string, url string, item_type string, registry_failed boolean, {names}")
    registry = spark.createDataFrame([], f"doi string, title string, main_title string, subtitle string, authors array<string>, years array<int>, {names}")
    meta = lambda t: {"title": t, "main_title": t, "subtitle": "", "authors": ["Doe"], "years": [2001], **blank}
    page = lambda k, status=200, seen=False, content="html", document=None, t="": (f"http://h/{k}", status, seen, content, document, meta(t))
    rows = [page("html-seen", seen=True), page("html-scored", t=title), page("html-other", t="Something else entirely"), page("html-blank"), page("pdf-whole", content="pdf", document=(True, True, True)), page("pdf-part", content="pdf", document=(True, False, True)), page("pdf-none", content="pdf"), page("zip", content="application/zip", seen=True), page("gone", 404), page("down", 503), page("doi-page", seen=True)]
    kind = f"title string, main_title string, subtitle string, authors array<string>, years array<int>, {names}".replace(" string", ":string").replace(" array", ":array")
    pages_ = spark.createDataFrame(rows, f"url string, http_status int, evidence boolean, content string, document struct<title:boolean,author:boolean,year:boolean>, metadata struct<{kind}>")
    found = {r.i: (r.status, r.rule) for r in verify.verify_primary(records_, "i", registry, pages_).collect()}
    assert found == {k: (s, r) for k, (_, _, s, r) in cases.items()}


def test_confirmations_of_two_families(spark):
    primary = spark.createDataFrame([(1, "verified", "registry"), (2, "mismatch", "registry"), (3, "mismatch", "registry"), (4, "container_match", "registry"), (5, "invalid", "doi_format"), (6, "verified", "registry")], "i int, status string, rule string")
    second = spark.createDataFrame([(1, True, "a", 1, None), (2, True, "a", 1, "unverified"), (3, True, "b", 2, None), (4, False, "c", 0, "mismatch"), (5, True, "d", 3, None)], "i int, confirmed boolean, source string, families int, status string")
    strict, fast = ({r.i: r.status for r in verify.combine(primary, "i", second, t).collect()} for t in (True, False))
    assert strict == {1: "verified", 2: "unverified", 3: "verified", 4: "container_match", 5: "invalid", 6: "unverified"}
    assert fast == {1: "verified", 2: "verified", 3: "verified", 4: "container_match", 5: "invalid", 6: "verified"}
