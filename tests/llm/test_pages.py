import base64
import gzip
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import html_text, warc
from recordloom.llm.common import filesystem

PAGES = [(5, "http://h.org/1", "abc"), (7, "http://h.org/2", "abc"), (7, "http://h.org/0", "abc"), (None, None, "abc"), (None, "u", None), (None, "v", ""), (1, None, "q" * 300_000), (-2, "b\nc", "é \x00"), (5, "http://h.org/1", "abc")]
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('pages')}/p"
    spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "1 AS shard", "2 AS kind", "3 AS raw", "4 AS host", "5 AS key", "6 AS text").write.parquet(path)
    return spark.read.parquet(path)


def expected(rows):
    out = []
    for i, (key, _, html) in enumerate(rows):
        data = (html or "").encode()
        same = [(k if k is not None else -(1 << 62), u or "", j) for j, (k, u, h) in enumerate(rows) if (h or "").encode() == data]
        top = max(k for k, _, _ in same)
        first = min((u, j) for k, u, j in same if k == top)[1]
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first or top == -(1 << 62) else top))
    return out


@pytest.mark.parametrize("roll", [1, 1 << 20])
def test_archives_read_back(spark, pages, roll):
    folder = warc.write_archive(pages, rows_per_shard=2, roll_bytes=roll)
    rows = warc.read_archive(spark, folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == sorted(expected(PAGES), key=str)
    manifest = {r.file: r for r in spark.read.parquet(f"{folder}/_manifest").collect()}
    fs, path = filesystem(folder)
    for name, entry in manifest.items():
        data = open(f"{path}/{name}", "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (entry.bytes, entry.sha256)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == entry.records
    again = {r.file: r for r in spark.read.parquet(f"{warc.write_archive(pages.repartition(5), rows_per_shard=2, roll_bytes=roll)}/_manifest").collect()}
    assert again == manifest  # whatever the input's order


def test_shards_hold_alike_whatever_the_keys(spark, tmp_path):
    rows = [(i, "u", f"page {i}") for i in range(2000)] + [(1 << 62, "u", "far"), (-(1 << 63), "u", "least"), ((1 << 63) - 1, "u", "most"), (None, "u", "none")]
    rows += [(7, f"u{i}", f"hot {i}") for i in range(1000)]  # a third have one key
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/p")
    folder = warc.write_archive(spark.read.parquet(f"{tmp_path}/p"), rows_per_shard=300)
    shards = {}
    for r in spark.read.parquet(f"{folder}/_manifest").collect():
        shards[r.file.split("-")[1]] = shards.get(r.file.split("-")[1], 0) + r.records
    assert len(shards) >= 8 and max(shards.values()) < 600
    back = warc.read_archive(spark, folder).collect()
    assert sorted(str(r.page_id) for r in back) == sorted(str(k) for k, _, _ in rows) and all(r.record_type == "response" for r in back)


def test_empty_archive(spark, pages):
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_damage_is_found(spark, pages):
    folder = warc.write_archive(pages)
    _, path = filesystem(folder)
    name = spark.read.parquet(f"{folder}/_manifest").orderBy("bytes").first().file
    text = gzip.decompress(open(f"{path}/{name}", "rb").read()).replace(b"abc", b"abd")
    records = [b"WARC/1.1" + x for x in text.split(b"WARC/1.1")[1:]]
    open(f"{path}/{name}", "wb").write(b"".join(map(gzip.compress, records)))
    if b"abd" in text:
        with pytest.raises(Exception, match="differs from its digest"):
            warc.read_archive(spark, folder).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>site</header><nav><ul><li><a href=x>Menu</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld&nbsp;word<br>next<!-- c --><p>Two   three
four<ul><li>item</ul><form><input value=x>go</form><aside>side</aside><div class="share">tweet</div><section id="comments"><p>reader says</section></article>
<div class="comments">nice</div><footer>&copy; x</footer></body></html>"""


def test_article_text():
    wrapper = html_text.Wrapper()
    for _ in range(3):
        wrapper.add(html_text.tokens(PAGE))
    assert wrapper.compiled().text(html_text.tokens(PAGE)) == "Head & line One bold word next Two three four item"


def test_pages_without_an_article():
    make = lambda i: f"<html><body><div class=top><a href=x>Home</a><a href=y>About us</a></div><div class=c><p>Text number {i} is long and differs {i * 7}</p><p>more {i}</p></div><div class=f>same end</div></body></html>"
    wrapper = html_text.Wrapper()
    for i in range(5):
        wrapper.add(html_text.tokens(make(i)))
    assert wrapper.compiled().text(html_text.tokens(make(3))) == "Text number 3 is long and differs 21 more 3"


@pytest.mark.parametrize("html", [None, "", "plain & text", "<p", "<p>a<", "</div></p>x", "<script>x", "<article><p>a", "&#x41;&bad;&amp", "<![CDATA[a<b]]>", "<p>" * 3000 + "deep", "<a " + "x='" * 10])
def test_malformed_pages(html):
    stream = html_text.tokens(html or "")
    wrapper = html_text.Wrapper()
    wrapper.add(stream)
    text = html_text.Wrapper.loads(wrapper.dumps()).compiled().text(stream)
    assert text == " ".join(text.split()) and ("<p>" not in text)


TREES = st.recursive(st.just("t"), lambda c: st.tuples(st.sampled_from("abc"), st.lists(c, max_size=4)), max_leaves=12)


def render(tree):
    return "x" if tree == "t" else f"<div class={tree[0]}{tree[0]}>{''.join(map(render, tree[1]))}</div>" if tree[0] != "c" else f"<section>{''.join(map(render, tree[1]))}</section>"


@settings(max_examples=150, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=6))
def test_wrappers_accept_their_pages(trees):
    streams = [html_text.tokens(render(t)) for t in trees]
    whole, parts = html_text.Wrapper(), [html_text.Wrapper(), html_text.Wrapper()]
    for i, s in enumerate(streams):
        whole.add(s)
        parts[i % 2].add(s)
    parts[0].merge(html_text.Wrapper.loads(parts[1].dumps()))
    for wrapper in (whole, parts[0]):
        accepts = re.compile(html_text.pattern(wrapper.items))
        assert all(accepts.fullmatch("".join(f"{k}\n" for k, *_ in s)) for s in streams)


def test_long_lists_stay_bounded():
    wrapper = html_text.Wrapper()
    for i in range(60):
        wrapper.add(html_text.tokens("".join(f"<h{(i * k) % 6 + 1}>a</h{(i * k) % 6 + 1}><p>b</p><table>c</table>" for k in range(1, 9))))
    assert len(wrapper.dumps()) < 20_000


def test_query_rows(spark, pages):
    rows = html_text.extract_text(pages).collect()
    assert sorted(((str(r.page_id), r.n_chars) for r in rows)) == sorted((str(k), len(r)) for (k, _, h), r in zip(PAGES, ["abc", "abc", "abc", "abc", "", "", "q" * 300_000, "é \x00", "abc"], strict=True))
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_given_pages_against_their_markup(spark):
    import html

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(table).collect()}
    for r in table.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
