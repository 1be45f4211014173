import pytest
from recordloom.llm import html_text


def text_of(*pages, page=0):
    wrapper = html_text.Wrapper()
    for p in pages:
        wrapper.add(html_text.tokens(p))
    return html_text.Wrapper.loads(wrapper.dumps()).compiled().text(html_text.tokens(pages[page]))


@pytest.mark.parametrize("before, after", [("<body class='has-sidebar'><article>", "</article>"), ("<body class=sidebar><article>", "</article>"), ("<body><div id='content-sidebar-wrap'><article>", "</article></div>"), ("<body><div class=sidebar><div class=widget><main>", "</main></div></div>"), ("<body><article class='post has-comments'>", "</article>"), ("<body><article class='comments'>", "</article>"), ("<body class='comments-open'><main class=banner>", "</main>")])
def test_layout_names_are_not_boilerplate(before, after):
    page = f"{before}<div class='article-header'><h1>Head</h1></div><p>Text</p><div class='ad-slot'>Buy</div>{after}<div class='site-footer'>end</div>"
    assert text_of(page) == "Head Text"


def test_marked_teasers_stay_boilerplate():
    assert text_of("<article>Text</article><div class='related-posts'><article>teaser</article></div>") == "Text"


def test_lead_and_heading_beside_the_body():
    make = lambda i: f"<body><div class=top><a href=x>Home</a></div><h1>Head {i}</h1><div class=lead>Lead {i * 3}</div><div class=text><p>{f'Body {i} ' * 60}</p></div><div class=end>same end</div></body>"
    assert text_of(*map(make, range(5)), page=2) == "Head 2 Lead 6 " + " ".join(["Body 2"] * 60)


def test_deep_and_broken_pages_are_read():
    deep = "<div>" * 5000 + "<p>Deep text" + "</div>" * 2000
    assert text_of(deep) == "Deep text"
    assert text_of(f"<article>A{'<div>' * 300}<nav>menu</nav>B</article>C", deep) == "A B"
    assert text_of("<article><p>One<div><div>Two</p></div>", deep) == "One Two"
    assert text_of("") == text_of("<!-- x") == "" and text_of("<") == "<"


@pytest.mark.parametrize("n", [1, 2, 7, 8, 100])
def test_a_heading_that_all_articles_have_stays(n):
    inside = lambda i: f"<article><h1>Head {i}</h1><h2>Summary</h2><div class=lead>Note</div><p>Text {i}</p>{'<p>More ' + str(i) + '</p>' if i % 2 else ''}</article>"
    assert text_of(*map(inside, range(n)), page=0) == "Head 0 Summary Note Text 0"
    plain = lambda i: f"<div class=a><a href=x>Home</a></div><div class=b><h2>Summary</h2><p>Text {i}</p><ul><li>Item {i}</ul></div>"
    assert text_of(*map(plain, range(n)), page=0) == "Summary Text 0 Item 0"


def test_the_expression_tells_the_templates_texts():
    def plain(i):
        return f"<div class=top>Our paper <b>daily</b></div><div class=b><h2>Head {i}</h2><p>Text {i}</p></div>{'<div class=c><p>Only here</p></div>' if i == 1 else ''}<div class=end><p>All rights</p><p>Made here</p></div>"

    assert text_of(*map(plain, range(2)), page=0) == text_of(*map(plain, range(50)), page=0) == "Head 0 Text 0"
    assert text_of(*map(plain, range(5)), page=1) == "Head 1 Text 1 Only here"
    assert text_of(plain(0)) == "Our paper daily Head 0 Text 0 All rights Made here"  # one page has no template
    assert text_of(*[plain(1)] * 9) == "Our paper daily Head 1 Text 1 Only here All rights Made here"  # copies are no template


@pytest.mark.parametrize("mark", ["class='post-comments-wrapper'", "id='disqus_thread'", "class='user-comments'", "class='wp-block-comments'", "class='cookie-notice-wrap'", "class='comment-list'", "id=comments"])
def test_reader_comments_and_notices_go(mark):
    assert text_of(f"<article><h1>Head</h1><p>Text</p><div {mark}><p>reader says</p></div></article>") == "Head Text"


def test_the_text_does_not_depend_on_files(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(180):
        blocks = "".join(rng.choice([f"<p>Par {rng.random()}</p>", f"<h2>Part {i}</h2>", "<div class=lead>Note</div>", f"<ul><li>Item {i}</ul>", "<blockquote>Said</blockquote>", f"<div class=box><p>Box {i % 5}</p></div>"]) for _ in range(rng.randrange(1, 9)))
        rows.append((i, f"https://h{i % 9 // 8}.org/{i}", f"<div class=top><a href=x>Home</a> same</div><div class=main0>{blocks}</div><div class=end>same end</div>"))
    found = []
    for n in (1, 2, 4, 7):
        rng.shuffle(rows)
        path = str(tmp_path / f"pages{n}")
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n).write.parquet(path)
        found.append(sorted((r.page_id, r.text) for r in html_text.extract_text(spark.read.parquet(path)).collect()))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 180
    html = {i: page for i, _, page in rows}
    assert not any("same end" in text for i, text in found[0] if "<p>Par" in html[i])


def test_pages_match_their_hosts_expression():
    import random
    import re

    rng = random.Random(7)

    def page(depth=3):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            tag = rng.choice(["div", "section", "p", "ul"])
            out += f"<{tag}>{page(depth - 1) if depth and tag != 'p' else f'word{rng.random()}'}</{tag}>"
        return out

    for _ in range(20):
        pages = [page() for _ in range(6)]
        wrapper = html_text.Wrapper()
        for p in pages:
            wrapper.add(html_text.tokens(p))
        extractor = wrapper.compiled()
        for p in pages:
            stream = html_text.tokens(p)
            assert re.fullmatch(html_text.pattern(wrapper.items), "".join(f"{kind}\n" for kind, *_ in stream))
            slots = extractor.slots_of(stream)
            assert None not in slots
            assert [path for kind, path, *_ in stream if kind == "#"] == [extractor.slots[s][0] for s in slots]
