import time
from collections import defaultdict
from math import sqrt

import pytest

from shelfmark.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<script>var t="</p>";</script><div class="ad-box ad">buy</div><article><header><h1>A &amp; B</h1></header><p>One <b>bold</b>
 text<br>line<p>Two &eacute;&#39;s&nbsp;x<ul><li>a<li>b</ul><div class="share">tweet</div><table><tr><td>1<td>2</table><form>name</form></article>
<section id="comments"><p>nice</p></section><aside>more</aside><footer>&copy; x</footer></body></html>"""
NONE = frozenset()


def text(source, marks=True):
    return "\n".join(H.Page(source, marks).kept(*[NONE] * 5))


def brute(rows, marks):
    """Templates of each host by counting in dictionaries. rows: (host, html)."""
    seen = defaultdict(dict)
    for host, source in rows:
        page = H.Page(source or "", marks)
        for key, sizes in page.counted().items():
            seen[host, *key][page.signature()] = sizes
    out = defaultdict(lambda: [set() for _ in H.SETS])
    for (host, kind, value), pages in seen.items():
        n, all_ = len(pages), len(seen[host, H.SLOT, 0])
        chars, page_chars, links = (sum(s[i] for s in pages.values()) for i in range(3))
        if n < 3 or (kind, value) == (H.SLOT, 0):
            continue
        content, outside, inside, stated, containers = out[host]
        if kind == H.SLOT and n >= sqrt(all_) and chars * 2 >= page_chars > 0:
            content.add(value)
        if kind == H.TEXT and n >= sqrt(all_) or kind == H.SHAPE and n >= 0.1 * all_ and (links * 2 >= chars or chars <= 0.2 * page_chars):
            outside.add(value)
        if n >= 0.5 * all_ and (kind == H.TEXT and n > 3 or kind == H.SHAPE and links * 2 >= chars):
            inside.add(value)
        if kind == H.TEXT and n >= 0.9 * all_ and n >= 10:
            stated.add(value)
        if kind == H.TEXT and n > 3 and n >= sqrt(all_):
            containers.add(value)
    return out


def given(spark, scale):
    return spark.read.parquet(f"/root/testdata/sf{scale}/pages.parquet")


def test_main_text_of_a_page():
    assert text(PAGE) == "A & B\nOne bold text line\nTwo é's x\na\nb\n1\n2"


def test_odd_markup():
    assert text("") == text("<!-- only -->") == text("<script>x") == ""
    assert text("plain &lt;text") == "plain <text"
    assert text("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert text("<div>a<!-- <p>no</p> -->b</div><p title='>'>c") == "ab\nc"
    assert text("a < b <3 <- c") == "a < b <3 <- c"
    assert text("<p>" * 3000 + "x") == "x"
    assert text("<![CDATA[x]]>y<!-- never closed <p>z") == "y z" or text("<!-- never closed <p>z") == "z"


def test_marks_do_not_take_articles():
    assert text('<main class="content no-sidebar"><p>All of it.</p></main>') == "All of it."
    assert text('<article><p id="social-impact">One.</p><p class="related-work">Two.</p><math><mi>x</mi></math></article>') == "One.\nTwo.\nx"
    assert text('<article><h3>Teaser</h3></article><div class="story"><p>A long article in a plain element.</p><p>It goes on and on.</p></div>').endswith("element.\nIt goes on and on.")
    assert text('<article class="ad"><p>x</p></article>') == "x"
    assert text('<article><div class="related-posts">r</div><section class="comment-list">c</section><p>x</p></article>') == "x"


def test_doubtful_marks_inside_an_article_are_left_to_the_count():
    source = '<article><p>Body</p><section id="related"><h2>Related work</h2><p>x</p></section><div class="notice text">n</div><ul class="menu items"><li>Soup</ul></article>'
    assert text(source) == "Body\nRelated work\nx\nn\nSoup"
    assert text('<article><p>Body</p><ul class="menu"><li><a href="/">Soup</a></ul></article><div class="notice">n</div>') == "Body"
    page = H.Page(source)
    notice = frozenset(h for h, name in zip(page.text_hash, page.classes, strict=True) if "notice" in name)
    assert "\n".join(page.kept(NONE, notice, NONE, NONE, NONE, True)) == "Body\nRelated work\nx\nSoup"


def test_headline_before_the_article_stays():
    body = "<p>It is long enough to be the main part.</p>"
    assert text(f"<h1>Head</h1><article>{body}</article>").startswith("Head\nIt is")
    assert text(f"<h1>Site</h1><article><h1>Head</h1>{body}</article>").startswith("Head\nIt is")
    assert text(f"<header><h1>Site</h1></header><h1>Head</h1><p>by line</p><article>{body}</article><h1>Late</h1>") == f"Head\n{body[3:-4]}"


def test_references_end_with_their_text_node():
    assert text("x &am<b>p;</b> &lt;<i>b</i>&gt;") == "x &amp; <b>"


@pytest.mark.parametrize("source", ["<h1>x</h1>" * 50_000 + "<article>" + "y " * 200_000 + "</article>", "<!--" * 250_000, "<div>" * 100_000 + "x", "<li>" * 100_000, "<ul><li>" * 50_000 + "x", "<a '" * 100_000, '<a "' * 100_000, "<p><b>" + "<b>" * 50_000 + "<button>" + "<div>x" * 50_000, "<![CDATA[" * 100_000, "</x>" * 200_000])
def test_time_grows_with_the_length(source):
    began = time.time()
    text(source)
    assert time.time() - began < 8


def test_templates_of_a_site_go(spark):
    rows = [(i, "http://a.example/p", f"<div><p>Subscribe to us</p></div><div><p>Story {i} is here</p><p>Both share this</p></div>" if i < 30 else f"<p>Story {i} is here</p>") for i in range(40)]
    rows += [(100 + i, "http://b.example/p", "<article><p>The same page</p></article>") for i in range(40)]
    rows += [(200, None, None), (201, "x", ""), (None, "http://a.example/z", "<p>q</p>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in H.main_text(pages).collect()}
    assert out[3].text == "Story 3 is here" and out[35].text == "Story 35 is here"
    assert out[120].text == "The same page" and out[120].n_chars == 13
    assert out[200].text == out[201].text == "" and out[None].text == "q"
    assert H.main_text(pages.limit(0)).count() == 0


def _story(i):
    return " ".join(f"word{i * 7 + k}" for k in range(40))


def test_rotating_templates_of_a_hot_host_go_and_articles_stay(spark):
    """Parts without any telling name: a menu, one of four promos, a promo inside the article; and a sentence that many articles have."""
    rows = []
    for i in range(400):
        menu = "".join(f'<li><a href="/{i}{k}">topic {i * 3 + k}</a></li>' for k in range(2 + i % 3))
        promo = f"<div class='x{i}'><p>Offer number {i % 4} of this week</p></div>"
        inner = f"<div><p>Join the club, reader</p><p>round {i % 5}</p></div>" if i % 4 == 0 else ""
        rows.append((i, "https://hot.example/", f"<div class='q'><ul>{menu}</ul></div>{promo}<div class='z'><h1>Title {i}</h1><p>{_story(i)}</p>{inner}<p>This is what many say.</p></div><div class='k'>line {i} below</div>"))
    rows += [(1000 + i, f"https://small{i}.example/", f"<nav>a</nav><div class='cookie-banner'>ok</div><div><p>{_story(i)}</p></div><footer>f</footer>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for marks in (True, False):
        out = {r.page_id: r.text for r in H.main_text(pages, marks).collect()}
        for i in range(400):
            assert out[i].split("\n")[:2] == [f"Title {i}", _story(i)], out[i]
            assert "Offer" not in out[i] and "topic" not in out[i] and "below" not in out[i] and "Join the club" not in out[i]
    out = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert all(out[1000 + i] == _story(i) for i in range(30))


def test_a_passage_that_some_articles_share_stays(spark):
    shared = "<p>A passage that a third of the articles quote word for word.</p>"
    rows = [(i, "https://a.example/", f"<nav><a>m {i}</a></nav><article><h1>T {i}</h1><p>{_story(i)}</p>{shared if i % 3 == 0 else ''}</article>") for i in range(60)]
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("A passage" in out[i]) == (i % 3 == 0) and f"T {i}\n" in out[i] for i in range(60))


@pytest.mark.parametrize("most", [0, H.MOST_BROADCAST])
def test_parts_of_articles_stay_on_large_hosts(spark, most):
    """A passage of two paragraphs quoted by 15 of 225 articles, a section about related work, a notice that all articles have."""
    quoted = "<div><p>A passage that some quote.</p><p>And its second half.</p></div>"
    rows = []
    for i in range(225):
        related = f'<section id="related"><h2>Related work {i}</h2><p>{_story(i + 1000)}</p><p>end</p></section>' if i % 9 == 0 else ""
        rows.append((i, "https://a.example/", f'<nav>m</nav><article><h1>T {i}</h1><p>{_story(i)}</p>{quoted if i % 15 == 0 else ""}{related}<div class="notice">Read our terms</div></article>'))
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), most_broadcast=most).collect()}
    assert len(out) == 225
    for i, found in out.items():
        assert found.startswith(f"T {i}\n{_story(i)}") and "terms" not in found and not found.startswith("m")
        assert ("second half" in found) == (i % 15 == 0) and (f"Related work {i}\n{_story(i + 1000)}" in found) == (i % 9 == 0)


@pytest.mark.parametrize("most", [0, H.MOST_BROADCAST])
def test_texts_are_those_of_brute_force(spark, most, monkeypatch):
    """Both ways to bring templates to pages give what each page keeps by its host's templates; a hot host is dealt over several tasks."""
    monkeypatch.setattr(H, "PAGES_A_TASK", 3)
    pages = given(spark, "0.01")
    pages = pages.unionByName(spark.createDataFrame([(None, None, None), (1, "x", "")], pages.select("page_id", "url", "html").schema), allowMissingColumns=True)
    rows = H._named(pages).collect()
    sets = brute([(r.site, r.html) for r in rows], True)
    sites = defaultdict(set)
    for r in rows:
        sites[r.site].add(H.Page(r.html or "").signature())
    kept = lambda r: "\n".join(H.Page(r.html or "").kept(*(sets[r.site] if r.site in sets else [NONE] * 5), len(sites[r.site]) >= 10))
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.url, r.text) for r in H.main_text(pages, most_broadcast=most).collect()), key=order) == sorted(((r.page_id, r.url, kept(r)) for r in rows), key=order)


def test_many_templates_of_a_host_take_eight_bytes_each():
    """Templates are held once a task, as sorted numbers; a page looks up its own hashes only."""
    sets = {name: [list(range(k * 100_000, (k + 1) * 100_000))] for k, name in enumerate(H.SETS)}
    table = H._table(H.pa.table({"site": [7], "pages": [20], **sets}))
    assert table.nbytes == 8 * 500_001
    page, began = H.Page("<article><p>x</p></article>"), time.time()
    for _ in range(2000):
        assert H._text(page, 7, table) == "x"
    assert time.time() - began < 4


@pytest.mark.parametrize("marks", [True, False])
def test_templates_are_those_of_brute_force(spark, marks):
    pages = given(spark, "0.01")
    names = {r.site: r.host for r in H._named(pages).select("site", H.host(H.F.col("url")).alias("host")).distinct().collect()}
    found = {names[r.site]: [set(r[c]) for c in H.SETS] for r in H.site_templates(pages, marks).collect()}
    expected = {k: v for k, v in brute([(names[r.site], r.html) for r in H._named(pages).collect()], marks).items() if any(v)}
    assert found == expected


def test_the_count_alone_finds_what_the_marks_say(spark, record_property):
    """Without any list of words or elements: menus, adverts and footers of the given hosts of ten pages or more go by the count."""
    pages = given(spark, "0.1")
    by_count = {r.page_id: r.text for r in H.main_text(pages, marks=False).collect()}
    by_marks = {r.page_id: r.text for r in H.main_text(pages).collect()}
    every = {r.page_id: "\n".join(b[0] for b in H.Page(r.html or "", False).blocks) for r in pages.collect()}
    changed = sum(by_count[k] != every[k] for k in every)
    record_property("pages changed by the count", changed)
    assert changed == len(every) and by_count == by_marks
