from __future__ import annotations

import hashlib
import random
import re
import time
from html.parser import HTMLParser

from spreadloom.llm import queries, wrappers

SCHEMA = "page_id long, url string, html string, text int, host string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li><li>two</li></ul></nav><!-- <article>no</article> --><div class="ad">buy now</div>
<article><h1>{title}</h1>{body}<aside>more</aside><form>mail</form><div class="comments"><p>first!</p></div></article><footer>&copy; me</footer></body></html>"""


def page(title: str, *paragraphs: str) -> str:
    return PAGE.format(title=title, body="".join(f"<p>{p}</p>" for p in paragraphs))


def texts(spark, rows: list) -> dict:
    return {r.page_id: r for r in wrappers.main_texts(spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA).repartition(3)).collect()}


def test_article_of_each_page(spark):
    rows = [(k, f"https://News.example/{k}", page(f"Title {k}", *[f"Par {j} &amp; <b>bo</b>ld\n  text&nbsp;{k}" for j in range(k)])) for k in range(6)]
    rows += [(10, "https://one.example/x", page("Only", "a<br>b", "c&#8364;d <i>e</i>")), (11, None, "<p>plain</p> tail"), (12, "u", None), (13, "u", ""), (14, "https://News.example/14", "no markup at all")]
    got = texts(spark, rows)
    assert sorted(got) == sorted(r[0] for r in rows)
    for k in range(6):
        assert got[k].text == "\n".join([f"Title {k}", *[f"Par {j} & bold text {k}" for j in range(k)]]) and got[k].wrapped
    assert got[10].text == "Only\na b\nc€d e"
    assert got[11].text == "plain\ntail" and got[12].text == got[13].text == "" and got[14].text == "no markup at all"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_hosts_with_many_pages_and_repeated_rows(spark):
    rows = [(k, "http://hot.example/", page("T", *["x"] * (k % 7))) for k in range(120)] * 2
    got = wrappers.main_texts(spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA).repartition(6)).collect()
    assert len(got) == 240 and all(r.text == "\n".join(["T", *["x"] * (r.page_id % 7)]) and r.wrapped for r in got)


def test_very_long_and_broken_pages(spark):
    long = page("L", *[f"p{k}" for k in range(5000)])
    got = texts(spark, [(1, "http://a.b/", long), (2, "http://a.b/", "<article><p>open <b>bold"), (3, "http://a.b/", "<p a='>'>q</p><script>never closed <p>x"), (4, "http://a.b/", "a < b <p>c</p>")])
    assert got[1].text == "\n".join(["L", *[f"p{k}" for k in range(5000)]])
    assert got[2].text == "open bold" and got[3].text == "q"


def test_inference():
    a = ["<ul.", "<li.", "#", "/li", "<li.", "#", "/li", "/ul", "<p.", "#", "/p"]
    b = ["<ul.", "<li.", "#", "/li", "<li.", "#", "/li", "<li.", "#", "/li", "/ul", "<div.x", "#", "/div", "<p.", "#", "/p"]
    w = wrappers.widened(wrappers.widened(None, a), b)
    assert w.match(a) and w.match(b)
    assert any(e[0] == "+" for e in w.elements) and any(e[2] for e in w.elements)
    assert not w.match(["<table.", "/table"])


def test_tokens_that_a_wrapper_does_not_know():
    plain = "<html><head><title>t</title></head><body><article><h1>T{0}</h1><p>x{0}</p></article><footer>f</footer></body></html>"
    wrapper = None
    for k in range(3):
        wrapper = wrappers.widened(wrapper, [t for t, _, _ in wrappers.tokens(plain.format(k)) if t != " "])
    changed = [
        ("<h1>T9", "<figure><img src=i></figure><h1>T9"),
        ("<title>", "<meta charset=utf-8><link rel=x><title>"),
        ("<p>x9</p>", "<p><em>x9</em></p>"),
    ]
    for old, new in changed:
        page = plain.format(9).replace(old, new)
        assert wrappers.extract(page, wrapper) == ("T9\nx9", False)
        wider = wrappers.widened(wrapper, [t for t, _, _ in wrappers.tokens(page) if t != " "])
        assert wrappers.extract(page, wider) == ("T9\nx9", True) == wrappers.extract(plain.format(9), wider)


def bare(k: int, extra: str = "") -> str:
    """A page without any element that is marked as the article, and menus that no tag gives away."""
    body = "".join(f"<p>Par {j} of {k}</p>" for j in range(k % 3 + 1))
    return f"<html><body><div class=top><b>The Site</b><a href=/>Home</a> <a href=/x>Jobs</a></div>{extra}<div class=c1><h2>Title {k}</h2>{body}</div><div class=low>Imprint</div></body></html>"


def bare_text(k: int) -> str:
    return "\n".join([f"Title {k}", *[f"Par {j} of {k}" for j in range(k % 3 + 1)]])


def test_slots_tell_the_article_where_no_tag_does(spark):
    rows = [(k, "http://bare.example/", bare(k)) for k in range(12)]
    rows += [(100, "http://one.example/", bare(1)), (101, "http://twice.example/", bare(1)), (102, "http://twice.example/", bare(1))]
    got = texts(spark, rows)
    assert all(got[k].text == bare_text(k) and got[k].wrapped for k in range(12))
    assert all(got[k].text.startswith("The Site") and not got[k].wrapped for k in (100, 101, 102))


def test_differing_texts_are_never_left_out(spark):
    cards = [(k, "http://cards.example/", "<body><ul><li>Home</li></ul><div class=all>" + "".join(f"<article class=a{j}><p>Card {j} of {k} and more</p></article>" for j in range(3)) + "</div></body>") for k in range(6)]
    dates = [(20 + k, "http://dates.example/", bare(k, f"<div class=when>On day {k}</div>")) for k in range(6)]
    odd = [(40 + k, "http://odd.example/", bare(k)) for k in range(6)] + [(50, "http://odd.example/", bare(7).replace("Imprint", "A closing word"))]
    got = texts(spark, cards + dates + odd)
    for k in range(6):
        assert got[k].text == "\n".join(f"Card {j} of {k} and more" for j in range(3))
        assert got[20 + k].text == f"On day {k}\n{bare_text(k)}"
    assert bare_text(7) in got[50].text and "A closing word" in got[50].text


def test_headers_and_menus_of_pages_that_nothing_tells_about(spark):
    rows = [
        (1, "http://h1.example/", "<body><header><h1>Site</h1></header><p>hello</p></body>"),
        (2, "http://h2.example/", "<body><div class='header big'>Site</div><div id=main-nav>Home</div><p>hello</p><div class=page_footer>end</div></body>"),
        (3, "http://h3.example/", "<body><article><header><h1>Title</h1></header><p>hello</p></article></body>"),
    ]
    assert {k: r.text for k, r in texts(spark, rows).items()} == {1: "hello", 2: "hello", 3: "Title\nhello"}


def test_long_pages_are_aligned_too(spark):
    """Pages of thousands of tokens, with long repeated segments, on one host and over many tasks."""
    def page(k: int) -> str:
        parts = "".join(f"<section><h3>Part {j}</h3>" + "".join(f"<p>Line {i} of part {j} of page {k}</p>" for i in range(40)) + "</section>" for j in range(30 + k % 7))
        return f"<html><body><div class=t1><b>The Site</b> <a href=/>Home</a></div><div class=q9><h2>Page {k}</h2>{parts}</div><div class=t2>Imprint</div></body></html>"

    got = texts(spark, [(k, "http://long.example/", page(k)) for k in range(14)])
    for k in range(14):
        lines = [f"Page {k}", *[x for j in range(30 + k % 7) for x in (f"Part {j}", *[f"Line {i} of part {j} of page {k}" for i in range(40)])]]
        assert got[k].wrapped and got[k].text == "\n".join(lines)


def test_hosts_whose_pages_differ_too_much_for_one_wrapper(spark):
    """Every page counts and is read by the host's wrappers, also where those of whole pages would take too many elements."""
    rng = random.Random(3)

    def page(body: str) -> str:
        return f"<html><body><div class=top><b>The Site</b><a href=/>Home</a></div><div class=c1>{body}</div><div class=low>Imprint</div></body></html>"

    def slugs(k: int) -> tuple[str, list]:  # class words of letters that no two elements share
        word = lambda j: "".join(chr(97 + int(c)) for c in f"{k}{j:03}")
        return "".join(f"<p class=w{word(j)}>Par {j} of {k}</p>" for j in range(150)), [f"Par {j} of {k}" for j in range(150)]

    def named(k: int) -> tuple[str, list]:
        return "".join(f"<p class=w{k}-{j}>Par {j} of {k}</p>" for j in range(150)), [f"Par {j} of {k}" for j in range(150)]

    def mixed(k: int) -> tuple[str, list]:  # elements in no order that two pages share
        parts = [(rng.choice(["p", "h3", "pre", "blockquote", "section"]), "".join(f"<{t}>{rng.randrange(9)} of {k}</{t}>" for t in rng.choices(["i", "b", "u", "code", "em", "q"], k=9))) for _ in range(120)]
        return "".join(f"<{t}>{x}</{t}>" for t, x in parts), [re.sub("<.*?>", "", x) for _, x in parts]

    made = [(host, k, *kind(k)) for host, kind in (("named", named), ("slugs", slugs), ("mixed", mixed)) for k in range(36)]
    rows = [(n, f"http://{host}.example/{k}", page(body)) for n, (host, k, body, _) in enumerate(made)]
    rows += [(1000 + k, "http://bare.example/", bare(k)) for k in range(6)]
    got = texts(spark, rows)
    assert all(got[1000 + k].text == bare_text(k) and got[1000 + k].wrapped for k in range(6))
    for n, (_, _, _, lines) in enumerate(made):
        assert got[n].text == "\n".join(lines) and got[n].wrapped


def test_shallow_streams():
    stream = ["<body.x9", "<div.menu", "<a.", "#aa.4", "/a", "#bb.3", "/div", "#cc.2", "<br.", "<p.post", "<i.", "/i", "/p", "/body"]
    assert wrappers.shallow(stream, 9)[0] == ["<body.0", "<div.sidebar", *stream[2:9], "<p.article", *stream[10:]]
    assert wrappers.shallow(stream, -9)[0] == ["<body.", "<div.sidebar", *stream[2:9], "<p.article", *stream[10:]]
    out, places = wrappers.shallow(stream, 2)
    assert [t[:1] if t[0] == "#" else t for t in out] == ["<body.0", "<div.sidebar", "#", "/div", "#", "<br.", "<p.article", "/p", "/body"]
    assert places == [0, 1, 2, 6, 7, 8, 9, 12, 13, 14] and out[2].endswith(".3") and out[4] == "#cc.2"


def test_alignment_of_long_streams_covers_both():
    rng = random.Random(5)
    a = [["t", f"<i.{rng.randrange(3000)}", 0] for _ in range(1500)]
    b = [x for x in a if rng.random() < 0.8]
    b[700:700] = [["t", f"<i.{rng.randrange(9000, 9900)}", 0] for _ in range(300)]
    both = wrappers.Wrapper(wrappers.align(a, b), (0, 1, False))
    assert both.match([x[1] for x in a]) and both.match([x[1] for x in b]) and len(both.elements) < 1900


def test_pages_table(spark, data):
    rows = queries.op5_html_extraction(spark, data).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert not any(x in r.text for x in ("<p>", "</", "track(", "&amp;", "©"))
    empty = spark.createDataFrame([], SCHEMA)
    assert wrappers.main_texts(empty).count() == 0


def test_names_of_headings_and_parts_of_a_line_say_nothing():
    page = """<html><body><div class="menu">Home</div><article><h2 id="search">Search trees</h2><p class="menu-of-the-day">Soup of <span class="navy">blue</span> peas</p>
        <label>A label</label><div class="share">Share this</div><p id="comments">Kept</p></article><div class="navbar">About</div></body></html>"""
    assert wrappers.extract(page, None)[0].split("\n") == ["Search trees", "Soup of blue peas", "A label", "Kept"]


def test_long_pages_take_time_in_proportion():
    many = "<html><body><article>" + "".join(f'<p class="c{k}">text {k}</p>' for k in range(30_000)) + "</article></body></html>"
    broken = "<p>first</p>" + "<a b " * 100_000
    began = time.perf_counter()
    found = wrappers.fold(wrappers.valued(wrappers.tokens(many)))
    assert len(found) > 90_000
    assert wrappers.tokens(broken)[1] == ("#", "", "first")
    assert time.perf_counter() - began < 10


def test_what_does_not_end():
    text = lambda page: [t for _, _, t in wrappers.tokens(page) if t.strip()]
    assert text("a<p>b</p>c<!-- d <b>e</b>") == ["a", "b", "c"] and text("a<p>b</p>c<!-- d") == ["a", "b", "c"]
    assert text("a<script>x</script>b<script>y <b>z</b>") == ["a", "b"] and text("a<script>x</script>") == ["a"] and text("a<b>c</b>d < e") == ["a", "c", "d < e"]
    assert text("a<!-- x -->") == ["a"] and text("") == [] and text("no tags") == ["no tags"]


def without_marks(page: str) -> str:
    """The page with ``div`` for each tag that means something, and classes that say nothing."""
    page = re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|section)\b", r"<\1div", page)
    return re.sub(r'class="([^"]*)"', lambda m: f'class="k{hashlib.md5(m[1].encode()).hexdigest()[:6]}"', page)


def test_wrappers_alone_tell_the_article(spark, data):
    """Pages of which no tag and no class says anything give the texts of the pages as they are."""
    pages = spark.read.parquet(f"{data}/../sf0.01/pages.parquet").collect()  # the smallest table has few pages a host
    often = [h for h in {p.url.split("/")[2] for p in pages} if sum(p.url.split("/")[2] == h for p in pages) >= 4]
    rows = [(p.page_id, p.url, p.html) for p in pages if p.url.split("/")[2] in often]
    marked, blank = texts(spark, rows), texts(spark, [(k, u, without_marks(h)) for k, u, h in rows])
    assert len(rows) >= 100
    assert sum(blank[k].wrapped and blank[k].text == marked[k].text for k in marked) >= 0.9 * len(rows)


def test_menus_and_notices_that_differ_are_not_the_article(spark):
    def page(k: int) -> str:
        menu = "".join(f"<li><a href=/{k}{j}>Topic {k} {j}</a></li>" for j in range(5))
        body = "".join(f"<p>Sentence {j} of story {k} goes on for a while, <a href=/x>see {j}</a>.</p>" for j in range(k % 4 + 2))
        return f"<body><div><ul>{menu}</ul></div><div class=q>Buy {k}</div><div><h1>Story {k}</h1>{body}</div><div>Words {k}</div></body>"

    got = texts(spark, [(k, "http://plain.example/", page(k)) for k in range(9)])
    for k in range(9):
        lines = [f"Story {k}", *[f"Sentence {j} of story {k} goes on for a while, see {j}." for j in range(k % 4 + 2)]]
        assert got[k].wrapped and got[k].text == "\n".join(lines)


def test_menus_beside_an_article_without_an_element_of_its_own(spark):
    def page(k: int) -> str:
        return f"<body><ul><li><a href=/{k}>To {k}</a></li><li><a href=/x{k}>On {k}</a></li></ul><h1>Story {k}</h1><p>All of it stands here, {k}.</p><p>And <a href=/>here {k}</a> as well.</p></body>"

    got = texts(spark, [(k, "http://flat.example/", page(k)) for k in range(6)])
    assert all(got[k].text == f"Story {k}\nAll of it stands here, {k}.\nAnd here {k} as well." for k in range(6))


def test_the_longest_of_several_articles(spark):
    got = texts(spark, [(1, "http://two.example/", "<body><article>teaser</article><article><p>The long one</p><p>goes on</p></article></body>")])
    assert got[1].text == "The long one\ngoes on"


def test_texts_that_are_only_white_space(spark):
    rows = [(k, "http://blank.example/", "<body>" + "<div>\xa0</div>" * (k + 1) + "</body>") for k in range(5)]
    assert all(r.text == "" for r in texts(spark, rows).values())


class Plain(HTMLParser):
    """A twin for pages with one marked article, on the parser of the standard library."""

    OUT = {"nav", "aside", "footer", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "head"}
    BREAKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "section", "table", "tr", "td", "th", "figure", "figcaption", "header", "dl", "dt", "dd", "hr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.depth, self.lines = False, "", 0, [""]

    def handle_starttag(self, tag, attrs):
        if self.inside and not self.out and (tag in self.OUT or tag == "div" and dict(attrs).get("class") in ("ad", "comments", "share", "related", "newsletter", "cookie")):
            self.out, self.depth = tag, 0
        self.depth += tag == self.out
        if tag == "article":
            self.inside = True
        elif tag in self.BREAKS:
            self.lines.append("")
        elif tag == "br" and not self.out:
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag == self.out:
            self.depth -= 1
            self.out = self.out if self.depth else ""
        if tag in self.BREAKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside and not self.out:
            self.lines[-1] += data


def test_pages_table_against_a_plain_parser(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").where("html like '%<article%'").collect()}
    got = {r.page_id: r.text for r in queries.op5_html_extraction(spark, data).collect()}
    assert len(pages) > 20
    for k, r in pages.items():
        twin = Plain()
        twin.feed(r.html)
        assert got[k] == "\n".join(t for x in twin.lines if (t := " ".join(x.split()))), k
