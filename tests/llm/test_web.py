import gzip
import hashlib
import random

import pytest

from chronoframe.llm import html_text, url_rules, warc

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy, buy, buy, a long advert text, really, with commas, and more.</div>
<div id="cookie-notice">We use cookies, and more of them, on this page.</div>
<div class="wrap"><article><h1>Title &amp; more</h1><p>First, a <b>bold</b>\n paragraph &mdash; of some length, with commas, to be kept.<p>Second<br>line &lt;x&gt; &#233;.</p>
<aside>related</aside><form><input><p>Sign up, please</p></form><ul><li>one<li>two</ul><section class="comments"><p>A reader says, well, a lot.</p></section></article></div>
<div class="sidebar"><p>Popular, posts, here, and there</p></div><footer>&copy; host, all rights, reserved</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst, a bold paragraph — of some length, with commas, to be kept.\nSecond line <x> é.\none\ntwo"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain, text &amp; more", "plain, text & more"), ("<p>a<p>b", "a\nb"), ("</p></div><p>x</p", "x"),
    ("<p>a<script>b", "a"), ("<div><p>One, two</p></div>", "One, two"), ("<nav>a</nav>", ""), ("<p>1 < 2", "1 < 2"), ("<!-- x", ""),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>x</title><body><p>Hello, world, of a head without end</p>", "Hello, world, of a head without end"),
    ("<head><meta charset=utf-8><title>no</title><p>Body, starts here</p>", "Body, starts here"),
    ("<p class=notice>We warn<p>Real, text here.</p><p>More, of it</p>", "Real, text here.\nMore, of it"),
    ('<ul><li class="ad">x<li>real, one<li>real, two</ul><p>tail, text</p>', "real, one\nreal, two\ntail, text"),
    ("<!--><p>a, b</p><!-- c --!><p>c, d</p><!--->", "a, b\nc, d"),
    ("<p>Formula, <math><mi>x</mi><mo>=</mo></math> holds, <svg><title>no</title><path d=1 /></svg>yes.</p>", "Formula, x= holds, yes."),
    ("<p>A <label>label</label>, and <select><option>no<option>no</select>more <button>no</button>text</p>", "A label, and more text"),
    ("<p data-x=it's>One, it is</p><p title='a > b'>two, text</p>", "One, it is\ntwo, text"),
    ("<table><tr><td>a, b<td>c, d<tr class=ad><td>x, y<tr><td>e, f</table><p>g, h, i</p>", "a, b\nc, d\ne, f\ng, h, i"),
    ("<dl><dt>t<dd>d, e<dt>u<dd>v, w</dl>", "t\nd, e\nu\nv, w"),
    ("<ul><li><p>one, two<li><p>three, four</ul>", "one, two\nthree, four"),
    ("<aside><p>no<div>no</aside><p>yes, this</p>", "yes, this"),
    ("<p>a, &am<b>p;</b> &lt;b&gt;</p>", "a, &amp; <b>"),
])
def test_tags_left_out_and_odd_markup(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("attributes, kept", [
    ('class="main-content with-sidebar"', True), ('class="sidebar-content"', False), ('class="content ad"', False), ('id=comment-7', False),
    ("class='post-body'", True), ("hidden", False), ('style="display: none"', False), ('class="overflow-hidden"', True), ('class="downloads"', True), ('role="navigation"', False),
])
def test_names_for_and_against(attributes, kept):
    page = f"<div {attributes}><p>This, is a text of some length, with commas.</p></div><div><p>Other, text.</p></div>"
    assert ("This, is" in html_text.main_text(page)) == kept


LONG = "This is a sentence of the article, with commas, and it goes on for a while so that it is long."


@pytest.mark.parametrize("page, text", [
    (f"<div class=c1>{LONG}<br><br>{LONG} <b>Bold</b> end.<br><br>{LONG}</div><div><p>short note</p></div>", f"{LONG} {LONG} Bold end. {LONG}"),
    (f"<section>{LONG}<br>{LONG}<br>{LONG}<br>{LONG}</section><div><p>note</p></div>", " ".join([LONG] * 4)),
    ("<div><div>" + f"<p>{LONG}</p>" * 9 + f"</div><p>Short.</p><ul><li>one<li>two</ul>bare <i>text</i><table><tr><td>cell</table><p><a href=x>only a link</a></p><div>" + f"<p>{LONG}</p>" * 4 + "</div><p>After.</p></div>",
     "\n".join([LONG] * 9 + ["Short.", "one", "two", "bare text", "cell"] + [LONG] * 4)),
])
def test_text_outside_paragraphs_and_short_siblings(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20000 + "<p>deep, text</p>") == "deep, text"
    many = "".join(f"<p>Paragraph {i}, of a long page, <i>with</i> items<ul><li>one<li>two</ul>" for i in range(20_000))
    assert html_text.main_text(f"<main>{many}</main>").count("\n") == 3 * 20_000 - 1
    assert html_text.main_text("<div class=ad>" * 20000 + "</div>" * 20000 + "<p>kept, text</p>") == "kept, text"
    body = "<p>" + "word, " * 200_000 + "</p>"
    assert len(html_text.main_text(f"<article>{body}</article>")) > 1_000_000


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (None, None, None, "t"), (1, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    found = html_text.extract(rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert html_text.extract(rows.where("false")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(2)
    bodies = [None, "", "x" * 99, "y" * 100, "é" * 60, "z" * 400_000] + ["".join(rng.choice("abc ") for _ in range(300)) for _ in range(20)]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 9 else None, bodies[i % 26], 1) for i in range(120)] + [(0, "again", bodies[0], 1), (3, "again", bodies[3], 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    index = warc.write_archives(pages, "file://" + str(tmp_path / "w"))
    found = warc.read_records(index).collect()
    first = {}
    for i, _, body, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(body or "", i)
    want = []
    for i, _, body, _ in rows:
        data = (body or "").encode()
        again = len(data) >= 100 and first[body or ""] != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[body or ""] if again else None))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == sorted(want, key=lambda w: w[:4])
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in found)
    some = warc.read_records(index.where("page_id % 10 = 4")).collect()
    assert sorted(r["page_id"] for r in some) == list(range(4, 120, 10))
    one = index.first()
    with open(tmp_path / "w" / one["archive"], "rb") as f:
        f.seek(one["offset"])
        assert gzip.decompress(f.read(one["length"])).startswith(b"WARC/1.1\r\n")
    assert warc.read_records(warc.write_archives(pages.where("false"))).count() == 0


def test_ranges_are_joined_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(warc, "MAX_READ", 100)
    monkeypatch.setattr(warc, "MAX_GAP", 10)
    rows = [("f", "a", 0, 40), ("f", "a", 45, 40), ("f", "a", 85, 40), ("f", "a", 200, 500), ("f", "b", 0, 5)]
    assert [len(r) for r in warc._ranges(iter(rows))] == [2, 1, 1, 1]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    best = max(fits, key=lambda f: (*f[:2], f[3] == "block"), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("ranged", [False, True])
def test_rules_agree_with_brute_force(spark, monkeypatch, ranged):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "org", "com", "x-y", "a0"])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "/" + "/".join(rng.choice(["", "e", "en", "1", "12"]) for _ in range(rng.randrange(3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(rng.randrange(1, 4)), rng.choice(["", path()])) for _ in range(150))}.values())
    rules += [("", "/12", "block"), *url_rules.RULES]
    urls = [None, "", "nothing", "http://", "x://ORG", "http://org?x", "http://a.org#/e", "a://b://c/d", "http://example.org/en/12?x"]
    urls += [f"https://{host(rng.randrange(1, 5))}{rng.choice(['', path(), path() + '?q=/e#f'])}" for _ in range(400)] * 2
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    if ranged:
        monkeypatch.setattr(url_rules, "MAX_LOCAL_RULES", 10)
    found = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string") if ranged else rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(found) == len(urls) and url_rules.judge(pages.where("false")).count() == 0
