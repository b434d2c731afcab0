"""Extraction against the article of the given pages, and on pages of other builds."""

import re
from html import unescape

from defectlab.llm import html


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:h1|p)[^>]*>", inner)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.main_text(pages).collect()} == want


def test_parts_left_out():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use</div>
      <main><header><h1>T &amp; A</h1></header><p>One<br>two</p><ul><li>a<li>b</ul><div class="ad">buy</div><form><p>in</form>
      <section class="comments"><article><p>nice</p></article></section><p>a < b</p><script>"</p>"</script></main><footer>f</footer>"""
    assert html.extract(page, frozenset()) == "T & A\nOne two\na\nb\na < b"


def site(i, host="h"):
    body = "".join(f"<p>own text {i} part {k}</p>" for k in range(3))
    return f"<html><body><div class='top'><p>Welcome to us</p><p>All our news</p></div><div class='c'>{body}</div><div class='end'><p>Imprint here</p></div></body></html>"


def test_template_of_a_host(spark):
    """Without an article element, what stands on a host's pages alike is template and the slots are the text."""
    rows = [(i, f"http://h.example/{i}", site(i)) for i in range(6)] + [(9, "http://other.example/", site(9))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert found[2] == "own text 2 part 0\nown text 2 part 1\nown text 2 part 2"
    assert found[9].startswith("Welcome to us")  # one page alone shows no template


def test_classes_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://h.example/{i}", site(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sets = [{r["host"]: sorted(r["tokens"]) for r in html.templates(df.repartition(n)).collect()} for n in (1, 5)]
    assert sets[0] == sets[1] and len(sets[0]["h.example"]) >= html.LEAST_TOKENS


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "no address", ""), (2, "http://x/", "<"), (2, "http://x/", "plain &lt;text&gt;"), (3, "http://x/", "<p " + "a" * 100_000), (4, "http://x/", "<div>" * 5_000 + "deep"), (5, "http://x/", "<script>never closed")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, host string")
    found = html.main_text(df).collect()
    assert sorted(r["text"] for r in found if r["page_id"] == 2) == sorted(["<", "plain <text>"])
    assert [r["text"] for r in found if r["page_id"] in (1, None, 5)] == ["", "", ""]
    assert [r["text"] for r in found if r["page_id"] == 4] == ["deep"]
    assert html.main_text(df.limit(0)).collect() == []


def laid_out(i, kind):
    """Three layouts of a host; each page marks its article, which ends with a line of its layout."""
    own = "".join(f"<p>own {kind} {i} part {k} with words of its own</p>" for k in range(2 + i % 3))
    return f"<html><body><div class='lay{kind}'><p>top of {kind}</p><div class='in{kind}'><article><h2>head {i}</h2>{own}<p>Read more at {kind}</p></article></div><p>end of {kind}</p></div></body></html>"


def test_template_of_marked_pages_and_layouts(spark):
    """Every layout has its own nested classes, a third of the host each; an article keeps the line it shares with others of its layout."""
    rows = [(3 * i + k, "http://h.example/", laid_out(i, "abc"[k])) for i in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert found[4] == "head 1\n" + "\n".join(f"own b 1 part {k} with words of its own" for k in range(3)) + "\nRead more at b"
    made = html.templates(df).first()
    assert len(set(made["classes"])) >= 3  # a class for each layout
    layout = [html._token(f">html.>body.>div.laya{path}", text) for path, text in (("", ""), (">p.", "top of a"), (">p.", "end of a"))]
    assert len({dict(zip(made["tokens"], made["classes"]))[t] for t in layout}) == 1


def test_order_and_nesting():
    """Tokens that change places are told from those that keep them, and classes stand behind a token of the one around."""
    a, b, c, x, y = range(1, 6)
    events = [(a, -1, "", False, False), (x, 0, "", False, False), (y, 0, "", False, False), (x, 0, "", False, False), (y, 0, "", False, False), (b, -1, "", False, False), (c, -1, "", False, False)]
    found = set(html.places(events, {a: 7, b: 7, c: 7, x: 8, y: 8}))
    assert found == {(a, 0, 0), (b, 1, 0), (c, 2, 0), (x, 0, a), (y, 1, a)}


def test_changing_order_is_no_template(spark):
    lines = ["<p>first of all</p>", "<p>second to it</p>", "<p>third of these</p>", "<p>fourth in here</p>"]
    rows = [(i, "http://h.example/", f"<html><body>{''.join(lines[i % 4:] + lines[: i % 4])}<p>own {i}</p></body></html>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(len(r["text"].split("\n")) == 5 for r in html.main_text(df).collect())


def test_copies_of_an_article_stay(spark):
    page = "<html><body><div>menu of us</div><article><h1>One</h1><p>the same text</p><p>and more</p></article><div>end</div></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/", page) for i in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in html.main_text(df).collect()} == {"One\nthe same text\nand more"}


def test_shared_paragraphs_of_articles_stay(spark):
    """Some pages of a host whose articles begin alike: nothing of an article goes, the host's own lines around it do."""
    shared = "".join(f"<p>opening {k} that all of them share</p>" for k in range(3))
    rows = [(i, "http://h.example/", f"<html><body><div>menu of us</div><p>all our news</p><article><h1>Head {i}</h1>{shared}<p>own {i}</p></article><div>imprint</div></body></html>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"].split("\n") for r in html.main_text(df).collect()}
    assert found == {i: [f"Head {i}", *[f"opening {k} that all of them share" for k in range(3)], f"own {i}"] for i in range(6)}


def test_slots_end_at_the_template():
    page = "<html><body><div>a<p>b</p></div><div class='k'>c</div></body></html>"
    cut = html.slots(html.parse(page), frozenset([html._token(">html.>body.>div.k")]))
    assert [[t for t, _, _ in blocks] for _, blocks in cut] == [["a", "b"], ["c"]]
