"""Operator 6: extraction from planted pages."""

import re
from html import unescape

import pyarrow.parquet as pq

from tidemark.llm.htmltext import extract, main_text

SF = "/root/testdata/sf0.001"


def test_kinds_of_noise():
    html = """<!DOCTYPE html><HTML><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Head &amp; line</h1></header>
    <p>One <b>two</b><br>three&nbsp;four</p><script>var a="</p><p>no";</script><form><label>Mail</label><input></form>
    <!-- <p>hidden</p> --><ul><li>a<li>b</ul><p>x < y and 1 &lt; 2<aside>side</aside><div class="share-links">Share</div>
    <p hidden>gone</p></article><section id="comments"><p>First!</p></section></main><div class="sidebar"><p>more</p></div><footer>(c)</footer></body></html>"""
    assert extract(html) == "Head & line One two three four a b x < y and 1 < 2"


def test_without_article():
    assert extract("<div>One<div>two</div>three</div><div class=ad>buy</div>tail") == "One two three tail"
    assert extract("") == ""
    assert extract("plain &eacute; text") == "plain é text"
    assert extract("<p>cut off <a hre") == "cut off"


def test_whole_table(spark):
    pages = {r["page_id"]: r for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    from tidemark.llm.queries import op6_main_text

    got = {r.page_id: r for r in op6_main_text(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if b.startswith("<br") else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        want = " ".join(b for b in blocks if b)
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == p["url"]


def test_style_tree_removes_what_a_site_repeats(spark):
    page = "<div class=top>Latest deals here</div><div class=x><p>Story {0} about {0}</p><div class=y>Read our other stories</div></div>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(12)] + [(99, "http://b.example/", page.format("b")), (None, None, None), (5, "http://a.example/5", page.format(5))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as low", "'h' as host")
    got = [(r.page_id, r.text) for r in main_text(frame).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 99) == sorted((k, f"Story {k} about {k}") for k in [*range(12), 5])
    assert (99, "Latest deals here Story b about b Read our other stories") in got and (None, "") in got
    assert main_text(spark.createDataFrame([], frame.schema)).collect() == []


def test_site_of_one_page_again_and_again(spark):
    rows = [(k, f"http://a.example/{k}", "<p>Same text</p>") for k in range(9)]
    assert {r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()} == {"Same text"}
