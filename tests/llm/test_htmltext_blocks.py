"""Operator 6: blocks outside an article, and small sites."""

from tidemark.llm.htmltext import extract, main_text


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_text_outside_an_article_stays():
    assert extract("<h1>Title</h1><article><p>One</p></article><div><p>Two</p></div>") == "Title One Two"
    assert extract("<article class=card><p>Teaser</p></article><div class=body><p>Body one</p><p>Body two</p></div>") == "Teaser Body one Body two"


def test_importance_decides_outside_an_article(spark):
    page = "<div class=top>Latest deals here</div><h1>Title {0}</h1><article><p>Story {0} about {0} and more</p></article><div class=rest>End of {0}</div>"
    got = texts(spark, [(k, f"http://a.example/{k}", page.format(k)) for k in range(8)])
    assert got == {k: f"Title {k} Story {k} about {k} and more End of {k}" for k in range(8)}


def test_sites_of_few_pages(spark):
    page = "<div class=top>Latest deals here</div><div class=x><p>A long enough story {0} about {0} and what came after {0}</p></div>"
    copy = "<div class=date>{0}</div><p>The same long text on two pages of one site, but for its date.</p>"
    article = "<div class=top>Top</div><article><p>The same text in an article.</p><p>Page {0}</p></article>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(3)]
    rows += [(k, f"http://b.example/{k}", copy.format(k)) for k in (10, 11)]
    rows += [(k, f"http://c.example/{k}", article.format(k)) for k in (20, 21)]
    want = {k: f"A long enough story {k} about {k} and what came after {k}" for k in range(3)}
    want |= {k: f"{k} The same long text on two pages of one site, but for its date." for k in (10, 11)}
    want |= {k: f"The same text in an article. Page {k}" for k in (20, 21)}
    assert texts(spark, rows) == want


def test_the_tree_finds_frames_by_itself(spark):
    """Navigation and footer have low importance by their texts, whatever they are called; articles don't."""
    from tidemark.llm.htmltext import blocks_of, extract, low_branches

    page = "<body><div class=q1><ul><li>Home</li><li>About us</li></ul></div><nav><a>Start</a></nav><div class=q2><p>Story {0} of day {0}</p></div><footer>All rights held</footer></body>"
    html = [page.format(k) for k in range(8)]
    low = {r.path for r in low_branches(spark.createDataFrame([(f"http://h.example/{k}", h) for k, h in enumerate(html)], "url string, html string")).collect()}
    every = {text: path for path, _, text, _ in blocks_of(html[0], every=True)}
    assert {t for t, p in every.items() if p in low} == {"Home", "About us", "Start", "All rights held"}
    assert extract(html[3], low) == "Story 3 of day 3"
