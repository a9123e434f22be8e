"""Operator 6: attributes and words that don't make noise of an article's text."""

import pytest

from tidemark.llm.htmltext import extract


@pytest.mark.parametrize(
    "tag",
    ['a href="/hidden-lake"', 'a title="the hidden side"', 'a href="/p?id=ad"', "a href=/p?id=ad", "a data-id='comment-5'", "p data-id=comment-5", "p data-class=ad", 'p title="class=ad id=ad" class=x', 'p title=\'style="display:none"\''],
)
def test_values_of_other_attributes(tag):
    name = tag.split()[0]
    assert extract(f"<article><div>One <{tag}>two</{name}> three</div></article>") == "One two three"


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN", "class=ad", "class='x ad' title='y'", 'title="a > b" id="comment-5"', "aria-hidden=true", 'style="display: none"', "role=navigation"])
def test_attributes_that_count(attribute):
    assert extract(f"<article><p>One</p><div {attribute}>two</div></article>") == "One"


def test_words_that_name_a_part_of_an_article():
    page = "<div class=page-header>Site</div><div class=side-box>Box</div><article><div class='post-header'><h1>Head</h1></div><div class=article-header>Line</div><p class=side-effects>Two</p><div class=share-links>Share</div></article>"
    assert extract(page) == "Head Line Two"


def test_math():
    assert extract("<p>So <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds.</p>") == "So x=2 holds."
