"""Operator 6: main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: a node is the chain of (tag, class, id) from the root.  A text
block's node has two importances, both from how a host's different pages vary there: of presentation (entropy of the
inline mark-up sequences) and of content (one minus the mean entropy of the texts: a text that stands on all pages says
nothing about one).  Branches of low composite importance are removed from each page, besides those whose mark-up
already says that they are no article (navigation, footers, adverts, forms, comments and so on).  Standing in an
article or main element is evidence for a node, and blocks outside of one stay if they are important.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg annotation annotation-xml object canvas select button audio video".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu head fieldset".split()) | RAW
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math semantics menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover""".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class, id or role that mark what is no article.
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar side comment comments
    commentlist respond disqus discussion replies reply nav navbar navigation menu breadcrumb breadcrumbs footer header masthead
    cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing
    related recommended recommendations widget widgets pagination pager skip toolbar copyright legal disclaimer alert""".split()
)
# Such of them that name a part of an article as well ("post-header", "side-effects"): they count outside an article only.
OUTSIDE_WORDS = frozenset("side header masthead banner notice alert legal disclaimer discussion overlay skip".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Pages of a host, different from each other, from which on its tree counts; and the least importance that stays.
LEAST_PAGES = 2
LEAST_IMPORTANCE = 0.2
#: Pages under which two copies of a text may be all of a host: there articles stay, and pages that would lose over half.
FEW_PAGES = 5
#: What standing in an article adds to a node's importance.
ARTICLE = 0.1
#: Share of content in the composite importance of a node with one content child.
DAMPING = 0.9
#: Bytes up to which the low branches are broadcast; more are joined by host.
BROADCAST_BYTES = 8 << 20


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


class Style:
    """What a tag and its attributes say: its step in the path and whether it is no article, or none unless inside one."""

    __slots__ = ("step", "noise", "outside", "main")

    def __init__(self, tag: str, attributes: str) -> None:
        got: dict[str, str] = {}
        for k, v in _ATTR.findall(attributes) if attributes.strip() else ():
            got.setdefault(k.lower(), v.strip("\"'"))  # of a repeated attribute the first counts
        name = f"{got.get('class', '')} {got.get('id', '')}".strip()
        self.step = f"{tag}.{re.sub(r'[0-9]+', '0', name)}" if name else tag
        words = {w.lower() for w in _WORD.findall(name)}
        hidden = "hidden" in got and got["hidden"].lower() != "false" or got.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(got.get("style", "")))
        role = got.get("role", "").lower()
        self.main = tag in ("article", "main") or role in ("main", "article")
        named = tag not in ("html", "body") and not (self.main and not words & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"})
        self.noise = tag in NOISE_TAGS or hidden or role in NOISE_ROLES or (named and bool(words & (NOISE_WORDS - OUTSIDE_WORDS)))
        # a header counts as the site's unless it stands in an article
        self.outside = not self.main and (tag == "header" or named and bool(words & OUTSIDE_WORDS))


_styles: dict[tuple[str, str], Style] = {}
_paths: dict[tuple[int, str], int] = {}


def _style(tag: str, attributes: str) -> Style:
    key = (tag, attributes)
    got = _styles.get(key)
    if got is None:
        if len(_styles) > 50_000:
            _styles.clear()
        got = _styles[key] = Style(tag, attributes)
    return got


def _path(parent: int, step: str) -> int:
    key = (parent, step)
    got = _paths.get(key)
    if got is None:
        if len(_paths) > 200_000:
            _paths.clear()
        got = _paths[key] = xxhash.xxh64_intdigest(step.encode("utf-8", "replace"), parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
    return got


def blocks_of(html: str, every: bool = False) -> list[tuple[int, bool, str, str]]:
    """(path, inside an article, text, inline mark-up) of each text block of a page that its mark-up doesn't rule out.

    every: blocks that are ruled out as well; inline elements that are ruled out never count.
    """
    out: list[tuple[int, bool, str, str]] = []
    # tag, noise, inside main, path of the nearest block, whether that block is noise
    stack: list[tuple[str, bool, bool, int, bool]] = [("", False, False, 0, False)]
    text: list[str] = []
    marks: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                _, _, main, path, _ = stack[-1]
                out.append((path, main, line, ",".join(marks)))
            text.clear()
        marks.clear()

    def read() -> bool:
        """Whether text at this place counts."""
        return not stack[-1][1] or every and stack[-1][4]

    at, size = 0, len(html)
    find = _TOKEN.search
    while at < size:
        m = find(html, at)
        if m is None:
            if read():
                rest = html[at:]
                cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", rest)  # a tag that the page's end cuts off
                text.append(rest[: cut.start()] if cut else rest)
            break
        start, end = m.span()
        if start > at and read():
            text.append(html[at:start])
        at = end
        tag = m[2]
        if tag is None:
            if html.startswith("<![CDATA[", start) and read():
                text.append(html[start + 9 : end - 3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag in ("br", "p") and tag != "br" and not any(s[0] == "p" for s in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and any(s[0] not in INLINE for s in stack[k + 1 :]):
                        break  # an inline element that a block has closed before
                    if tag not in INLINE:
                        flush()
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = _raw_end(tag).search(html, end)
                at = stop.end() if stop else size
            continue
        if tag in INLINE:
            marks.append(tag)
            if tag in ("br", "img", "wbr"):
                if tag == "br" and read():
                    text.append(" ")
                continue
            style = _style(tag, m[3])
            top = stack[-1]
            stack.append((tag, top[1] or style.noise or (style.outside and not top[2]), top[2], top[3], top[4]))
            continue
        flush()
        if tag in VOID:
            continue
        for k in range(len(stack) - 1, 0, -1):  # implied ends
            name = stack[k][0]
            if name in CLOSED_BY_BLOCK and tag not in INLINE or name == tag and tag in SAME_CLOSES:
                del stack[k:]
                break
            if name not in INLINE and (tag not in SAME_CLOSES or name in SAME_CLOSES[tag]):
                break
        while len(stack) > 1 and stack[-1][0] in INLINE and stack[-1][0] != "a":
            stack.pop()
        style = _style(tag, m[3])
        top = stack[-1]
        noise = top[1] or style.noise or (style.outside and not top[2])
        stack.append((tag, noise, top[2] or style.main, _path(top[3], style.step), noise))
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def extract(html: str, low: frozenset[int] | set[int] = frozenset(), few: bool = False) -> str:
    """The main text of one page, given the low branches of its host and whether it has few pages."""
    found = blocks_of(html)
    high = [b for b in found if b[0] not in low] if low else found
    if few and 2 * sum(len(b[2]) for b in high) < sum(len(b[2]) for b in found):
        high = found  # rather two near copies than a frame around two texts
    found = high or found  # a host that has one page again and again has no branch that tells pages apart
    return " ".join(b[2] for b in found)


def low_branches(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, m) of each style node that is not important on its host, on m pages.

    Equal pages of a host count once.  For a node on m different pages, a text on c of them has entropy log c / log m;
    content importance is one minus the mean over the node's different texts, presentation importance the entropy of
    its mark-up sequences; composite = 0.9 content + 0.1 presentation, and 0.1 more in an article.  A node in an article
    on fewer than FEW_PAGES pages is important.  Every block counts here, also those that the mark-up rules out later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for url, html in zip(batch.column("_url").to_pylist(), batch.column("_html").to_pylist()):
                host, page = host_of(url), xxhash.xxh64_intdigest((html or "").encode("utf-8", "replace")) - (1 << 63)
                for path, main, text, marks in blocks_of(html or "", every=True):
                    seen.add((host, path, main, page, xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 1) - (1 << 63), xxhash.xxh64_intdigest(marks.encode(), 2) - (1 << 63)))
            if seen:
                host, path, main, page, text, marks = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(main), *[pa.array(x, pa.int64()) for x in (page, text, marks)]], ["host", "path", "main", "page", "text", "marks"])

    seen = written(pages.select(F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html")).mapInArrow(run, "host string, path bigint, main boolean, page bigint, text bigint, marks bigint"), "styles")
    page_count = seen.groupBy("host", "path", "page").agg(F.max("main").alias("main")).groupBy("host", "path").agg(F.count("*").alias("m"), F.max("main").alias("main")).where(F.col("m") >= LEAST_PAGES)

    def counted(what: str) -> DataFrame:
        return seen.groupBy("host", "path", "page", what).agg(F.lit(1).alias("one")).groupBy("host", "path", what).agg(F.count("*").alias("c"))

    content = counted("text").groupBy("host", "path").agg(F.avg(F.log(F.col("c").cast("double"))).alias("mean"))
    shape = counted("marks").groupBy("host", "path").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clog"))
    both = page_count.join(content, ["host", "path"]).join(shape, ["host", "path"])
    logm = F.log(F.col("m").cast("double"))
    content_importance = 1 - F.least(F.lit(1.0), F.col("mean") / logm)
    presentation = F.least(F.lit(1.0), (F.log(F.col("all").cast("double")) - F.col("clog") / F.col("all")) / logm)
    importance = DAMPING * content_importance + (1 - DAMPING) * presentation + F.when(F.col("main"), ARTICLE).otherwise(0.0)
    return both.where((importance < LEAST_IMPORTANCE) & ~(F.col("main") & (F.col("m") < FEW_PAGES))).select("host", "path", "m")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row of pages.

    Null and empty html give the empty text; a page gives what is left of its body, inside an article or not;
    null urls and such without host share one tree.  Broken, unclosed and cut-off mark-up is read as far as it goes.
    Ids may be null or repeated, extra columns are ignored, an empty table gives no rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    low = written(low_branches(pages, url_col, html_col).groupBy("host").agg(F.collect_list("path").alias("low"), (F.max("m") < FEW_PAGES).alias("few")), "low")
    size = low.agg(F.sum(F.length("host") + 8 * F.size("low") + 16)).first()[0] or 0
    picked = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("_url").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    if size:
        picked = picked.withColumn("host", host).join(F.broadcast(low) if size <= BROADCAST_BYTES else low, "host", "left").drop("host")
    else:
        picked = picked.withColumn("low", F.lit(None).cast("array<bigint>")).withColumn("few", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", set(low or ()), bool(few)) for h, low, few in zip(*(batch.column(c).to_pylist() for c in ("_html", "low", "few")))]
            n = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(n)], ["_id", "_url", "text", "n_chars"])

    done = picked.mapInArrow(run, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string, n_chars bigint")
    return done.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
