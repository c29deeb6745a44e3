"""Bodies and lists of pages by their structure: the densest block, a source's own class, elements by selectors."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import latest_in
from .html_tree import Tree, without_marks
from .text import without_boilerplate

#: Words in a block's class or id by which it is none of the article's.
NOISE_WORDS = (
    "nav", "navigation", "menu", "footer", "foot", "bottom", "header", "head", "topbar", "top-bar", "aside", "sidebar", "side-bar", "right-bar", "comment", "comments", "comment-list", "social", "share", "sharing", "share-btn", "ad", "ads", "advert",
    "advertisement", "promo", "banner", "breadcrumb", "crumbs", "location", "pagination", "pager", "page-nav", "related", "recommend", "hot-topic", "widget", "widgets", "tool", "login", "signin", "signup", "register", "auth", "search", "searchbox",
    "search-form", "logo", "brand", "branding", "copyright", "sitemap", "friend-link", "subscribe", "newsletter", "email", "qrcode", "qr-code", "wechat", "weixin", "weibo", "video", "audio", "player", "media", "download", "app", "mobile", "tag",
    "tags", "label", "author", "writer", "about-author",
)
#: Words of blocks that are an article's, weights of tags, where articles lie, in this order.
CONTENT_WORDS = ("article", "main", "post", "entry", "text", "content", "article-content", "news-content")
WEIGHTS = {"article": 1.5, "main": 1.4, "section": 1.2, "div": 1.0, "p": 1.1}
PLACES = (
    'div[class*="main_box"]', 'div[class*="rm_txt"] div[class*="col-1"]', 'div[class*="rm_txt"]', 'div[class*="rm_txt_con"]', 'div[class*="TRS_Editor"]', 'div[class*="article-content"]', 'div[class*="news-content"]', 'div[class*="news_text"]',
    'div[class*="content"]', "article", 'article[class*="content"]', 'article[class*="article"]', "main", 'main[class*="content"]', 'div[class*="article"]', 'div[class*="post"]', 'div[class*="text"]', 'div[class*="entry"]', 'div[class*="detail"]',
    'section[class*="content"]', 'section[class*="article"]', 'div[class="content"]', 'div[id="content"]',
)
BLOCKS = "div[class], article, section"
#: Classes tried for a source whose own class finds nothing; lines that are no part of an article, in this order.
SPARE_CLASSES = ("rm_txt", "rm", "txt", "content")
ENDINGS = (
    r"^责任编辑：.*$", r"^责编：.*$", r"^编辑：.*$", r"^作者：.*$", r"^本文结束.*$", r"^如需转载.*$", r"^热门排行.*$", r"^热门推荐.*$", r"^相关推荐.*$", r"^推荐阅读.*$", r"^上一篇\s*$", r"^下一篇\s*$", r"^关注公众号.*$", r"^分享.*$", r"^微信扫一扫.*$",
    r"^【广告】.*$", r"^[|\-=]{3,}$", r"(?i)^©.*版权.*$",
)
_ENDINGS = [re.compile(p, re.M) for p in ENDINGS]
ARTICLE = "struct<method: string, score: double, size: int, content: string>"


def _dense(text: str) -> int:
    return sum(map(len, text.split()))


def cleaned(text: str) -> str:
    for p in _ENDINGS:
        text = p.sub("", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class Page:
    """A page's tree with what its blocks are judged by."""

    def __init__(self, html: str, tails: bool) -> None:
        tree = self.tree = Tree(html)
        self.tails = tails
        dense = [_dense(t) for t in tree.texts]
        self.size = tree.sums([_dense(without_marks(t)) if tails or head else 0 for t, head in zip(tree.texts, tree.heads, strict=True)])
        self.whole = tree.sums(dense)
        self.linked = [0] * len(tree.tags)
        for e in range(len(tree.tags) - 1, 0, -1):
            self.linked[tree.parents[e]] += self.whole[e] if tree.tags[e] == "a" else self.linked[e]
        raw = tree.sums([len(t) for t in tree.texts])
        told = [0]
        for tag, n in zip(tree.tags, raw, strict=True):
            told.append(told[-1] + (tag == "p" and n > 20))
        self._noise: dict[int, bool] = {}
        self.paragraphs = [told[tree.ends[e] + 1] - told[e + 1] for e in range(len(tree.tags))]

    def _names(self, e: int) -> str:
        own = self.tree.attributes[e]
        return f"{own.get('class', '')} {own.get('id', '')}".lower()

    def _is_noise(self, e: int) -> bool:
        if e not in self._noise:
            self._noise[e] = any(w in self._names(e) for w in NOISE_WORDS)
        return self._noise[e]

    def score(self, e: int) -> float:
        """From 0 to 1, by tag, text to links, length, paragraphs and the words of class and id."""
        n = self.whole[e]
        length = 0.2 if n < 50 else 0.5 if n < 200 else 0.8 if n < 1000 else 1.0
        density = min(1.0, n / (self.linked[e] + 1) / 100)
        named = 0.2 if any(w in self._names(e) for w in CONTENT_WORDS) else 0.0
        return min(1.0, WEIGHTS.get(self.tree.tags[e], 0.8) * 0.2 + density * 0.25 + length * 0.25 + min(1.0, self.paragraphs[e] / 3) * 0.2 + named)

    def longest(self, selectors: Iterable[str], least: int = 100) -> tuple[int, str] | None:
        """Of the blocks that the selectors find the one with most text, by score where equal, then by selector; and its selector."""
        best = None
        for i, selector in enumerate(selectors):
            for e in self.tree.select(selector):
                if self.size[e] >= least and not self._is_noise(e):
                    key = (-self.size[e], -self.score(e), i, e)
                    if best is None or key < best[0]:
                        best = (key, (e, selector))
        return best and best[1]

    def result(self, method: str, e: int) -> dict:
        return {"method": method, "score": self.score(e), "size": self.size[e], "content": cleaned(self.tree.text(e, self.tails))}


def own_selectors(pattern: str) -> list[list[str]]:
    """What a source's pattern for bodies says of their place: the first word of its class, then usual classes of its tag."""
    own = re.search(r'class="([^"]+)"', pattern)
    tag = re.search(r"<([a-z]+)", pattern, re.I)
    first = [[f'div[class*="{own.group(1).split()[0]}"]']] if own and own.group(1).split() else []
    return first + [[f'{tag.group(1).lower()}[class*="{c}"]'] for c in SPARE_CLASSES if tag]


def article(html: str | None, pattern: str | None = None, tails: bool = False) -> dict:
    """The body of a page: by its source's own class if that gives 500 characters, else by the places that articles have, else
    of any block, both with 100, else all its text, with 100. One pass reads the page, each step only looks up what it found.

    tails: whether text behind an element's first child counts. It does not by the rule that this follows.
    """
    nothing = {"method": "none", "score": 0.0, "size": 0, "content": ""}
    if not html or not html.strip():
        return nothing
    page = Page(html, tails)
    for selectors in own_selectors(pattern) if pattern else ():
        if found := page.longest(selectors):
            own = page.result(f"source: {found[1]}", found[0])
            if len(own["content"]) >= 500:
                return own
            break
    found = page.longest(PLACES)
    own = page.result(f"place: {found[1]}", found[0]) if found else None
    if not found and (found := page.longest([BLOCKS])):
        own = page.result("block", found[0])
    if own and len(own["content"]) >= 100:
        return own
    everything = re.sub(r"\s+", " ", " ".join(page.tree.pieces(0))).strip()
    if len(everything) >= 100:
        return {"method": "text", "score": 0.0, "size": _dense(everything), "content": cleaned(everything)}
    return nothing


def article_of(html: Column, pattern: Column | None = None, tails: bool = False) -> Column:
    """A struct of method, score, size (characters without white space) and content of a page; pattern: its source's own, or null."""

    def run(pages: pa.Array, patterns: pa.Array) -> pa.Array:
        rows = [article(h.as_py(), p.as_py(), tails) for h, p in zip(pages, patterns, strict=True)]
        return pa.array(rows, pa.struct([("method", pa.string()), ("score", pa.float64()), ("size", pa.int32()), ("content", pa.string())]))

    return F.arrow_udf(run, ARTICLE)(html, F.lit(None).cast("string") if pattern is None else pattern)


@dataclass(frozen=True)
class ListRule:
    """How a list page is read that has its articles on it: selectors of items, and below an item of its title, content and date.

    spare_title: tried where title finds nothing. date_attribute: the date is that attribute, else what the element's text says.
    product_only: a title is what stands in brackets at its start. title_cut: a pattern that goes from titles.
    """

    item: str = "li"
    title: str = "div.pr-news-tit a.blue"
    content: str = "div.pr-news-txt"
    date: str = "div.pr-news-tit span"
    spare_title: str = ""
    date_attribute: str = ""
    product_only: bool = False
    title_cut: str = ""


RULE = "struct<item: string, title: string, content: string, date: string, spare_title: string, date_attribute: string, product_only: boolean, title_cut: string>"


def rule(r: ListRule) -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in asdict(r).items()))


def items(html: str | None, r: ListRule) -> list[dict]:
    """The items of a list page that have a title of over two characters, with the texts of title, date and content."""
    if not html or not html.strip():
        return []
    tree = Tree(html)
    found = {s: tree.select(s) if s else [] for s in (r.title, r.spare_title, r.content, r.date)}
    out = []
    for item in tree.select(r.item):
        below = {s: tree.below(item, f) for s, f in found.items()}
        titled = below[r.title] or below[r.spare_title]
        if not titled:
            continue
        dates = below[r.date]
        date = None
        if dates:
            date = tree.attributes[dates[0]].get(r.date_attribute, "") if r.date_attribute else "".join(tree.pieces(dates[0]))
        title = "".join(tree.pieces(titled[0], tree.below(titled[0], found[r.date])))
        if r.product_only and (bracketed := re.match(r"\s*\[([^\]]+)\]", title)):
            title = bracketed.group(1).strip()
        if r.title_cut:
            title = re.sub(r.title_cut, "", title).strip()
        title = re.sub(r"\s+", " ", title).strip()
        if len(title) > 2:
            out.append({"title": title, "date": date, "content": " ".join(tree.pieces(below[r.content][0])) if below[r.content] else ""})
    return out


def list_items(html: Column, with_rule: Column) -> Column:
    """An array of (title, date, content) of a list page by a rule (see rule), in the page's order."""

    def run(pages: pa.Array, rules: pa.Array) -> pa.Array:
        rows = [[] if r.as_py() is None else items(h.as_py(), ListRule(**r.as_py())) for h, r in zip(pages, rules, strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("title", pa.string()), ("date", pa.string()), ("content", pa.string())])))

    return F.arrow_udf(run, "array<struct<title: string, date: string, content: string>>")(html, with_rule)


def listed(pages: DataFrame, html_col: str, rule_col: str) -> DataFrame:
    """A row for each item: the pages' other columns, place, title, subtitle, publish_time and content. A page without a rule has none.

    A date is the latest in the text of its element, in the form it has there, or an attribute as it is; a content loses its boilerplate.
    """
    rest = [c for c in pages.columns if c not in (html_col, rule_col)]
    found = pages.select(*rest, F.col(rule_col)["date_attribute"].alias("_attribute"), F.posexplode(list_items(F.col(html_col), F.col(rule_col))).alias("place", "item"))
    content = F.when(F.col("item.content") == "", "").otherwise(without_boilerplate(F.col("item.content")))
    told = F.when(F.col("_attribute") == "", latest_in(F.col("item.date"))).otherwise(F.col("item.date"))
    out = found.select(*rest, "place", F.col("item.title").alias("title"), F.coalesce(told, F.lit("")).alias("publish_time"), content.alias("content"))
    return out.withColumn("subtitle", F.left("content", F.lit(300)))
