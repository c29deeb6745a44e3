"""Bodies by structure against a recursive version over a tree of its own; pages that would be slow to read; selectors."""

import random
import re
import time
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidemark.functions import structure
from tidemark.functions.html_tree import Tree, parsed
from tidemark.functions.structure import ListRule, article, items


def random_page(r, depth=0):
    """Well-formed, so that any reader sees the same tree."""
    words = lambda n: " ".join(r.choice(["one", "two", "three", "seven", "责任编辑：x", "ab"]) for _ in range(r.randint(0, n)))
    if depth > 4:
        return words(12)
    parts = [words(20)]
    for _ in range(r.randint(0, 4)):
        tag = r.choice(["div", "div", "section", "article", "span", "b", "main", "h2", "ul"]) if depth < 4 else "em"
        names = {k: r.choice(["content", "article text", "x", "rm_txt", "col-1 z", "sidebar", "entry main_box"]) for k in ("class", "id") if r.random() < 0.5}
        parts.append(f"<{tag}" + "".join(f' {k}="{v}"' for k, v in names.items()) + f">{random_page(r, depth + 1)}</{tag}>{words(4)}")
    if r.random() < 0.4:
        parts.append(f"<p>{words(30)}</p>{words(3)}<a>{words(10)}</a>")
    return "".join(parts)


def plain_article(html):
    root = ElementTree.fromstring(f"<root>{html}</root>")
    above = {c: p for p in root.iter() for c in p}
    names = lambda e: f"{e.get('class', '')} {e.get('id', '')}".lower()
    dense = lambda t: len(re.sub(r"\s+", "", t))

    def text(e):
        out = (e.text or "").strip()
        for c in e:
            below = text(c)
            if below:
                out += ("\n" if c.tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li") else " ") + below
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", out)).strip()

    def score(e):
        n, linked = dense("".join(e.itertext())), 0
        for a in e.iter("a"):
            up = above.get(a)
            while a is not e and up is not e and up.tag != "a":
                up = above[up]
            if a is not e and up is e:
                linked += dense("".join(a.itertext()))
        paragraphs = sum(p is not e and len("".join(p.itertext())) > 20 for p in e.iter("p"))
        named = 0.2 if any(w in names(e) for w in structure.CONTENT_WORDS) else 0.0
        return min(1.0, structure.WEIGHTS.get(e.tag, 0.8) * 0.2 + min(1.0, n / (linked + 1) / 100) * 0.25 + (0.2 if n < 50 else 0.5 if n < 200 else 0.8 if n < 1000 else 1.0) * 0.25 + min(1.0, paragraphs / 3) * 0.2 + named)

    def fits(e, selector):
        *outer, last = selector.split(" ")
        tag, _, test = last.partition("[")
        if e.tag != tag or test and ("*=" in test and re.search('"(.*)"', test).group(1) not in e.get(test.split("*")[0], "") or "*=" not in test and e.get(test.split("=")[0]) != re.search('"(.*)"', test).group(1)):
            return False
        while outer:
            e = above.get(e)
            if e is None:
                return False
            if fits(e, " ".join(outer)):
                return True
        return True

    order = list(root.iter())[1:]
    for selectors in (structure.PLACES, None):
        found = []
        for i, s in enumerate(selectors or ["blocks"]):
            for k, e in enumerate(order):
                if (fits(e, s) if selectors else e.tag in ("article", "section") or e.tag == "div" and "class" in e.attrib) and not any(w in names(e) for w in structure.NOISE_WORDS) and dense(text(e)) >= 100:
                    found.append((-dense(text(e)), -score(e), i, k, e, s))
        if found:
            best = min(found, key=lambda x: x[:4])
            content = structure.cleaned(text(best[4]))
            if len(content) >= 100:
                return (f"place: {best[5]}" if selectors else "block", round(-best[1], 9), content)
            break
    everything = re.sub(r"\s+", " ", " ".join(t.strip() for t in root.itertext() if t.strip())).strip()
    return ("text", 0.0, structure.cleaned(everything)) if len(everything) >= 100 else ("none", 0.0, "")


def test_articles_of_random_pages():
    r, methods = random.Random(4), set()
    for _ in range(400):
        html = random_page(r)
        own = article(html)
        assert (own["method"], round(own["score"], 9), own["content"]) == plain_article(html), html
        methods.add(own["method"].split(":")[0])
    assert methods == {"place", "block", "text", "none"}


def test_cascade_and_tails(spark):
    body = "<p>" + "many words of a body " * 30 + "</p>"
    own = '<div class="own_box text cf" id="x">(.*?)</div>'
    pages = [(f'<div class="own_box">{body}</div>', own, 'source: div[class*="own_box"]'), (f'<div class="rm_txt">{body}</div>', own, 'source: div[class*="rm_txt"]'), (f'<div class="rm_txt">{body[:200]}', own, 'place: div[class*="rm_txt"]'), (f"<main>{body}", own, "place: main"), (f'<div class="q">{body}', None, "block"), (body, None, "text"), ("<p>short", own, "none"), ("", own, "none"), (" ", None, "none"), (None, None, "none")]
    df = spark.createDataFrame([(h, p) for h, p, _ in pages], "html string, pattern string")
    assert [r.m for r in df.select(structure.article_of(F.col("html"), F.col("pattern"))["method"].alias("m")).collect()] == [m for _, _, m in pages]
    bold = f"<article><p>{'begin ' * 20}<b>bold</b> end</p><script>no</script> last<!-- no --></article>"
    assert article(bold)["content"].endswith("begin bold") and article(bold, tails=True)["content"].endswith("begin bold end last")


@pytest.mark.parametrize("part", ["<p>", "<b>", '<div class="content">y', '<a "', "<!--", "<script>", "<noscript>", "<", "&lt;", "<a>x", "<li>", "<i></b>", "<p class='", "<td><tr>"])
def test_a_megabyte_of_anything(part):
    began = time.time()
    article(part * (1_000_000 // len(part)))
    items(part * (1_000_000 // len(part)), ListRule(item="div, p, li", title="b, a", content="p", date="td"))
    assert time.time() - began < 40


def test_selectors():
    html = '<div class="a b" id=i><ul><li lang="en-x">1<a href="/q">t</a><li>2<ul><li>3</ul></ul></div><p class=b>4'
    tree = Tree(html)
    text = lambda s: ["".join(tree.pieces(e)) for e in tree.select(s)]
    assert text("li") == ["1t", "23", "3"] and text("div > ul > li") == ["1t", "23"] and text("li li") == ["3"] and text("ul li a") == ["t"]
    assert text("#i") == text("div.a.b") == text('div[id="i"]') == text("[class~=a]") == ["1t23"] and text(".b") == ["1t23", "4"]
    assert text("a, p") == ["t", "4"] and text('[href^="/"]') == text("[href$='q']") == text('a[href*="q"]') == ["t"] and text("[lang|=en]") == ["1t"] and text("* > a") == ["t"]
    for wrong in ("", "div >", "> a", "a::before", "li:first-child", ",", "a + b", "[x"):
        with pytest.raises(ValueError):
            parsed(wrong)


def test_list_items(spark):
    html = '<li><h3 class=t>[Steel]  up <span>2024-05-06</span></h3><div class=c>One.<b>Two</b></div><li><h3 class=t>x<span>2024-05-07</span></h3><li><h4>spare &amp; long</h4><li>none<li><h3 class=t>Second <span data-d="D1">no date</span></h3>'
    rule = ListRule(item="li", title="h3.t", content="div.c", date="span", spare_title="h4", title_cut=r"\s*long$")
    assert items(html, rule) == [{"title": "[Steel] up", "date": "2024-05-06", "content": "One. Two"}, {"title": "spare &", "date": None, "content": ""}, {"title": "Second", "date": "no date", "content": ""}]
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string").withColumn("rule", structure.rule(ListRule(item="li", title="h3.t", content="", date="span", date_attribute="data-d", product_only=True)))
    got = structure.listed(df, "html", "rule").collect()
    assert [(r.page_id, r.place, r.title, r.publish_time, r.content, r.subtitle) for r in got] == [(1, 0, "Steel", "", "", ""), (1, 1, "Second", "D1", "", "")]
