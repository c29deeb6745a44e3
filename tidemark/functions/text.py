"""Articles, pages and lines of text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import latest_in

#: Parts of addresses that lists and articles have.
LISTS, LISTS_ANY_CASE = ("?s=", "/category/", "/topic/", "/channel/"), ("/node/", "/list/", "/index")
LEARNED_LISTS = ("/node/", "/category/", "/topic/", "/channel/", "/list/", "/index", "/page")
ARTICLES, LEARNED_ARTICLES = ("/article/", "/info/", "/detail/", "/show/"), ("/article/", "/news/", "/info/", "/detail/", "/show/")
#: Titles that are none.
BAD_TITLES = (r"^[\[【]?(组图|图集|专辑|专题|专栏|视频|图片|海报)[】\]]", r"^!\[.*?\]\(", r"^[|\-=]{3,}", r"^\d+$")
#: Words of lines that navigate or advertise.
NOISE = (
    "首页", "网站地图", "联系我们", "关于我们", "加入我们", "人才招聘", "广告服务", "版权所有", "copyright", "网站备案", "ICP证", "热门排行", "热门推荐", "推荐阅读", "相关阅读", "相关推荐", "客户端下载", "扫码下载",
    "微信扫一扫", "关注公众号", "分享到", "人民视频", "人民智云", "人民智作", "人民网+", "领导留言板", "人民日报少年", "手机人民网", "新闻线索", "违法和不良信息",
)
#: What is taken out of a text, in this order; (?m) and (?i) as each pattern has them.
BOILERPLATE = (
    r"(?mi)^(【.*?】\s*)?(转载|摘录|来源|出处|原文链接|原文地址|来源网址).*?$",
    r"(?m)^责编：.*$",
    r"(?m)^责任编辑：.*$",
    r"(?m)^编辑：.*$",
    r"(?m)^作者：.*$",
    r"(?m)^(如需转载|转载需|转载授权|侵权举报|举报).*?$",
    r"(?m)^[|\-=]{3,}$",
    r"(?mi)(?:扫描|长按|识别).*?(?:二维码|关注|公众|微信号).*?$",
    r"(?mi)^©?\s*版权.*?$",
    r"(?m)^本文结束.*$",
    r"(?m)^【相关.*?】.*$",
    r"(?m)^广告\s*人民日报主管.*?主办\s*网站地图.*?$",
    r"(?m)^网站地图\s*联系我们\s*首页.*?$",
    r"(?m)^\d+\.\s*(?:首页|会议会展|正文|新闻|资讯|文章)[^\n]*$",
    r"(?m)^(?:即时新闻|能源要闻|焦点关注|能源评论|能源党建|热点专题|生态环保|人事动态|能源城市|环球视野|产业聚焦|电网电力|新能源|油气)\s*",
    r"(?m)^人民日报主管.*?有限公司主办\s*$",
    r"(?mi)^来源[：:]\s*[^\n]+\d{4}[年-]\d{2}[月-]\d{2}[日]?\s*\d{2}:\d{2}.*$",
    r"(?m)^热门排行\s*\d[^\n]+$",
    r"(?m)^微信[扫扫]?一扫[^\n]*$",
    r"(?m)^提供新闻线索[^\n]*$",
    r"(?m)^(?:人民智云|人民智作|热门排行|热门推荐|推荐阅读)[^>\n]*$",
    r"(?m)^[^\n]*-->.*$",
    r"(?m)^[^\n]*→.*$",
    r"(?m)^(?:客户端下载|人民日报|人民日报少年|人民网\+|手机人民网|领导留言板|人民视频|人民智云|人民智作)[^\n]*$",
    r"(?m)^关注公众号[^\n]*$",
    r"(?m)^分享让更多人看到[^\n]*$",
)
#: What each of BOILERPLATE needs somewhere: a character beyond ASCII, a rule, or a comment's end.
MARKED = r"[^\x00-\x7f]|[|\-=]{3}|-->"
#: Signs of a text that is no article.
INDICATORS = ("投稿", "责任编辑", "版权", "版权所有", "中国能源网", "联系电话", "邮箱:", "微信/", "qq.com")
#: Where article bodies lie, for pages and for texts that other ways have failed on.
BODIES = (
    r"(?s)AI摘要[^>]*内容由AI生成[^>]*\x22([^\x22]{20,})\x22",
    r"(?s)(快科技\d{1,2}月\d{1,2}日[^科][^计][^详][^细][^文][^件][^管][^热][^好][^问][^相][^删].*?【本文结束】)",
    r"(?s)<article[^>]*>(.*?)</article>",
    r"(?s)(?:class|id)=[\x22'][^\x22']*(?:article|content|post|entry)[^\x22']*[\x22'][^>]*>(.*?)(?:</div>|</article>)",
    r"(?s)<div[^>]+class=[\x22'][^\x22']*content[^\x22']*[\x22'][^>]*>([\s\S]{200,})</div>",
)
BLOCKS = (
    r"(?s)<section[^>]*data-type=[\x22']rtext[\x22'][^>]*>(.*?)</section>",
    r"(?s)<article[^>]*>(.*?)</article>",
    r"(?s)(?:class|id)=[\x22'][^\x22']*(?:article|content|post|entry)[^\x22']*[\x22'][^>]*>(.*?)</(?:div|p|article)>",
    r"(?s)<div[^>]+class=[\x22'][^\x22']*content[^\x22']*[\x22'][^>]*>([\s\S]{200,})</div>",
)
AREAS = (
    r"(?s)<section[^>]+data-type=[\x22']rtext[\x22'][^>]*>(.*?)</section>",
    r"(?s)<div[^>]+class=[\x22'][^\x22']*article_content[^\x22']*[\x22'][^>]*>(.*?)</div>",
    r"(?s)<div[^>]+class=[\x22'][^\x22']*detail_left[^\x22']*[\x22'][^>]*>(.*?)</div>",
    r"(?s)<article[^>]*>(.*?)</article>",
)
SUMMARIES = (r"AI摘要[^>]*内容由AI生成[^>]*\x22([^\x22]{20,})\x22", r"\x22AI摘要\x22[^>]*>([^<]{50,})")
#: Words of paragraphs that are no article, and organisations that short paragraphs list.
PARAGRAPH_NOISE = (
    "文章来源", "来源：", "来源:", "责任编辑", "编辑：", "作者：", "未经授权", "严禁转载", "版权声明", "投稿：", "投稿热线", "微信：", "邮箱：", "qq.com", "新浪微博", "官方微博", "扫描二维码", "长按识别", "关注我们", "合作伙伴",
    "相关资讯", "热门文章", "精彩推荐", "相关阅读", "天眼查App显示", "数据显示", "据.*?消息", "年.*?月.*?日", "免责声明", "违法和不良信息", "举报中心",
)
PARTNERS = ("国家发改委", "国资委", "国家能源局", "中国华能", "中国电建")
#: Signs of a page's source in it, then in its address.
SOURCE_MARKS = (
    ("cnenergynews", ("cnenergynews.cn", 'class="article_content"', 'class="w-createtime"')),
    ("mydrivers", ('id="news_detail"', 'class="news_detail"')),
    ("smm", ('class="live_detail"', "news.smm.cn")),
    ("people", ('class="people_news_content"',)),
)
SOURCE_HOSTS = (("mydrivers", "mydrivers.com"), ("cnenergynews", "cnenergynews.cn"), ("smm", "smm.cn"), ("people", "people.com.cn"), ("moa", "moa.gov.cn"))
#: Link texts that lead to an article without being its title.
LINK_WORDS = ("view more", "first page", "previous page", "next page", "last page", "read more", "view all", "home", "sign in", "logout", "member center", "trendforce", "news logo", "news")
#: Words that a pattern for article bodies is preferred by.
BODY_WORDS = ("article", "content", "post", "entry", "text")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _through(text: Column, *ends: str) -> Column:
    """text up to the last of ends, so that whatever opens before it is closed. Empty without any."""
    upto = [F.length(text) - F.length(F.substring_index(text, end, -1)) for end in ends]
    return F.left(text, F.greatest(*upto) if len(upto) > 1 else upto[0])


def untagged(html: Column, by: str = "") -> Column:
    """html with each run from < to the next > replaced. What comes after the last > has none, and isn't searched."""
    tail = F.substring_index(html, ">", -1)
    return F.concat(F.regexp_replace(F.left(html, F.length(html) - F.length(tail)), "<[^>]+>", by), tail)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def spaced(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def is_article_url(url: Column) -> Column:
    """A list crawler's rule: no image or list; under /news only with a whole date; else in an article's path."""
    low = F.lower(url)
    listed = low.endswith(".gif") | _has(url, *LISTS) | _has(low, *LISTS_ANY_CASE)
    return ~listed & F.when(url.rlike(r"/news(/|$|\?)"), url.rlike(r"/news/\d{4}/\d{2}/\d{2}/")).otherwise(_has(low, *ARTICLES))


def is_article_url_learned(url: Column) -> Column:
    """The pattern learner's rule: pages of lists go as well; numbered .htm pages and all of /news/ stay."""
    low = F.lower(url)
    numbered = (url.rlike(r"/\d+") | url.rlike(r"[-.]\d+[-.]")) & url.contains(".htm")
    return ~(low.endswith(".gif") | _has(low, *LEARNED_LISTS)) & (numbered | _has(low, *LEARNED_ARTICLES))


def unescaped(text: Column) -> Column:
    """Character references (numbers, and the names of HTML 4, with a semicolon) as the characters."""
    known = F.from_json(F.lit("{" + ",".join(f'"{n}":"\\u{c:04x}"' for n, c in sorted(name2codepoint.items())) + "}"), "map<string,string>")
    form = r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def read(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).try_cast("int")
        spelled = F.decode(F.unhex(F.lpad(F.hex(F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)), 8, "0")), "UTF-32")
        return F.coalesce(spelled, known[name], F.concat(F.lit("&"), name, F.lit(";")))

    names, between = F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(1)), read), F.split(text, form, -1)
    return F.when(text.contains("&"), F.array_join(F.zip_with(between, names, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def without_tags(html: Column) -> Column:
    """The text of a page's part: tags go, character references become characters, single spaces."""
    return spaced(unescaped(untagged(html)))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def source_of(url: Column, html: Column) -> Column:
    """A page's source by signs in the page, else in its address, else 'unknown'."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    tries = [(name, _has(html, *marks)) for name, marks in SOURCE_MARKS]
    tries += [("cnenergynews", html.contains('class="article"') & html.contains("pubdate"))]
    tries += [(name, url.contains(host)) for name, host in SOURCE_HOSTS]
    return F.coalesce(*(F.when(found, name) for name, found in tries), F.lit("unknown"))


def _found(html: Column, pattern: str) -> Column:
    """The first group of a pattern that ends with a mark, which is only searched for where a mark follows."""
    ends = [e for e in ("</div>", "</section>", "</article>", "</p>", "【本文结束】") if e in pattern or e == "</div>" and "</(?:div|p|article)>" in pattern]
    if "</(?:div|p|article)>" in pattern:
        ends = ["</div>", "</p>", "</article>"]
    return F.regexp_extract(_through(html, *ends) if ends else html, pattern, 1)


def is_boilerplate_paragraph(text: Column) -> Column:
    t = stripped(text)
    dated = t.rlike(r"^\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?\s*\d{1,2}:\d{2}") & (F.length(t) < 30)
    return (t == "") | _has(t, *PARAGRAPH_NOISE) | t.rlike(r"^\[.+\]\(https?://") | t.startswith("http") | dated | (_has(t, *PARTNERS) & (F.length(t) < 50))


def paragraphs_of(html: Column) -> Column:
    """The paragraphs of a page's article, else of the whole page, without boilerplate, as one text; without any, all its text."""
    area = F.coalesce(*(F.nullif(_found(html, p), F.lit("")) for p in AREAS))

    def joined(part: Column) -> Column:
        # a paragraph begins with the first tag since the last end, as if each were searched for in turn
        parts = F.split(part, "(?i)</p>", -1)
        closed = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_extract(x, r"(?is)<p[^<>]*+>(.*)", 1))
        texts = F.transform(closed, lambda x: stripped(unescaped(untagged(x))))
        return F.nullif(F.array_join(F.filter(texts, lambda x: (F.length(x) >= 15) & ~is_boilerplate_paragraph(x)), " "), F.lit(""))

    return F.coalesce(joined(area), joined(html), stripped(F.regexp_replace(unescaped(untagged(html, " ")), r"(?U)\s{3,}", " ")))


def body_of(html: Column, url: Column | None = None, least: int = 200) -> Column:
    """An article's text: of the first place of BODIES with so many characters, else its paragraphs; without marks of links."""
    source = source_of(F.lit("") if url is None else url, html)
    found = [once(without_tags(_found(html, p)), lambda t: F.when(F.length(t) >= least, t)) for p in BODIES]
    found[0] = F.when(source != "mydrivers", found[0])
    steps = [(r"!\[([^\]]*)\]\([^)]+\)", ""), (r"\[\]\([^)]+\)", ""), (r"(?U)#{1,6}\s+", "")]
    cleaned = spaced(reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.coalesce(*found, paragraphs_of(html))))
    return F.when(stripped(html) == "", "").otherwise(F.regexp_replace(F.regexp_replace(cleaned, r"[【本文结束】]+\z", ""), r"(?U)\s+\z", ""))


def summary_of(html: Column) -> Column:
    """A page's own summary by a model, if it has one."""
    return F.coalesce(*(F.nullif(stripped(F.regexp_extract(html, p, 1)), F.lit("")) for p in SUMMARIES), F.lit(""))


def by_source_pattern(html: Column, pattern: Column) -> Column:
    """What the row's own pattern finds in a page: its first group (of at most four) that isn't empty, else all of it, as text.

    Patterns are data and must be valid. A missing pattern, and one that finds nothing, gives an empty text.
    """
    whole = F.concat(F.lit("(?s)"), F.nullif(pattern, F.lit("")), F.lit("()()()()"))
    block = F.coalesce(*(F.nullif(F.call_function("regexp_extract", html, whole, F.lit(k)), F.lit("")) for k in (1, 2, 3, 4, 0)), F.lit(""))
    return without_tags(F.regexp_replace(block, r"<style[^>]*>[\s\S]*?</style>", ""))


def by_all_patterns(html: Column, patterns: dict[str, str], least: int = 50) -> Column:
    """The map of source to text for all patterns (of a configuration, few) that find so many characters."""
    tried = F.array(*(F.struct(F.lit(name).alias("name"), by_source_pattern(html, F.lit(p)).alias("text")) for name, p in patterns.items()))
    return F.map_from_entries(F.filter(tried, lambda x: F.length(x["text"]) >= least))


def clean_markdown(text: Column) -> Column:
    """A line of a list without marks of emphasis and links."""
    steps = [(r"\*+([^*]+)\*+", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"~~([^~]+)~~", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"!\[\]\([^)]*\)", "")]
    return spaced(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def clean_markdown_light(text: Column) -> Column:
    """A page's markdown without images, marks of emphasis, links and headings."""
    steps = [(r"!\[([^\]]*)\]\([^)]*\)", ""), (r"\*\*([^\*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"~~([^~]+)~~", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?U)#{1,6}\s+", "")]
    return spaced(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def quality(title: Column, content: Column, time: Column) -> Column:
    """What an article lacks: a struct of n_chars, title_chars, has_time, time_is_zero, issues and passed."""
    return once(F.struct(title.alias("title"), stripped(title).alias("plain"), content.alias("content"), time.alias("time")), _quality)


def _quality(row: Column) -> Column:
    title, content, time = F.coalesce(row["title"], F.lit("")), F.coalesce(row["content"], F.lit("")), row["time"]
    size, title_size = F.length(content), F.length(title)
    marks = size - F.length(F.translate(content, "<>{", ""))
    zero = F.coalesce(F.get(F.split(time, " "), F.lit(1)) == "00:00:00", F.lit(False))
    noise = F.coalesce(*(F.when(row["plain"].rlike(p), F.lit(f"noise_title:{p}")) for p in BAD_TITLES))
    failed = [
        F.when(size < 200, F.concat(F.lit("content_too_short:"), size.cast("string"))), F.when(title_size < 5, "title_missing_or_too_short"), noise,
        F.when(marks > size * F.lit(0.05), F.concat(F.lit("content_impure:label_chars="), marks.cast("string"))),
    ]
    issues = F.array_compact(F.array(*failed[:2], F.when(zero, "time_may_be_missing"), *failed[2:]))
    told = F.struct(size.cast("long").alias("n_chars"), title_size.cast("long").alias("title_chars"), time.isNotNull().alias("has_time"), zero.alias("time_is_zero"))
    return once(issues, lambda held: F.struct(*(told[c].alias(c) for c in ("n_chars", "title_chars", "has_time", "time_is_zero")), held.alias("issues"), (F.size(held) == F.when(zero, 1).otherwise(0)).alias("passed")))


def line_score(line: Column) -> Column:
    """From 0 to 1, by length, links, share of Chinese and of Latin characters, noise words and a sentence's end."""
    return _line_score(line, stripped(line))


def _line_score(line: Column, plain: Column) -> Column:
    n = F.length(plain)
    size = F.when(n < 15, 0.2).when(n < 30, 0.5).when(n < 200, 0.8).otherwise(0.6)
    share = lambda pattern: (n - F.length(F.regexp_replace(plain, f"{pattern}+", ""))) / n
    marked = F.array_join(F.regexp_extract_all(line, F.lit(r"\[[^\]]*\]\([^)]+\)|<a[^>]*>[^<]*</a>"), F.lit(0)), "")
    links = F.when(_has(line, "](", "<a"), F.length(F.regexp_replace(marked, r"[\[\](){}<>`]", "")) / n).otherwise(0.0)
    noise = F.least(F.lit(0.5), sum((F.when(plain.contains(w), 1).otherwise(0) for w in NOISE), F.lit(0)) * 0.15)
    score = size * 0.2 + (1 - links) * 0.2 + share(r"[\x{4e00}-\x{9fff}]") * 0.3 + (1 - share("[a-zA-Z0-9]")) * 0.15 - noise + F.when(plain.rlike(r"[。！？.!?]$"), 0.1).otherwise(0.0)
    return F.when(n == 0, 0.0).when(n < 5, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def is_noise_line(line: Column) -> Column:
    """A line that is blank, has under three characters, only rules or bullets, or is short and Latin."""
    return _is_noise(stripped(line))


def _is_noise(plain: Column) -> Column:
    return (F.length(plain) < 3) | plain.rlike(r"^[|\-=•○●◆■□▪▫◦▪*]{3,}$") | ((F.length(plain) < 10) & plain.rlike(r"^[a-zA-Z0-9\s().,;:!?-]+$"))


def article_lines(text: Column, least: float = 0.25) -> Column:
    """The lines that are no noise and score so much, without those equal to the one kept before: structs of place, line and score."""
    # a line is stripped once: expressions in functions of arrays are evaluated as often as they are named
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), x.alias("line"), stripped(x).alias("plain")))
    told = F.transform(lines, lambda x: F.struct(x["place"].alias("place"), x["line"].alias("line"), x["plain"].alias("plain"), F.when(_is_noise(x["plain"]), -1.0).otherwise(_line_score(x["line"], x["plain"])).alias("score")))

    def kept(held: Column) -> Column:
        before = lambda i: F.get(held, i - 1)["plain"]
        return F.transform(F.filter(held, lambda x, i: ~x["plain"].eqNullSafe(before(i))), lambda x: F.struct(x["place"].alias("place"), x["line"].alias("line"), x["score"].alias("score")))

    # named once, as the only element of an array
    return F.flatten(F.transform(F.array(F.filter(told, lambda x: x["score"] >= least)), kept))


def without_boilerplate(text: Column) -> Column:
    """A text's article lines, then without what BOILERPLATE finds, at most one blank line in a row."""
    lines = F.array_join(F.transform(article_lines(text), lambda x: x["line"]), "\n")
    # (?d): as in these rules, only \n ends a line
    without = lambda held: reduce(lambda c, p: F.regexp_replace(c, f"(?d){p}", ""), BOILERPLATE, held)
    cleaned = once(lines, lambda held: F.when(held.rlike(MARKED), without(held)).otherwise(held))
    return stripped(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"))


def clean_content(html: Column) -> Column:
    """The text of a page's first block that has 100 characters, without boilerplate; else an empty one."""
    tries = [once(without_tags(_found(html, p)), lambda t: F.when(F.length(t) >= 100, t)) for p in BLOCKS]
    return without_boilerplate(F.coalesce(*tries, F.lit("")))


def sign_ratio(text: Column, signs: tuple[str, ...] = INDICATORS) -> Column:
    """The share of signs that the text contains."""
    return sum((F.when(text.contains(s), 1).otherwise(0) for s in signs), F.lit(0)) / len(signs)


def listed_articles(markdown: Column) -> Column:
    """The articles that a list page links to, in order: structs of place, title, url, subtitle and list_date.

    A link whose text only navigates takes its title from the next seven lines, and a subtitle from seven lines below it.
    The date is that of the address, else in the title, in that line, or in the next three lines.
    """
    lines = F.transform(F.split(markdown, "\n"), stripped)
    link = r"\[([^\]]+)\]\((https?://[^\s\x22)]+)\)"
    text, url = (lambda x: stripped(F.regexp_extract(x["line"], link, 1))), (lambda x: F.regexp_extract(x["line"], link, 2))
    rows = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("place"), x.alias("line"))), lambda x: (F.length(text(x)) > 5) & (F.length(url(x)) > 10) & is_article_url(url(x)))
    ahead = lambda start, n: F.transform(F.slice(lines, start, F.lit(n)), lambda y, k: F.struct((start + k).alias("at"), y.alias("line")))
    unprefixed = lambda t: F.regexp_replace(t, r"(?i)^\s*\[News\]\s*", "")

    def titled(y: Column) -> Column:
        bold = F.regexp_extract(y["line"], r"\*\*(.+?)\*\*", 1)
        heading = stripped(F.regexp_replace(F.regexp_replace(y["line"], r"^#+\s*", ""), r"^\*\*(.+?)\*\*$", "$1"))
        told = F.when(bold != "", unprefixed(stripped(bold))).when(y["line"].startswith("## ") | y["line"].startswith("# "), unprefixed(heading))
        usable = ~y["line"].startswith("![") & ~y["line"].startswith("[ ") & (y["line"] != "")
        return F.struct(y["at"].alias("at"), y["line"].alias("line"), F.when(usable, told).alias("title"))

    def with_title(x: Column) -> Column:
        navigates = F.lower(text(x)).isin(*LINK_WORDS) | text(x).startswith("![")
        found = F.get(F.filter(F.transform(ahead(x["place"] + 2, 7), titled), lambda y: F.length(y["title"]) > 5), F.lit(0))
        return F.struct(x["place"].alias("place"), url(x).alias("url"), navigates.alias("navigates"), F.when(navigates, found).alias("found"), F.when(navigates, found["title"]).otherwise(text(x)).alias("title"))

    def finished(x: Column) -> Column:
        dated = F.filter(F.transform(ahead(x["place"] + 2, 3), lambda y: F.when(~y["line"].startswith("![") & ~y["line"].rlike(r"\[.+\]\(https?://"), latest_in(y["line"]))), lambda d: d.isNotNull())
        of_url = F.nullif(F.translate(F.regexp_extract(x["url"], r"/(\d{4}/\d{2}/\d{2})/", 1), "/", "-"), F.lit(""))
        of_title = latest_in(x["title"])
        below = F.transform(ahead(x["found"]["at"] + 1, 7), lambda y: F.when((y["line"] != "") & ~y["line"].rlike(r"^(?:\[|!\[|#)"), clean_markdown(y["line"])))
        subtitle = F.coalesce(F.left(F.get(F.filter(below, lambda t: F.length(t) > 10), F.lit(0)), F.lit(300)), F.lit(""))
        undated = F.regexp_replace(F.regexp_replace(x["title"], r"\s*\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\s*$", ""), r"(?U)\s+\z", "")
        title = F.when(of_url.isNull() & of_title.isNotNull(), undated).otherwise(x["title"])
        return F.struct(
            x["place"].alias("place"), stripped(F.regexp_replace(F.regexp_replace(stripped(title), r"^\[+|\[+\z", ""), r"^\]+|\]+\z", "")).alias("title"), x["url"].alias("url"), F.when(x["found"].isNotNull(), subtitle).otherwise("").alias("subtitle"),
            F.coalesce(of_url, of_title, latest_in(x["found"]["line"]), F.get(dated, F.lit(0))).alias("list_date"),
        )

    return F.transform(F.filter(F.transform(rows, with_title), lambda x: ~x["navigates"] | x["found"].isNotNull()), finished)


def best_pattern(pattern: Column, place: Column) -> Column:
    """An aggregate: of a group's patterns the first by place that names a body, else the shortest."""
    named = pattern.rlike("(?i)" + "|".join(BODY_WORDS))
    return F.min_by(pattern, F.struct(~named, F.when(named, 0).otherwise(F.length(pattern)), place))
