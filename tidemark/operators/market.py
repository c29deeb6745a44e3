"""Sectors, stocks and quotes: related stocks, snapshots, moves since publishing, entity matching.

A sector table has id, code, name, keywords and pinyin_initial; a stock table sector, code, tier; quotes name or code,
price and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from .news import first_of_each, ranked

#: Endings that sector names go by or without.
SUFFIXES = ("行业", "板块", "概念", "设备", "生产", "制造", "相关", "主题")
#: The tiers of a report's stocks, its appendices, and the links of a chain.
TIERS = ("第一梯队", "第二梯队", "第三梯队A类", "第三梯队A", "第三梯队B类", "第三梯队B")
APPENDIX_ONE, APPENDIX_TWO, APPENDIX_END = "附录一", "附录二", ("附录三", "末尾")
LINKS = ("上游资源", "上游设备", "上游材料", "中游制造", "中游设计", "中游模组", "中游系统", "下游封测", "下游应用")
COVERED, NO_LINK, UNCOVERED = "已覆盖", "无此环节", "未覆盖"


def dimension(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """A dimension, broadcast if it has at most so many rows; beyond, Spark plans its joins by itself."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def with_stocks(news: DataFrame, stocks: DataFrame, each: int = 10) -> DataFrame:
    """news (id, sectors) with its sectors' first stocks by tier and code, in the order of the sectors."""
    best = first_of_each(stocks, ["sector"], [F.asc("tier"), F.asc("code")], each)
    listed = news.select("id", F.posexplode("sectors").alias("place", "sector"))
    held = listed.join(best, "sector").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "code"))).alias("found"))
    return news.join(held, "id", "left").withColumn("codes", F.coalesce(F.transform("found", lambda x: x["code"]), F.array().cast("array<bigint>"))).drop("found")


def two_counts(parents: DataFrame, one: DataFrame, two: DataFrame, key: str, as_joined: bool = False) -> DataFrame:
    """How many rows of one and of two each parent has; as_joined counts them after both joins, that is, multiplied."""
    if as_joined:
        a, b = one.select(key, F.lit(1).alias("_one")), two.select(key, F.lit(1).alias("_two"))
        return parents.join(a, key, "left").join(b, key, "left").groupBy(key).agg(F.count("_one").alias("n_one"), F.count("_two").alias("n_two"))
    a, b = one.groupBy(key).agg(F.count(F.lit(1)).alias("n_one")), two.groupBy(key).agg(F.count(F.lit(1)).alias("n_two"))
    return parents.select(key).distinct().join(a, key, "left").join(b, key, "left").fillna(0, ["n_one", "n_two"])


def priced(rows: DataFrame, by_code: DataFrame, by_name: DataFrame) -> DataFrame:
    """rows (code, name) with the price of the code, else of the name. A price of 0 or null is none."""
    a = by_code.filter("price <> 0").select("code", F.col("price").alias("_by_code"))
    b = by_name.filter("price <> 0").select("name", F.col("price").alias("_by_name"))
    return rows.join(a, "code", "left").join(b, "name", "left").withColumn("price", F.coalesce("_by_code", "_by_name")).drop("_by_code", "_by_name")


def _grams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text, and its characters."""
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, 2)), F.split(text, "")))


def holding(keys: DataFrame, key: str, rows: DataFrame, column: str, by_loop: Column, exact: Column) -> DataFrame:
    """keys joined with the rows whose column holds the key, by an index of neighbouring characters, without comparing all with all.

    Each key looks up the one of its pairs (or its only character) that fewest rows have; exact then decides. Both sides are
    compared in lower case by the index. Keys for which by_loop holds (few: empty ones, those with wildcards) are compared
    with all rows.
    """
    index = rows.withColumn("_gram", F.explode(_grams(F.lower(column))))
    often = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    low = F.lower(key)
    own = F.filter(_grams(low), lambda g: (F.length(g) == 2) | (F.length(low) == 1))
    asked = keys.filter(~by_loop).select(key, F.explode(own).alias("_gram")).distinct().join(often, "_gram", "left")
    rarest = asked.groupBy(key).agg(F.min_by("_gram", F.struct(F.coalesce("_often", F.lit(0)), "_gram")).alias("_gram"))
    found = keys.filter(~by_loop).join(rarest, key).join(index, "_gram").filter(exact).drop("_gram")
    return found.unionByName(keys.filter(by_loop).join(rows, exact))


def matched_names(names: DataFrame, quotes: DataFrame) -> DataFrame:
    """names (name) with the quote of the same name, else the first by place that contains it or is contained; a row for each name."""
    q = quotes.select(F.col("name").alias("quote_name"), "place", "price")
    asked = names.select("name").filter("name is not null").distinct()
    wider = holding(asked, "name", q, "quote_name", F.col("name") == "", F.col("quote_name").contains(F.col("name")))
    narrower = holding(q, "quote_name", asked, "name", F.col("quote_name") == "", F.col("name").contains(F.col("quote_name")))
    best = first_of_each(wider.unionByName(narrower), ["name"], [F.desc(F.col("name") == F.col("quote_name")), F.asc("place")]).drop("nth", "place")
    return names.dropDuplicates(["name"]).join(best, "name", "left")


def snapshot(news: DataFrame, quotes: DataFrame, sector: str = "sector", day: str = "query_date") -> DataFrame:
    """news (sector, query_date) with the value of that day, else the latest before: an as-of join by an ordered run.

    The run is over the distinct days of each sector, whatever the number of news; these are then found again by both keys.
    """
    days = news.select(F.col(sector).alias("_sector"), F.col(day).alias("_day"), F.lit(None).cast("double").alias("_value"))
    days = days.unionByName(quotes.select(F.col(sector).alias("_sector"), F.col(day).alias("_day"), F.col("value").alias("_value"))).groupBy("_sector", "_day").agg(F.max("_value").alias("_value"))
    value = F.last("_value", ignorenulls=True).over(Window.partitionBy("_sector").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    known = days.select("_sector", "_day", value.alias("value"))
    return news.drop("value").join(known, F.col(sector).eqNullSafe(F.col("_sector")) & F.col(day).eqNullSafe(F.col("_day")), "left").drop("_sector", "_day")


def sync_decisions(news: DataFrame, recent: Column, keep_greater: bool = True) -> DataFrame:
    """What a sync writes for news (published, current_value: strings; rise, max_rise: numbers), by row.

    The first value becomes the published one; important and recent rows get the current one and their rise; others with
    a published value are left alone. keep_greater: a rise replaces a greater one never.
    """
    first = F.coalesce(F.col("published"), F.lit("")) == ""
    has = F.coalesce(F.col("current_value"), F.lit("")) != ""
    rise = F.when(recent & ~first, F.col("rise")).otherwise(0.0)
    action = F.when(~has, "none").when(first & recent, "both").when(first, "publish").when(recent, "current").otherwise("none")
    new = F.greatest(F.coalesce("max_rise", F.lit(0.0)), rise) if keep_greater else rise
    return news.withColumn("action", action).withColumn("new_rise", F.when(F.col("action") == "none", F.col("max_rise")).otherwise(new))


def sorted_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with their place by change, greatest first; none counts as 0; ties keep their order (nth)."""
    return quotes.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.coalesce("rate", F.lit(0.0))), F.asc("nth"))).cast("long"))


def searched(keys: DataFrame, sectors: DataFrame, limit: int = 5) -> DataFrame:
    """Matches of each key (key, and pinyin: its initials, '' by default): the sector of that name alone; else by pinyin
    initials of two letters or more, then by name, then by keywords (tiers 0 to 3).

    Tiers fill up to limit rows, in the order of id, and may repeat a sector. LIKE has no case. The first two tiers are
    joins of equal values, the others go by an index of neighbouring characters; only keys with wildcards are compared with all.
    """
    keys = keys if "pinyin" in keys.columns else keys.withColumn("pinyin", F.lit(""))
    s = sectors.select("id", "code", "name", "keywords", "pinyin_initial")
    odd = F.col("key").rlike(r"^$|[%_\\\\]")
    like = lambda c: F.expr(f"{c} ilike concat('%', key, '%')")
    parts = [
        keys.join(s, F.col("name") == F.col("key")), keys.join(s, (F.col("pinyin_initial") == F.col("pinyin")) & (F.length("pinyin") >= 2)),
        holding(keys, "key", s, "name", odd, like("name")), holding(keys, "key", s, "keywords", odd, like("keywords")),
    ]
    found = None
    for tier, part in enumerate(parts):
        part = part.withColumn("tier", F.lit(tier))
        found = part if found is None else found.unionByName(part)
    group = Window.partitionBy("key", "pinyin")
    exact = F.min("tier").over(group) == 0
    rows = found.withColumns({"_exact": exact, "nth": F.row_number().over(group.orderBy("tier", "id")).cast("long")})
    return rows.filter(F.when(F.col("_exact"), (F.col("tier") == 0) & (F.col("nth") == 1)).otherwise(F.col("nth") <= limit)).drop("_exact")


def normalised(raw: DataFrame, sectors: DataFrame) -> DataFrame:
    """The sector of each raw name (raw, and pinyin: its initials, '' by default), by the first of these steps that hits:
    its own name; its initials as a key; among its first five matches one by keyword; its first match; it without a suffix;
    its first 2, 3 or 4 characters; its last 2, 3 or 4, by name only.
    """
    raw = raw if "pinyin" in raw.columns else raw.withColumn("pinyin", F.lit(""))
    name, suffix = F.col("raw"), f"({'|'.join(SUFFIXES)})$"
    core = F.regexp_replace("raw", suffix, "")
    initials = F.when(F.length("pinyin") >= 2, F.col("pinyin"))
    # step, key, whether the raw name's initials go with the key, which tiers count
    tries = [(0, name, True, (0,)), (1, initials, False, (0, 1, 2, 3)), (2, name, True, (3,)), (3, name, True, (0, 1, 2, 3)), (4, F.when((core != name) & (F.length(core) >= 2), core), False, (0, 1, 2, 3))]
    tries += [(3 + n, F.when(F.length("raw") > n, F.left("raw", F.lit(n))), False, (0, 1, 2, 3)) for n in (2, 3, 4)]
    tries += [(6 + n, F.when(F.length("raw") > n, F.right("raw", F.lit(n))), False, (0, 2)) for n in (2, 3, 4)]
    listed = F.array(*(F.struct(F.lit(step).alias("step"), key.alias("key"), (F.col("pinyin") if own else F.lit("")).alias("key_pinyin"), F.lit(step == 2).alias("any_place"), F.array(*map(F.lit, tiers)).alias("tiers")) for step, key, own, tiers in tries))
    asked = raw.select("raw", "pinyin").distinct().select("raw", "pinyin", F.inline(listed)).filter("key <> ''")
    keys = asked.select("key", F.col("key_pinyin").alias("pinyin")).distinct()
    hits = searched(keys, sectors).select("key", F.col("pinyin").alias("key_pinyin"), "tier", "nth", "id", "code", "name")
    fits = asked.join(hits, ["key", "key_pinyin"]).filter(F.expr("array_contains(tiers, tier) and (any_place or nth = 1)"))
    best = fits.groupBy("raw", "pinyin").agg(F.min_by(F.struct("id", "code", "name"), F.struct("step", "nth")).alias("best"))
    return raw.join(best, ["raw", "pinyin"], "left").select(*raw.columns, F.col("best.id").alias("id"), F.col("best.code").alias("code"), F.col("best.name").alias("name"), F.col("best").isNotNull().alias("normalized"))


def _cells(reports: DataFrame) -> DataFrame:
    """report_id, place, line (trimmed) and cells of each line of reports (report_id, text)."""
    lines = reports.select("report_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.btrim(x))).alias("place", "line"))
    return lines.withColumn("cells", F.transform(F.split("line", r"\|"), lambda x: F.btrim(x)))


def _cell(i: int, bare: bool = False) -> Column:
    found = F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return F.replace(found, F.lit("*"), F.lit("")) if bare else found


def report_rows(reports: DataFrame, tiers: list[str] | None = None) -> DataFrame:
    """Stock rows of reports' markdown tables (report_id, text): report_id, place, tier, sort, code, name, link, dims, moat, metrics, path."""
    rows = _cells(reports).filter("contains(line, '|') and not contains(line, '---')")
    rows = rows.filter((F.size("cells") >= 6) & _cell(1, bare=True).isin(list(tiers or TIERS)) & (_cell(4, bare=True) != ""))
    dims = F.when(F.size("cells") > 6, values.four_dims(_cell(6)))
    return rows.select("report_id", "place", _cell(1, bare=True).alias("tier"), _cell(2).alias("sort"), F.when(_cell(3).isin("-", "**-**"), "").otherwise(_cell(3, bare=True)).alias("code"), _cell(4, bare=True).alias("name"), _cell(5).alias("link"), dims.alias("dims"), _cell(7).alias("moat"), _cell(8).alias("metrics"), _cell(9).alias("path"))


def _sections(reports: DataFrame) -> DataFrame:
    """Lines with the number of lines so far, in their report, that name the first or the second appendix, or what follows it."""
    so_far = Window.partitionBy("report_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    names = {"one": F.col("line").contains(APPENDIX_ONE), "two": F.col("line").contains(APPENDIX_TWO)}
    rows = _cells(reports).withColumns({k: F.max(v).over(so_far) for k, v in names.items()} | {f"is_{k}": v for k, v in names.items()})
    end = F.col("two") & ~F.col("is_two") & (F.col("line").contains(APPENDIX_END[0]) | F.col("line").contains(APPENDIX_END[1]))
    return rows.withColumn("after", F.max(end).over(so_far))


def eliminated_rows(reports: DataFrame) -> DataFrame:
    """Stocks that reports rule out, in the first appendix's table: report_id, place, code, name, reason, rule_no."""
    rows = _sections(reports).filter("one and not is_one and not two and contains(line, '|') and not contains(line, '---')")
    rows = rows.filter((F.size("cells") >= 4) & ~_cell(1).isin("名称", "代码", ""))
    return rows.select("report_id", "place", _cell(1, bare=True).alias("code"), _cell(2, bare=True).alias("name"), _cell(3).alias("reason"), _cell(4).alias("rule_no"))


def chain_coverage(reports: DataFrame) -> DataFrame:
    """What reports say of each link in the second appendix, the last line that names it: report_id, link, state."""
    rows = _sections(reports).filter("two and not is_two and not after").filter(F.col("line").rlike("[:√×]"))
    each = rows.select("report_id", "place", "line", F.explode(F.array(*map(F.lit, LINKS))).alias("link")).filter("contains(line, link)")
    count = F.coalesce(F.nullif(F.regexp_extract("line", r"(\d+)", 1), F.lit("")), F.lit("1"))
    state = F.when(F.col("line").contains(COVERED) | F.col("line").contains("√"), F.concat(F.lit(COVERED), count, F.lit("家"))).when(F.col("line").contains(NO_LINK), NO_LINK).otherwise(UNCOVERED)
    return each.groupBy("report_id", "link").agg(F.max_by(state, "place").alias("state"))


def running_max(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the greatest value so far of their key: a rise that never falls."""
    return rows.withColumn("highest", F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def previews(stocks: DataFrame, each: int = 3) -> DataFrame:
    """The first stocks of each sector, by tier and code, as one list."""
    best = first_of_each(stocks, ["sector"], [F.asc("tier"), F.asc("code")], each)
    return best.groupBy("sector").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "code"))), lambda x: x["code"]).alias("codes"))


def index_quotes(items: DataFrame, item: str = "item") -> DataFrame:
    """Quotes of sector indices from maps of the market's own field names; a missing field is empty, a missing count 0."""
    m = F.col(item)
    either = lambda *names: F.coalesce(*(F.nullif(m[n], F.lit("")) for n in names), F.lit(""))
    picked = lambda *names: F.coalesce(*(F.nullif(values.field_like(m, n), F.lit("")) for n in names), F.lit(""))
    count = lambda name: F.coalesce(values.field_like(m, name).try_cast("long"), F.lit(0).cast("long"))
    change = values.field_like(m, "指数@涨跌幅:前复权").try_cast("double")
    return items.select(
        either("code", "指数代码").alias("code"), either("指数简称", "name").alias("name"), F.when(change.isNull(), "").otherwise(F.format_string("%.2f%%", change)).alias("change_rate"), picked("指数@收盘价", "指数@最新价").alias("price"),
        picked("指数@换手率").alias("turnover"), picked("指数@成交量").alias("volume"), picked("指数@成交额").alias("amount"), picked("指数@dde大单净额").alias("dde_net_amount"),
        picked("指数@dde大单净额{/}指数@流通市值{*}10000").alias("dde_intensity"),
        *(count(f"指数@{n}").alias(c) for n, c in (("上涨家数", "advancers"), ("下跌家数", "decliners"), ("涨停家数", "limit_up"), ("跌停家数", "limit_down"))),
    )


def sectors_at(news: DataFrame, quotes: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` sectors (array) of each news (id, query_date) with the value of that day, else the latest before."""
    listed = news.select("id", "query_date", F.posexplode(F.slice("sectors", F.lit(1), F.lit(most))).alias("place", "sector"))
    return snapshot(listed, quotes).select("id", "place", "sector", "value")


def saved_indices(indices: DataFrame, quotes: DataFrame, of_news: DataFrame, at: Column) -> DataFrame:
    """indices with the quotes (name, change_rate) of the news' sectors (news_id, sector) added, stamped with the time."""
    new = of_news.join(quotes.withColumnRenamed("name", "sector"), "sector").select("news_id", "sector", "change_rate", at.alias("query_time"))
    return indices.unionByName(new)


def indices_of(indices: DataFrame, news_id: Column) -> DataFrame:
    return indices.filter(F.col("news_id") == news_id)


def stock_quotes(items: DataFrame, item: str = "item") -> DataFrame:
    """Quotes of stocks from maps of the market's own field names; a missing field is empty."""
    m, entries = F.col(item), F.col("_entries")
    either = lambda *names: F.coalesce(*(F.nullif(m[n], F.lit("")) for n in names), F.lit(""))
    named = lambda *names: F.coalesce(*(F.nullif(values.dynamic_field(m, n, entries), F.lit("")) for n in names), F.lit(""))
    return items.withColumn("_entries", values.indicators(m)).select(
        either("code", "代码").alias("code"), either("name", "股票简称").alias("name"), either("market_code").alias("market_code"), either("price", "最新价").alias("price"), values.signed_rate(named("最新涨跌幅", "涨跌幅:前复权")).alias("change_rate"),
        named("dde大单净额").alias("dde_net_amount"), named("所属同花顺行业").alias("industrys"), named("换手率").alias("turnover_rate"), named("量比").alias("volume_ratio"),
    )


def sector_quotes(names: DataFrame, sectors: DataFrame, quotes: DataFrame) -> DataFrame:
    """The quote (name, change_rate) of each raw name's sector; names of no known sector, and sectors without a quote, have null."""
    found = normalised(names, sectors).withColumnRenamed("name", "sector")
    return found.join(quotes.select(F.col("name").alias("sector"), "change_rate"), "sector", "left")


def values_of_day(quotes: DataFrame, names: DataFrame, day: Column) -> DataFrame:
    """quotes (name, day, value) of one day for the names asked for; those without a value go."""
    return quotes.filter((F.col("day") == day) & F.col("value").isNotNull()).join(names.select("name").distinct(), "name", "left_semi").select("name", "value")


def sectors_with_stocks(stocks: DataFrame) -> DataFrame:
    return stocks.select("sector").distinct()


def value_strings(news: DataFrame, by_code: DataFrame, by_name: DataFrame) -> DataFrame:
    """news (id, sectors: array of structs code, name) with value_string: 'name:price|...' of those that have a price, in order."""
    listed = news.select("id", F.posexplode("sectors").alias("place", "x")).select("id", "place", "x.code", "x.name")
    told = priced(listed, by_code, by_name).filter("price is not null")
    made = told.groupBy("id").agg(values.built_values(F.array_sort(F.collect_list(F.struct("place", "name", F.col("price").alias("value"))))).alias("value_string"))
    return news.join(made, "id", "left").withColumn("value_string", F.coalesce("value_string", F.lit("")))


def report(feed: DataFrame, sectors: DataFrame, quotes: DataFrame) -> DataFrame:
    """A feed (id, score, publish_time, sectors as text) with its rank, its known sectors' number and their mean change.

    quotes: name and change_rate as text. A row without a quote says N/A. All rows' sectors are looked up at once.
    """
    listed = feed.select("id", F.explode(F.array_distinct(values.split_names(F.col("sectors")))).alias("raw"))
    names = normalised(listed.select("raw").distinct(), sectors).filter("normalized").select("raw", "name")
    rates = quotes.select("name", values.rate(F.col("change_rate")).alias("change"))
    means = listed.join(names, "raw").join(rates, "name", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_sectors"), F.avg("change").alias("mean"))
    out = feed.join(means, "id", "left").withColumns({"n_sectors": F.coalesce("n_sectors", F.lit(0).cast("long")), "mean_change": F.when(F.col("mean").isNull(), "N/A").otherwise(F.format_string("%+.2f%%", "mean"))})
    return ranked(out, F.desc("score"), F.desc("publish_time"), F.desc("id")).select("rank", "id", "score", "n_sectors", "mean_change")
