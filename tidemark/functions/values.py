"""Values in delimited strings, quotes, JSON of language models, and small rules, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: The dimensions of a stock's grade, and what their highest and unknown grades are called.
DIMENSIONS, HIGH, UNKNOWN = ("竞争", "盈利", "客户", "技术"), "高", "未知"
#: A sentence that means no, what a reply then would have said, and a ranking among a quote's fields.
NO_MOVE, WILL_MOVE, RANKING = "不会引起市场波动", "will_flunctuate", "排名"


def of_equal(rows: Column, key: str, last: bool) -> Column:
    """Of an array's structs with equal keys the last (or first) one, in the array's order."""
    placed = F.array_sort(F.transform(rows, lambda x, i: F.struct(x[key].alias("key"), (i if last else -i).alias("place"), x.alias("row"))))
    kept = once(placed, lambda held: F.filter(held, lambda x, i: ~x["key"].eqNullSafe(F.get(held, i + 1)["key"]) | (i + 1 == F.size(held))))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(F.abs(x["place"]).alias("place"), x["row"].alias("row"))))
    return F.transform(ordered, lambda x: x["row"])


def parsed_values(text: Column) -> Column:
    """The map of 'name:value|name:value': split at the last colon, bad numbers skipped, the last of equal names wins."""
    pairs = F.transform(F.split(text, r"\|"), lambda x: F.struct(F.regexp_extract(x, r"^(.*):([^:]*)$", 1).alias("name"), F.regexp_extract(x, r"^(.*):([^:]*)$", 2).try_cast("double").alias("value")))
    return F.map_from_entries(of_equal(F.filter(pairs, lambda x: (x["name"] != "") & x["value"].isNotNull()), "name", last=True))


def client_values(text: Column) -> Column:
    """The map as clients read it: between the first two colons, names trimmed, bad numbers are 0, the last of equal names wins."""
    pairs = F.transform(F.filter(F.split(text, r"\|"), lambda x: x.contains(":")), lambda x: F.struct(F.btrim(F.get(F.split(x, ":"), F.lit(0))).alias("name"), F.coalesce(F.get(F.split(x, ":"), F.lit(1)).try_cast("double"), F.lit(0.0)).alias("value")))
    return F.map_from_entries(of_equal(pairs, "name", last=True))


def client_changes(published: Column, current: Column) -> Column:
    """By sector of the published values: name, published, current and change; a missing current value is the published one."""
    none = F.coalesce(current, F.lit("")) == ""
    both = F.struct(client_values(F.coalesce(published, F.lit(""))).alias("before"), F.when(~none, client_values(current)).alias("now"))

    def changes(held: Column) -> Column:
        told = lambda x: F.coalesce(held["now"][x["key"]], x["value"])
        return F.transform(F.map_entries(held["before"]), lambda x: F.struct(x["key"].alias("name"), x["value"].alias("published"), told(x).alias("current"), (told(x) - x["value"]).alias("change")))

    return once(both, changes)


def built_values(pairs: Column) -> Column:
    """'name:value|...' of an array of structs (name, value), in its order."""
    return F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["name"], x["value"].cast("string"))), "|")


def max_rise(published: Column, current: Column) -> Column:
    """The greatest rise in percent over the names of both maps, at least 0, with two decimals."""
    rises = F.transform(F.filter(F.map_entries(published), lambda x: (x["value"] > 0) & F.map_contains_key(current, x["key"])), lambda x: (F.element_at(current, x["key"]) - x["value"]) / x["value"] * 100)
    return F.round(F.greatest(F.lit(0.0), F.array_max(rises)), 2)


def percent(change: Column, base: Column) -> Column:
    return F.when(base > 0, change / base * 100).otherwise(0.0)


def rate(text: Column) -> Column:
    """The number in '+2.35%'; null if there is none."""
    return F.regexp_replace(text, r"[%+\s]", "").try_cast("double")


def four_dims(text: Column) -> Column:
    """The map of '高/中/低/高' by dimension; one whose part lacks is 未知, one whose part is empty is empty."""
    parts = F.split(F.coalesce(text, F.lit("")), "/")
    graded = [F.coalesce(F.btrim(F.get(parts, F.lit(i))), F.lit(UNKNOWN)) for i in range(len(DIMENSIONS))]
    return F.map_from_arrays(F.array(*(F.lit(d) for d in DIMENSIONS)), F.array(*graded))


def high_dims(dims: Column) -> Column:
    return F.size(F.filter(F.map_values(dims), lambda x: x == HIGH))


def field_like(item: Column, prefix: str) -> Column:
    """The value of the map's first key that begins with prefix and is no ranking."""
    return F.get(F.filter(F.map_entries(item), lambda x: x["key"].startswith(prefix) & ~x["key"].contains(RANKING)), F.lit(0))["value"]


def indicator(key: Column) -> Column:
    """An indicator's name: its letters, digits and Chinese characters, without the day or days in brackets."""
    day = r"\d{8}(\s\d{2}:\d{2}:\d{2})?"
    return F.regexp_replace(F.regexp_replace(key, rf"\[{day}(-{day})?\]", ""), r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9]+", "")


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, "[a-zA-Z]+$", "")


def indicators(item: Column) -> Column:
    """The map's entries (key, value) with their indicator's name and this without a latin ending (bare)."""
    named = F.transform(F.map_entries(item), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), indicator(x["key"]).alias("name")))
    return F.transform(named, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), x["name"].alias("name"), _bare(x["name"]).alias("bare")))


def dynamic_field(item: Column, name: str, entries: Column | None = None) -> Column:
    """The value of the map's key `name`, else of its first key for the same indicator; a latin ending on one side may differ.

    entries: the map's indicators, where several fields of a row are looked for and they are at hand.
    """
    wanted = indicator(F.lit(name))
    same = lambda x: (x["name"] == wanted) | (x["bare"] == wanted) | ((_bare(wanted) != "") & (x["name"] == _bare(wanted)))
    found = F.get(F.filter(indicators(item) if entries is None else entries, same), F.lit(0))["value"]
    return F.when(F.map_contains_key(item, name), F.element_at(item, name)).otherwise(found)


def members(names: Column, known: Column) -> Column:
    """The names that are known, in their order; repeated names stay repeated."""
    return F.filter(names, lambda x: F.array_contains(known, x))


def split_names(text: Column) -> Column:
    """The names in a text, between bars or, where it has none, commas."""
    parts = F.when(text.contains("|"), F.split(text, r"\|")).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def batch_size(mean_chars: Column, most: int = 10, room: int = 3500, overhead: int = 200) -> Column:
    """So many articles go into a model's request: its room in tokens over an article's, a token being four characters."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(room) / (mean_chars / 4 + overhead)))).cast("long")


def intent(question: Column) -> Column:
    return F.when(question.contains("指数") | question.contains("板块"), "zhishu").otherwise("stock")


def signed_rate(value: Column) -> Column:
    """'+2.35%' of a number; nothing of none, and no sign before 0."""
    number = value.try_cast("double")
    return F.when(number.isNull(), "").when(number > 0, F.format_string("+%.2f%%", number)).otherwise(F.format_string("%.2f%%", number))


def safe_round(value: Column, decimals: int = 2) -> Column:
    """A number in a text, rounded; null if it is none."""
    return F.bround(value.try_cast("double"), decimals)


def url_parameters(url: Column) -> Column:
    """The map of an address's query; of equal names the first value."""
    pairs = F.filter(F.transform(F.split(F.parse_url(url, F.lit("QUERY")), "&"), lambda x: F.split(x, "=", 2)), lambda x: F.get(x, F.lit(1)) != "")
    known = F.transform(pairs, lambda x: F.struct(F.url_decode(x[0]).alias("name"), F.url_decode(x[1]).alias("value")))
    first = F.filter(known, lambda x, i: ~F.exists(F.slice(known, F.lit(1), i), lambda y: y["name"] == x["name"]))
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def hashed(secret: Column) -> Column:
    return F.sha2(secret, 256)


def masked_phone(phone: Column) -> Column:
    return F.concat(F.lit("游客"), F.right(phone, F.lit(4)))


def valid_phone(phone: Column) -> Column:
    return F.coalesce(phone.rlike(r"^1[3-9]\d{9}$"), F.lit(False))


def valid_email(email: Column) -> Column:
    return F.coalesce(email.rlike(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"), F.lit(False))


def subscription(level: Column, expires: Column, now: Column) -> Column:
    """The level that holds now: an expired or missing one is free."""
    return F.when(level.isNull() | (expires < now), "free").otherwise(level)


def score_band(score: Column) -> Column:
    return F.when(score >= 9, "high").when(score >= 7, "middle").otherwise("low")


def change_sign(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")


def composite_score(intensity: Column, move: Column, duration: Column) -> Column:
    """The documented weighting for model replies; nothing in the engine depends on it."""
    return intensity * 0.7 + move * 0.15 + duration * 0.15


def _parsed(text: Column, schema: str) -> Column:
    """The struct in a JSON object, or in a list of just one; null if the text is no JSON."""
    known = F.try_parse_json(text).isNotNull()
    several = F.from_json(text, f"array<struct<{schema}>>")
    return F.when(known & text.startswith("{"), F.from_json(text, schema)).when(known & text.startswith("[") & (F.size(several) == 1), several[0])


def recovered_json(blocks: Column, schema: str) -> Column:
    """The struct in a model's reply, of the last block that holds one: its widest part in brackets, without fences.

    Where no block has one and the schema has WILL_MOVE, a reply that only says NO_MOVE is the struct with that false.
    """
    unfenced = F.transform(blocks, lambda x: F.regexp_replace(F.regexp_replace(F.btrim(x), r"(?m)^```json\s*", ""), r"(?m)^```\s*$", ""))
    found = F.filter(F.transform(F.reverse(unfenced), lambda x: _parsed(F.regexp_extract(x, r"[\[{][\s\S]*[\]}]", 0), schema)), lambda x: x.isNotNull())
    first = F.get(found, F.lit(0))
    if f"{WILL_MOVE} " not in schema:
        return first
    joined = F.array_join(blocks, "\n")
    unmoved = ~joined.rlike(rf"\"{WILL_MOVE}\"\s*:\s*(true|false)") & joined.contains(NO_MOVE)
    return F.coalesce(first, F.when(unmoved, F.from_json(F.lit(f'{{"{WILL_MOVE}": false}}'), schema)))


def _objects(text: str) -> list[str]:
    """What stands in balanced braces and in no wider ones; a brace that is never closed counts for nothing."""
    opened, found = [], []
    for brace in re.finditer("[{}]", text):
        if brace.group() == "{":
            opened.append(brace.start())
        elif opened:
            start = opened.pop()
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, brace.end()))
    return [text[a:b] for a, b in found]


def loose_objects(text: Column) -> Column:
    """The array of a text's parts in balanced braces, however deep."""
    return F.arrow_udf(lambda texts: pa.array([None if t is None else _objects(t) for t in texts.to_pylist()], pa.list_(pa.string())), "array<string>")(text)


def recovered_batch(blocks: Column, schema: str, needed: tuple[str, ...] = ("id", WILL_MOVE)) -> Column:
    """The array of structs in a model's reply: of its widest list, else of each object in balanced braces that has all of `needed`.

    Of equal ids the list's last one counts, of objects the first.
    """
    plain = F.regexp_replace(F.array_join(blocks, "\n"), r"```(?:json)?\s*", "")

    def widest(held: Column) -> Column:
        begin, end = F.locate("[", held), F.length(held) - F.length(F.substring_index(held, "]", -1))
        return F.when((begin > 0) & (end > begin), F.substring(held, begin, end - begin + 1)).otherwise("")

    def listed(held: Column) -> Column:
        return once(widest(held), lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, f"array<struct<{schema}>>")))

    def chosen(held: Column) -> Column:
        last = of_equal(F.filter(held["listed"], lambda x: x["id"].isNotNull()), "id", last=True)
        # objects are read only where there is no list, each at most twice: whether it is JSON, and what it says
        objects = F.transform(held["texts"], lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema)))
        first = of_equal(F.filter(objects, lambda x: reduce(lambda a, b: a & b, (x[n].isNotNull() for n in needed))), "id", last=False)
        return F.when(held["listed"].isNotNull(), last).otherwise(first)

    return once(F.struct(once(plain, listed).alias("listed"), loose_objects(plain).alias("texts")), chosen)


def aligned(replies: Column, total: Column) -> Column:
    """The replies of ids 1 to total, null where there is none."""
    numbered = lambda held: F.transform(F.sequence(F.lit(1), total), lambda n: F.get(F.filter(held, lambda x: x["id"] == n), F.lit(0)))
    return once(replies, lambda held: F.when(total > 0, numbered(held)).otherwise(F.slice(held, F.lit(1), F.lit(0))))


def recovered_review(blocks: Column, schema: str) -> Column:
    """The struct in a review's reply (an array of structs type, text): of the last text block that is JSON or has it in braces."""

    def read(x: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(F.btrim(x["text"]), r"^```json\s*", ""), r"\s*```\s*$", "")
        return F.coalesce(_parsed(text, schema), _parsed(F.regexp_extract(text, r"\{[\s\S]+\}", 0), schema))

    return F.get(F.filter(F.transform(F.reverse(F.filter(blocks, lambda x: x["type"] == "text")), read), lambda x: x.isNotNull()), F.lit(0))


def filled(template: str, fields: dict[str, Column], most: int = 3000) -> Column:
    """The template with each <<name>> replaced by its column, cut at `most` characters."""
    return reduce(lambda c, kv: F.replace(c, F.lit(f"<<{kv[0]}>>"), F.substring(F.coalesce(kv[1], F.lit("")), 1, most)), fields.items(), F.lit(template))
