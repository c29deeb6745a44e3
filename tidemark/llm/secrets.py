"""Secret scans: candidates by pattern, false positives removed by a random forest that is trained on labelled findings.

All is DataFrame expressions and Spark's own forest. A candidate's features are its length; its character transitions:
how often neighbours change their kind, and how probable its pairs of characters are in the corpus's words; how much of it
the corpus's dictionary covers; what its path says (tests, examples); and which words stand beside it.

The dictionary is counted over all documents: words that at least `common` of them have, and LEAST at least. Its counts of
pairs of characters, 28 by 28 of them, are all of it that reaches the driver.

Labelled findings come from the caller, as a table of the columns that `candidates` gives and `label` (1: a secret). At
most `most_labelled` of them train the forest, those with the least hash. Where there are none, `planted` makes them: real
passages of `most_planted` documents, each with secrets of random characters and with what is mistaken for them (words,
placeholders, digests, code) written into it. What they look like is not told to the forest but by the features.

Defined results: a null or empty text has no findings. A null source is a path of no words. A finding that occurs twice
in a text, or in rows that repeat, is reported each time, with its place. A null doc_id is kept. Without labels of both
kinds every finding is kept with a score of null. An empty table gives an empty result. Secrets are given as hashes only.
Other columns than the three named are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: The forms of candidates. Quantifiers are possessive, so a value is matched to its end in one pass.
#: A block of a private key reaches to its END line, or without one over the lines of base64 that follow.
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+[0-9A-Za-z+/=]{16,}+)*+)"
#: Most places of a text can't begin a key by their first three characters.
KEYS = (
    r"(?=[AgxrsenhpSdy-][KSIhiloakypfG-][Izpousrtax_Jm.2-])(?:A[KS]IA[0-9A-Z]{12,}+|gh[pousr]_[0-9A-Za-z]{20,}+|github_pat_\w{20,}+|glpat-[\w-]{16,}+|xox[abeoprs]-[0-9A-Za-z-]{10,}+|xapp-[0-9A-Za-z-]{10,}+|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+|(?<![0-9A-Za-z])sk-[\w-]{20,}+|AIza[\w-]{30,}+"
    r"|(?<![\w-])eyJ[\w-]{10,}+\.[\w-]{10,}+\.[\w-]{5,}+|npm_[0-9A-Za-z]{30,}+|(?<![0-9A-Za-z])hf_[0-9A-Za-z]{30,}+|pypi-[\w-]{50,}+|(?<![0-9A-Za-z])SG\.[\w-]{16,}+\.[\w-]{16,}+|dop_v1_[0-9a-f]{40,}+|shp(?:at|ca|pa|ss)_[0-9A-Fa-f]{32,}+|ya29\.[\w-]{20,}+"
    rf"|{BLOCK})"
)
#: An identifier that has one of these words in it, and the sign that assigns to it (a type may stand between).
NAMES = r"pass(?:word|wd|wort|phrase|code)|pwd|secret|token|credential|auth|(?:api|access|private|signing|encryption|master|session|account|storage|service|client|shared|ssh)[_.-]?key"
LEAD = rf"(?<![\w.-])(?=[\w.-]++[\x22'\x60\])]{{0,3}}[\x20\t]*+[:=])(?=[\w.-]*?(?i:{NAMES}))[\w.-]++[\x22'\x60\])]{{0,3}}[\x20\t]*+(?::[\x20\t]*+[A-Za-z_][\w.<>\[\]&|]*+[\x20\t]*+(?==[^=>]))?(?::=|=>|={{1,3}}|:)[\x20\t]*+(?:[bfruBFRU]{{1,2}}(?=[\x22']))?"
SCHEME = r"(?:(?i:bearer|basic|digest|apikey|token)[\x20\t]++)"
#: A quoted value reaches to its closing quote (unless a key of fixed form begins inside), a bare one to a blank, a quote or one of <>,;
QUOTED = "|".join(rf"{q}(?:[^{q}\\\s]|\\.|[\x20\t](?!{KEYS})){{6,}}+{q}" for q in (r"\x22", "'", r"\x60"))
ASSIGNED = rf"{LEAD}(?:{QUOTED}|[\x22'\x60]?{SCHEME}?[^\s\x22'\x60<>,;]{{6,}}+)"
BEARER = r"(?<![\w-])(?i:bearer)[\x20\t]++[\w.~+/=-]{12,}+"
IN_URL = r"://[^\s/:@?#\x22'\x60<>]*+:[^\s/\x22'\x60<>]+@"
ENTROPY = rf"(?<![\w+/-])(?=(?:[A-Za-z+/_-]*+[0-9]){{3}})(?=(?:[0-9+/_-]*+[A-Za-z]){{2}})(?:(?!{KEYS})[\w+/-]){{20,}}+={{0,2}}"
CANDIDATE = f"{KEYS}|{ASSIGNED}|{BEARER}|{IN_URL}|{ENTROPY}"
#: Words beside findings that tell for or against.
FOR = r"(?i)\b(?:password|passwd|token|secret|key|credential|login|auth|aws|prod|production|access)"
AGAINST = r"(?i)\b(?:example|sample|test|dummy|fake|placeholder|fixture|docs?|e\.g|mock|demo|replace|your)"
PATH = r"(?i)(?:^|[/_.-])(?:test|tests|spec|example|examples|fixture|fixtures|mock|docs?|sample|demo)"
FEATURES = ("n_chars", "lower_digit", "case_change", "other_change", "pairs", "distinct", "digits", "covered", "longest_run", "is_assigned", "is_key", "beside_for", "beside_against", "path_against", "vowels")
MARK = "\ue000\ue001\ue000"
LETTERS, KINDS = "abcdefghijklmnopqrstuvwxyz", 28
LEAST = 5


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, nth, start (code points before the finding), kind, value, before and after (40 characters each)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # marks around each finding, so that a text is searched once; a text that has the mark itself is searched twice instead
    marked = F.split(F.regexp_replace("text", f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK, -1)
    twice = F.flatten(F.zip_with(F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)), lambda l, x: F.array(l, F.coalesce(x, F.lit("")))))
    parts = F.when(F.col("text").contains(MARK), F.slice(twice, F.lit(1), F.size(twice) - 1)).otherwise(marked)
    # of the text between findings only its length and what stands beside them go on, so rows stay small
    told = lambda x, i: F.when(i % 2 == 0, F.struct(F.length(x).alias("n"), F.left(x, F.lit(40)).alias("first"), F.right(x, F.lit(40)).alias("last"), F.lit("").alias("finding"))).otherwise(F.struct(F.length(x).alias("n"), F.lit("").alias("first"), F.lit("").alias("last"), x.alias("finding")))
    rows = rows.select("doc_id", "path", F.monotonically_increasing_id().alias("row"), F.transform(parts, told).alias("parts")).filter("size(parts) > 1")
    each = rows.select("doc_id", "path", "row", "parts", F.explode(F.sequence(F.lit(0), F.expr("size(parts) div 2 - 1"))).alias("nth"))
    part = lambda k: F.get("parts", F.col("nth") * 2 + k)
    each = each.select("doc_id", "path", "row", "nth", part(1)["finding"].alias("finding"), part(0).alias("l"), part(2).alias("r"))
    grown = F.sum(F.col("l.n") + F.length("finding")).over(Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) - F.length("finding")
    finding, kind = F.col("finding"), F.col("kind")
    each = each.select(
        "doc_id", "path", "nth", grown.cast("long").alias("start"), F.col("l.last").alias("before"), F.col("r.first").alias("after"), "finding",
        F.when(finding.rlike(rf"^(?:{KEYS})\z"), F.regexp_extract("finding", r"^(A[KS]IA|github|gh.|glpat|xox|xapp|[rs]k|AIza|eyJ|npm|hf|pypi|SG|dop|shp|ya29|-----)", 1))
        .when(finding.startswith("://"), "url").when(finding.rlike(rf"^(?:{BEARER})\z"), "bearer").when(finding.rlike(f"^{LEAD}"), "assigned").otherwise("entropy").alias("kind"),
    )
    each = each.withColumn("held", F.when(kind == "assigned", F.regexp_replace("finding", f"^{LEAD}", "")).otherwise(finding))
    quoted = (kind == "assigned") & F.col("held").rlike(rf"^(?:{QUOTED})\z")
    bare = F.regexp_replace(F.regexp_replace("held", rf"^[\x22'\x60]?{SCHEME}?", ""), r"[.:)\]}]+\z", "")
    value = (
        F.when(quoted, F.regexp_replace(F.regexp_replace("held", r"^.|.\z", ""), f"^{SCHEME}", "")).when(kind.isin("assigned", "bearer"), bare)
        .when(kind == "url", F.regexp_replace("held", r"^://[^:]*+:|@\z", "")).otherwise(F.col("held"))
    )
    name = F.when(kind == "assigned", F.regexp_extract("finding", r"^([\w.-]+)", 1)).otherwise("")
    return each.select("doc_id", "path", "nth", "start", "kind", value.alias("value"), F.concat_ws(" ", "before", name).alias("before"), "after")


def dictionary(docs: DataFrame, *, text_col: str = "text", common: float = 1e-5) -> DataFrame:
    """word, documents: the words of three letters or more, in lower case, of at least so great a share of all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\p{L}{3,}+"), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    return durable(counted.filter(F.col("documents") >= max(LEAST, common * docs.count())))


def _kind_of(character: Column) -> Column:
    """0 to 25: that letter, 26: another letter, 27: no letter."""
    place = F.instr(F.lit(LETTERS), F.lower(character))
    return F.when((place > 0) & (character != ""), place - 1).when(character.rlike(r"^\p{L}"), KINDS - 2).otherwise(KINDS - 1)


def _pairs(text: Column) -> Column:
    """The text's neighbouring kinds of characters, each pair as one number."""
    kinds = F.transform(F.split(text, ""), _kind_of)
    return F.zip_with(F.slice(kinds, F.lit(1), F.greatest(F.size(kinds) - 1, F.lit(0))), F.slice(kinds, F.lit(2), F.greatest(F.size(kinds) - 1, F.lit(0))), lambda a, b: a * KINDS + b)


def transitions(words: DataFrame) -> list[float]:
    """Log probabilities of a kind of character after another in the words, by how many documents have them."""
    seen = {r.pair: r.n for r in words.select("documents", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("documents").alias("n")).collect()}
    rows = [sum(seen.get(a * KINDS + b, 0) for b in range(KINDS)) for a in range(KINDS)]
    return [math.log((seen.get(a * KINDS + b, 0) + 0.5) / (rows[a] + 0.5 * KINDS)) for a in range(KINDS) for b in range(KINDS)]


def with_features(found: DataFrame, words: DataFrame, logs: list[float]) -> DataFrame:
    """found with the column features. found is computed once and kept, as its rows are numbered."""
    found = durable(found.withColumn("_nth_finding", F.monotonically_increasing_id()))
    value, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(value, r"(\p{Ll})(?=\p{Lu})", "$1 ")), F.lit(r"\p{L}{3,}+"), F.lit(0))
    held = found.select("_nth_finding", F.explode(parts).alias("word")).join(words.select("word"), "word").groupBy("_nth_finding").agg(F.sum(F.length("word")).alias("_held"))
    runs = F.transform(F.regexp_extract_all(value, F.lit(r"((.)\2*)"), F.lit(1)), F.length)
    beside = F.concat_ws(" ", "before", "after")
    table = F.array(*(F.lit(x) for x in logs))
    columns = {
        "n_chars": F.log2(size), "lower_digit": share(r"[a-zA-Z](?=[0-9])|[0-9](?=[a-zA-Z])"), "case_change": share(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "other_change": share(r"[^A-Za-z0-9]"),
        "pairs": F.aggregate(_pairs(value), F.lit(0.0), lambda held, x: held + F.get(table, x)) / size, "distinct": F.size(F.array_distinct(F.split(value, ""))) / size, "digits": share("[0-9]"),
        "covered": F.coalesce("_held", F.lit(0)) / size, "longest_run": F.coalesce(F.array_max(runs), F.lit(0)) / size, "is_assigned": F.col("kind") == "assigned", "is_key": value.rlike(rf"^(?:{KEYS})\z"),
        "beside_for": beside.rlike(FOR), "beside_against": beside.rlike(AGAINST), "path_against": F.col("path").rlike(PATH), "vowels": share("[aeiouAEIOU]"),
    }
    rows = found.join(held, "_nth_finding", "left").withColumns({f"f_{k}": v.cast("double") for k, v in columns.items()})
    return rows.withColumn("features", array_to_vector(F.array(*(F.col(f"f_{k}") for k in FEATURES)))).drop("_nth_finding", "_held", *(f"f_{k}" for k in FEATURES))


def planted(docs: DataFrame, *, text_col: str = "text", path_col: str = "source", most: int = 1000, seed: str = "a") -> DataFrame:
    """Labelled findings: secrets of random characters, and what is mistaken for them, written into passages of at most `most` documents."""
    rows = docs.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text")).filter("length(text) > 20")
    at = F.pmod(F.xxhash64(F.lit(f"{seed} at"), "text"), F.length("text").cast("long")).cast("int") + 1
    drawn = F.sha2(F.concat(F.lit(f"{seed} "), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(seed), "text"))), 512)
    # passages, not texts, are sorted: a task sends the first `most` of its own
    rows = rows.select("path", drawn.alias("hex"), F.substring("text", at - 40, F.lit(40)).alias("before"), F.substring("text", at, F.lit(60)).alias("after"))
    rows = durable(rows.orderBy("hex", "path", "before").limit(most))
    rows = rows.withColumn("big", F.regexp_replace(F.base64(F.unhex("hex")), "[+/=]", "Q"))
    rows = rows.withColumns({"w1": F.regexp_extract("after", r"(\p{L}{4,12})", 1), "w2": F.regexp_extract(F.reverse("after"), r"(\p{L}{4,12})", 1)})
    rows = rows.withColumns({"w1": F.when(F.col("w1") == "", "word").otherwise(F.col("w1")), "w2": F.when(F.col("w2") == "", "none").otherwise(F.reverse("w2"))})
    hexed, big = lambda k, n: f"substring(hex, {k}, {n})", lambda k, n: f"substring(big, {k}, {n})"
    true = [
        ('api_key = "', hexed(1, 32), '"'), ("password=", big(2, 12), " "), ("key ", f"concat('AKIA', upper({big(5, 16)}))", " "), ('token = "', hexed(40, 40), '"'), ("use ", f"concat('ghp_', {big(9, 36)})", " "), ("postgres://app:", big(20, 14), "@db/x"),
        ("Authorization: Bearer ", big(30, 40), " "), ("client_secret: '", f"concat_ws('-', {hexed(3, 8)}, {hexed(11, 4)}, {hexed(15, 4)}, {hexed(19, 12)})", "'"), ("session ", f"concat('eyJ', {big(1, 20)}, '.eyJ', {big(22, 30)}, '.', {big(50, 30)})", " "), ("passwd: ", f"concat({big(60, 5)}, '!', {big(66, 4)})", " "),
    ]
    wrong = [
        ('password = "', "concat(w1, w2)", '"'), ("token: ", "concat('your_', lower(w1), '_here')", " "), ('api_key = "', "repeat('x', 24)", '"'), ("key ", "concat('AKIA', upper(substring(concat(w1, 'XXXXX'), 1, 4)), 'EXAMPLE', 'XXXXX')", " "), ("commit ", hexed(2, 40), " "), ("sha256: ", hexed(5, 64), " "),
        ("id ", f"concat_ws('-', {hexed(30, 8)}, {hexed(41, 4)}, {hexed(45, 4)}, {hexed(49, 12)})", " "), ("password = ", "concat('get_', lower(w1), '(', lower(w2), ')')", " "), ("token = ", "concat('request.', lower(w1), '.', lower(w2))", " "), ("secret: ", "concat(w1, w1)", " "), ("auth: ", "'1234567890'", " "), ('the password: "', "concat(w1, ' ', w2)", '"'),
    ]
    carriers = [F.struct(F.lit(label).alias("label"), F.lit(lead).alias("lead"), F.expr(value).alias("planted"), F.lit(end).alias("end")) for label, forms in ((1, true), (0, wrong)) for lead, value, end in forms]
    rows = durable(rows.select("path", "before", "after", F.inline(F.array(*carriers))).withColumn("doc_id", F.monotonically_increasing_id()))
    found = candidates(rows.withColumn("text", F.concat("before", F.lit(" "), "lead", "planted", "end", F.lit(" "), "after")), path_col="path")
    both = found.join(rows.select("doc_id", "label", "planted"), "doc_id").filter(F.expr("instr(planted, value) > 0 or instr(value, planted) > 0"))
    return both.drop("planted")


def trained(labelled: DataFrame, words: DataFrame, logs: list[float], most_labelled: int = 20_000) -> RandomForestClassificationModel | None:
    key = F.xxhash64("value", "before", "after", "label")
    sample = with_features(labelled.orderBy(key, "value").limit(most_labelled), words, logs)
    sample = durable(sample.select("features", F.col("label").cast("double")).orderBy(F.xxhash64(F.col("label"), F.to_json(vector_to_array("features")))).coalesce(1))
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=32, maxDepth=8, seed=7, subsamplingRate=0.8, featureSubsetStrategy="5").fit(sample)


def scored(found: DataFrame, model: RandomForestClassificationModel | None, words: DataFrame, logs: list[float]) -> DataFrame:
    if model is None:
        return found.withColumn("score", F.lit(None).cast("double"))
    out = model.transform(with_features(found, words, logs))
    score: Column = F.round(vector_to_array("probability")[1], 6)
    return out.withColumn("score", score).drop("features", "rawPrediction", "probability", "prediction")


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", cut: float = 0.5, most_labelled: int = 20_000, most_planted: int = 400, common: float = 1e-5) -> DataFrame:
    """One row per finding: doc_id, nth, start, n_chars, kind, value_sha256, score, kept (false: a false positive)."""
    found = durable(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col))
    words = dictionary(docs, text_col=text_col, common=common)
    logs = transitions(words)
    model = trained(planted(docs, text_col=text_col, path_col=path_col, most=most_planted) if labelled is None else labelled, words, logs, most_labelled)
    return scored(found, model, words, logs).select(
        "doc_id", F.col("nth").cast("long").alias("nth"), "start", F.length("value").cast("long").alias("n_chars"), "kind", F.sha2("value", 256).alias("value_sha256"), "score", F.coalesce(F.col("score") >= cut, F.lit(True)).alias("kept")
    )
