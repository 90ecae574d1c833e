"""Secret scan in DataFrame functions alone: fixed patterns, and a pair of character Markov models.

The models are first-order chains over printable ASCII, one of random strings and one of ordinary identifiers, counted
over labelled samples. A long token that no pattern found is a secret when its log-likelihood ratio is high enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run fails as a whole, and no later start in it could do better
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_RATIO = 15.0  # nats
BACK_OFF = 5.0
FIRST, SYMBOLS = 33, 94  # printable ASCII
PROGRAM_DOCS = 2000  # documents to whose words the identifiers made of IDENTIFIER_WORDS are added once
RANDOM_STRINGS = 4000
LEAST_MEAN = 0.5  # nats a pair of characters
MASK = "[SECRET]"
#: Words that programmers join into identifiers; samples of ordinary identifiers besides the corpus's own words.
IDENTIFIER_WORDS = (
    "get set is has add remove delete create update find search load save read write open close start stop run build make parse format render send receive fetch push pop count total "
    "user account customer order item product price name title value key index list map array table row column field record file path folder directory url link page view model data "
    "request response message event handler listener callback service client server session connection database query result error warning status state config option setting parameter "
    "default current previous next first last min max size length width height color date time day month year id type class object string number integer boolean information balance "
    "manager factory helper utils common internal external public private static abstract base parent child node tree graph path word text line character buffer stream input output"
)


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, random, n): strings made from digests, and identifiers made from the words of all documents.

    Identifiers of the corpus are counted in parts that overlap in the character where they are joined, so that equal parts
    are one row with their number ``n``; the pairs of symbols in them are those of the whole identifiers. Those made of
    IDENTIFIER_WORDS count once for every PROGRAM_DOCS documents, so that they keep their share in a corpus of any size.
    """
    spark, times = docs.sparkSession, max(1, docs.count() // PROGRAM_DOCS)
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    mixed = F.base64(F.unhex(digest))
    shape = F.col("id") % 4
    made = F.when(shape == 0, mixed).when(shape == 1, digest).when(shape == 2, F.upper(F.regexp_replace(mixed, "[+/=]", ""))).otherwise(F.regexp_replace(mixed, "[+/=]", "_"))
    random = spark.range(RANDOM_STRINGS).select(made.alias("value"), F.lit(True).alias("random"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))

    def parts(one: Column, i: Column) -> Column:
        """Of a word and the next one (if any), joined by turns as one_two, oneTwo, one-two and one/two."""
        two = F.get("w", i + 1)
        sep = F.when(i % 4 == 0, "_").when(i % 4 == 2, "-").otherwise("/")
        low = F.when(i % 4 == 3, F.lower(one)).otherwise(one)
        camel = F.array(one, F.concat(F.right(one, F.lit(1)), F.upper(F.left(two, F.lit(1)))), F.initcap(two))
        joined = F.array(F.when(two.isNull() & (i % 4 != 3), low).otherwise(F.concat(low, sep)), F.concat(sep, two))
        return F.array_compact(F.when(i % 4 == 1, camel).otherwise(joined))

    split = docs.select(words.alias("w")).select(F.explode(F.transform("w", parts)).alias("v")).select(F.explode("v").alias("value"))
    corpus = split.groupBy("value").agg(F.count("*").alias("n")).select("value", F.lit(False).alias("random"), "n")
    known = F.split(F.lit(IDENTIFIER_WORDS), " ")
    n_known = len(IDENTIFIER_WORDS.split())
    three = [F.get(known, ((F.col("id") * k + F.col("id") / n_known) % n_known).cast("int")) for k in (1, 7, 13)]
    camel = F.concat(three[0], F.initcap(three[1]), F.initcap(three[2]))
    program = spark.range(RANDOM_STRINGS).select(F.when(F.col("id") % 3 == 0, camel).when(F.col("id") % 3 == 1, F.concat_ws("_", *three)).otherwise(F.upper(F.concat_ws("_", *three))).alias("value"), F.lit(False).alias("random"))
    return random.withColumn("n", F.lit(1).cast("bigint")).unionByName(program.withColumn("n", F.lit(times).cast("bigint"))).unionByName(corpus)


def _code(value: Column, i: Column) -> Column:
    return F.ascii(F.substring(value, i, F.lit(1))) - FIRST


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of every pair of symbols. Only the counts of the fixed number of
    pairs come to the driver; without samples every ratio is zero."""
    pairs = samples.where(F.length("value") > 1).select(
        "random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.struct(_code(F.col("value"), i).alias("a"), _code(F.col("value"), i + 1).alias("b")))).alias("p")
    )
    inside = F.col("p.a").between(0, SYMBOLS - 1) & F.col("p.b").between(0, SYMBOLS - 1)
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.where(inside).groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n")).collect()}
    totals: dict[tuple[bool, int], int] = {}
    single: dict[tuple[bool, int], int] = {}
    for (kind, a, b), n in counts.items():
        totals[kind, a] = totals.get((kind, a), 0) + n
        single[kind, b] = single.get((kind, b), 0) + n
    size = {kind: sum(n for (k, _), n in single.items() if k == kind) for kind in (True, False)}

    def chance(kind: bool, a: int, b: int) -> float:
        """Of symbol b after a; rare pairs lean on how frequent b is anywhere."""
        alone = (single.get((kind, b), 0) + 0.5) / (size[kind] + 0.5 * SYMBOLS)
        return (counts.get((kind, a, b), 0) + BACK_OFF * alone) / (totals.get((kind, a), 0) + BACK_OFF)

    return [math.log(chance(True, a, b) / chance(False, a, b)) if counts else 0.0 for a in range(SYMBOLS) for b in range(SYMBOLS)]


def _ratio(value: Column, table: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda s, i: s + F.get(table, (_code(value, i) * SYMBOLS + _code(value, i + 1)).cast("int")))


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches as (start, kind, end, value), in code points. The pieces between matches give the places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.zip_with(F.transform(between, lambda x: F.length(x)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda gap, m: F.struct(gap.alias("gap"), m["m"].alias("m"), m["v"].alias("v")))
    kind_type = "struct<start:int,kind:int,end:int,value:string>"
    empty = F.array().cast(f"array<{kind_type}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value")).cast(kind_type)
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out")))

    return F.when(text.rlike(pattern), F.aggregate(lengths, start, step, lambda a: a["out"])).otherwise(empty)


def find_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``docs`` with two sorted arrays of (start, kind, end): ``base`` of the fixed patterns, ``spans`` of all secrets.

    ``kind`` is the place in KINDS; places are code points from 0, the end exclusive. Matches of one pattern do not
    overlap, those of different patterns may; a token that the models add touches no base span. Null and empty texts have
    empty arrays; repeated rows and null ids are like any other row. Columns called like the outputs would be replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    found = docs.withColumns({
        "__assign": F.filter(_spans(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST),
        "__access": _spans(text, ACCESS, 1),
        "__hex": _spans(text, HEX, 2),
        "__tokens": _spans(text, CANDIDATE, 3),
    }).withColumn(base, F.array_sort(F.concat("__assign", "__access", "__hex")))
    free = lambda x: ~F.exists(F.col(base), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    least = lambda x: F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * (F.length(x["value"]) - 1))
    added = F.filter("__tokens", lambda x: free(x) & (_ratio(x["value"], table) >= least(x)))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    both = found.withColumn(spans, F.when(F.size("__tokens") == 0, F.col(base)).otherwise(F.array_sort(F.concat(F.col(base), added))))
    return both.withColumns({base: bare(F.col(base)), spans: bare(F.col(spans))}).drop("__assign", "__access", "__hex", "__tokens")


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every stretch of overlapping spans replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask)).alias("out"))
        return F.when(x["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))

    cleaned = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cleaned).otherwise(text)
