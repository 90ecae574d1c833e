"""Personal data in DataFrame functions alone: fixed patterns, and boosted trees over the spans of generous generators.

Generators propose spans, which may overlap, of five kinds that fixed patterns miss or that need their context to tell.
Trees look at a span's format and at the words around it; they are fitted to labelled samples written from templates, and
each kind's threshold is calibrated on samples that the trees have not seen. Of proposals that overlap, the likeliest
stays; none touches a span of the fixed patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.boosting import Trees, fit_trees, least_scores, score
from inkveil.llm.spans import let, located, scan

#: The fixed patterns, written so that no start is tried twice in a run of characters and no repetition recurses.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
_AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT|@)\x20)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
GENERATORS = {
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,39}+" + _AT + r"[A-Za-z0-9-]{2,30}(?:" + _DOT + r"[A-Za-z0-9-]{2,12}){1,3}",
    "local_phone": r"(?<![0-9A-Za-z+.,/_-])(?:\([0-9]{2,5}\)[\x20-]?|0?[0-9]{2,4}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z]|[.,/-][0-9])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card_like": r"(?<![0-9A-Za-z])[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{1,7}(?![0-9A-Za-z])",
}
KINDS = (*BASE, *GENERATORS)
SHORTEST, LONGEST = 7, 160  # characters of what a generator can propose
NEIGHBOURS = len(GENERATORS) * (LONGEST // SHORTEST + 2)  # proposals on one side that can overlap a proposal, at most
CUES = {
    "masked_email": r"e-?mail|mail(?:to)?\b|write to|contact|reach|address",
    "local_phone": r"phone|\btel|\bcall|mobile|\bfax|contact|reach|\bsms",
    "national_id": r"\bssn|social sec|id number|identity|national id|insurance",
    "iban": r"iban|account|transfer|bank|\bbic",
    "card_like": r"card|visa|mastercard|amex|credit|debit|payment",
}
AGAINST = r"order|invoice|\bpage|isbn|version|\bdate|score|serial|\bpart|\bref|total|price|\bno\.|number of|between|chapter|tracking|build|lot\b"
TOP_LEVEL = r"[^A-Za-z0-9](com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at)$"
DATE = r"^(?:(?:19|20)[0-9]{2}[\x20./-][01]?[0-9][\x20./-][0-3]?[0-9]|[0-3]?[0-9][\x20./-][0-3]?[0-9][\x20./-](?:19|20)?[0-9]{2}$|[0-9]{1,3}(?:\x20000)+|(?:19|20)[0-9]{2}[\x20/-](?:19|20)[0-9]{2})"
SAMPLES = 8_000  # texts from templates; the bound of what the trees are fitted to and calibrated on
PRECISION = 0.95
#: Templates: # is a digit, & a digit from 2, @@ and $ the check digits of IBAN and card number, ~1 to ~3 words; ! stands before decoys that only their context tells.
WRITTEN = {
    "masked_email": ("~1.~2 at ~3 dot com", "~1 [at] ~3 [dot] org", "~1_~2(at)~3.net", "~1## at ~3.com", "~1 AT ~3 DOT edu", "~1.~2 <at> ~3 <dot> de", "~1 (at) ~2 (dot) ~3 (dot) uk", "~1-~2 @ ~3.org"),
    "local_phone": ("(&##) ###-####", "(0##) ### ## ##", "&##-###-####", "&##.###.####", "&## ### ####", "0## ### ## ##", "030 #### ####", "0#### ### ###", "0&# ## ## ## ##", "0&##/### ## ##"),
    "national_id": ("&##-##-####", "1##-##-####", "&## ## ####"),
    "iban": ("DE@@ #### #### #### #### ##", "ES@@ #### #### #### #### ####", "GB@@ WEST #### #### #### ##", "DE@@##################", "FR@@ #### #### #### #### #### ###", "NL@@ ABNA #### #### ##", "AT@@################"),
    "card_like": ("4###.####.####.###$", "5### #### #### ###$", "4##############$", "3###-######-####$", "5###-####-####-###$"),
}
DECOYS = {
    "masked_email": ("~1 at ~2.~3", "~1 at ~2 dot ~3", "~1 @ ~2.~3", "~1 at ~2.~3.~1", "~1 (at) ~2.~3"),
    "local_phone": ("20##-0&-1#", "19##-0&-2#", "1#.0&.20##", "1#/0&/20##", "2# ### ###", "1## 000 000", "10-20-30", "&#-&#-&#", "978-&-16-####", "20##/20##-1#", "&##.###.###", "19## 20## 20##", "&#.&#.&#", "#### #### ##", "&## &## &##"),
    "national_id": ("!&##-##-####", "000-##-####", "!&## ## ####", "9##-##-####"),
    "iban": ("AB## #### #### ####", "XK##ABCD########", "DE## #### #### #### #### ##", "SN## ABCD #### EFGH ##", "NO##&########&##"),
    "card_like": ("&### #### #### ####", "&###############", "20## 0&1# 20## 0&2#", "&###.####.####.####", "&####-####-####-####", "1#######20######"),
}
NAMES = "anna peter maria john lucas sofia elena omar ingrid paul nadia victor clara hugo martin julia sales info support office".split()
PLACES = "example mailhost acme northwind contoso webpost university museum station market river garden library office harbour".split()
PLAIN = "the of and der die une les que con para nach avec thing house water table under paper light green small".split()
SAYS = {"masked_email": "email|mail|write to|contact|reach me", "local_phone": "phone|tel.|call|mobile:|fax", "national_id": "ssn|social security|id number|national id:", "iban": "iban|account|bank account|transfer to", "card_like": "card|visa|credit card|card number:"}
SAYS_AGAINST = "order|invoice|page|isbn|version|date|score|serial|part no.|ref|total|price|tracking"


@dataclass(frozen=True)
class PiiModel:
    """Trees, and from which log-odds a proposal of each generator is taken."""

    trees: Trees
    least: list[float]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _code(value: Column, i: Column) -> Column:
    return F.ascii(F.substring(value, i, F.lit(1)))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a short string of digits; a valid number's ends in 0."""

    def add(s: Column, i: Column) -> Column:
        d = _code(digits, F.length(digits) - i) - 48
        return s + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def mod_97(value: Column) -> Column:
    """The remainder by 97 of a short string of digits and capital letters (A is 10)."""

    def add(s: Column, i: Column) -> Column:
        c = _code(value, i)
        return F.when(c >= 65, (s * 100 + c - 55) % 97).otherwise((s * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), add)


def _iban_remainder(value: Column) -> Column:
    bare = F.regexp_replace(value, " ", "")
    return mod_97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4))))


def base_spans(text: Column) -> Column:
    """Sorted (start, kind, end) of the fixed patterns in a text that is not null; ``kind`` is the place in KINDS."""
    part = lambda v: F.length(F.regexp_replace(v, "^0+(?=[0-9])", ""))
    octet = lambda v: (part(v) < 3) | ((part(v) == 3) & (F.right(v, F.lit(3)).cast("int") <= 255))
    digits = lambda x: F.length(_digits(x["value"]))
    found = (
        F.when(text.contains("@"), located(text, EMAIL)).otherwise(F.array()),
        F.filter(located(text, IP), lambda x: F.forall(F.split(x["value"], r"\."), octet)),
        F.filter(located(text, CARD), lambda x: luhn_sum(_digits(x["value"])) % 10 == 0),
        F.filter(located(text, PHONE), lambda x: digits(x).between(9, 15)),
    )
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    return F.array_sort(F.concat(*(F.transform(f, span(k)) for k, f in enumerate(found))))


def _features(x: Column, k: int) -> Column:
    """Format and context of a proposal of generator ``k``, as integers."""
    kind = list(GENERATORS)[k]
    value, before = x["value"], F.lower(x["before"])
    digits, flag = _digits(value), lambda c: c.cast("int")
    groups = F.split(F.regexp_replace(value, "^[^A-Za-z0-9]+", ""), "[^A-Za-z0-9]+")
    check = flag(_iban_remainder(value) == 1) if kind == "iban" else flag(luhn_sum(digits) % 10 == 0) if kind == "card_like" else flag(value.rlike(TOP_LEVEL))
    last = F.right(x["before"], F.lit(1))
    return F.array(
        *(F.lit(int(j == k)) for j in range(len(GENERATORS))),
        F.length(digits),
        F.size(groups),
        F.length(F.get(groups, 0)),
        F.length(F.get(groups, F.size(groups) - 1)),
        F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("[^A-Za-z0-9]"), F.lit(0)))),
        check,
        flag(before.rlike(CUES[kind])),
        flag(before.rlike(AGAINST)),
        flag(value.rlike(DATE)),
        flag(value.rlike(r"^\(?0")),
        flag(value.rlike(r"^\(")),
        flag(value.rlike(r"(?i)[\[({<\x20](at|dot|@)[\])}>\x20]")) + flag(value.rlike(r"(?i)[\[({<]\x20?(at|dot|@)")),
        flag(value.rlike("^(000|666|9)") | value.rlike("[- ]0000$")),
        flag(last.rlike(r"[#$€£/=_&]")),
        flag(x["after"].rlike(r"^\x20?(?:%|€|\$|/|=|_|km|kg|mm)")),
    )


def proposals(text: Column, base: Column) -> Column:
    """Sorted (start, kind, end, features) of what the generators propose and no ``base`` span touches."""
    shape = "array<struct<start:int,rank:int,end:int,kind:int,features:array<int>>>"
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind"), _features(x, k).alias("features"))
    made = [F.transform(located(text, p), span(k)).cast(shape) for k, p in enumerate(GENERATORS.values())]
    fixed = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("rank"), x["end"].alias("end"), F.lit(0).alias("kind"), F.array().cast("array<int>").alias("features"))).cast(shape)

    def free(m: Column) -> Column:
        """Those that neither reach back over the furthest end of base spans before them nor forward to the next start."""
        reach = scan(F.transform(m, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(0)), F.greatest, F.lit(0))
        far = F.lit(2**31 - 1)
        ahead = F.reverse(scan(F.transform(F.reverse(m), lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(far)), F.least, far))
        keep = lambda r, a: F.filter(m, lambda x, i: (x["rank"] == 1) & (F.get(r, i) <= x["start"]) & (F.get(a, i) >= x["end"]))
        return let(reach, lambda r: let(ahead, lambda a: keep(r, a)))

    alone = lambda c: F.when(F.size(c) == 0, c).when(F.size(base) == 0, F.array_sort(c)).otherwise(let(F.array_sort(F.concat(c, fixed)), free))
    return let(F.concat(*made), alone)


def _chosen(found: Column, model: PiiModel) -> Column:
    """The proposals above their kind's threshold that no likelier one overlaps (of equals the longer, then the first)."""
    least = F.array(*(F.lit(x) for x in model.least))
    scored = F.filter(
        F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["kind"] + len(BASE)).alias("kind"), score(model.trees, x["features"]).alias("score"))),
        lambda x: x["score"] >= F.get(least, x["kind"] - len(BASE)),
    )
    rank = lambda x: F.struct(x["score"], x["end"] - x["start"], -x["start"], -x["kind"])

    def best(s: Column) -> Column:
        near = lambda i: F.slice(s, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), 2 * NEIGHBOURS + 1)
        beaten = lambda x, i: F.exists(near(i), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & (rank(y) > rank(x)))
        return F.when(F.size(s) < 2, s).otherwise(F.filter(s, lambda x, i: ~beaten(x, i)))

    return F.transform(let(scored, best), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def labelled_samples(spark: SparkSession, samples: int = SAMPLES) -> DataFrame:
    """(id, text, start, end, kind) of texts written from the templates; ``start`` is null for those without personal data."""
    pick = lambda options, salt: F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(options))).cast("int"))
    chance = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(100))
    kinds = list(GENERATORS)
    kind, real = (F.col("id") % len(kinds)).cast("int"), (F.floor(F.col("id") / len(kinds)) % 2) == 0
    by_kind = lambda options: F.coalesce(*(F.when(kind == k, options(name)) for k, name in enumerate(kinds)))
    template = F.when(real, by_kind(lambda k: pick(WRITTEN[k], "real"))).otherwise(by_kind(lambda k: pick(DECOYS[k], "decoy")))
    digits = F.translate(F.sha2(F.concat(F.lit("digits "), F.col("id").cast("string")), 256), "abcdef", "012345")

    def sign(i: Column) -> Column:
        c, d = F.substring("template", i, F.lit(1)), F.substring("digits", i, F.lit(1))
        return F.when(c == "!", "").when(c == "#", d).when(c == "&", F.translate(d, "01", "58")).otherwise(c)

    only_context = F.col("template").startswith("!")
    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length("template")), sign), "")
    for place, words in (("~1", NAMES), ("~2", NAMES[::-1]), ("~3", PLACES)):
        filled = F.when(real, F.replace(filled, F.lit(place), pick(words, place))).otherwise(F.replace(filled, F.lit(place), pick(PLAIN, place)))
    rest = 98 - _iban_remainder(F.replace(F.col("filled"), F.lit("@@"), F.lit("00")))
    checked = F.when(F.col("filled").contains("@@"), F.replace(F.col("filled"), F.lit("@@"), F.lpad(rest.cast("string"), 2, "0")))
    card = F.replace(F.col("filled"), F.lit("$"), ((10 - luhn_sum(F.concat(_digits(F.col("filled")), F.lit("0"))) % 10) % 10).cast("string"))
    value = F.coalesce(checked, F.when(F.col("filled").contains("$"), card), F.col("filled"))
    cue = by_kind(lambda k: pick(SAYS[k].split("|"), "cue"))
    against = pick(SAYS_AGAINST.split("|"), "against")
    said = F.when(real, F.when(chance("says") < 60, cue).when(chance("says") < 66, against).otherwise("")).otherwise(F.when(only_context | (chance("says") < 45), against).when(chance("says") < 55, cue).otherwise(""))
    words = lambda salt: F.concat_ws(" ", *(pick(PLAIN, f"{salt}{n}") for n in range(4)))
    glue = pick((" ", ": ", " is ", " = "), "glue")
    before = F.concat(words("left"), F.lit(" "), F.when(said == "", "").otherwise(F.concat(said, glue)))
    after = F.concat(pick((" ", ". ", ", ", "\n"), "end"), words("right"))
    spark_rows = spark.range(samples).withColumns({"template": template, "digits": digits}).withColumn("filled", filled).withColumns({"value": value, "before": before, "after": after})
    start = F.when(real, F.length("before"))
    return spark_rows.select("id", F.concat("before", "value", "after").alias("text"), start.alias("start"), (start + F.length("value")).alias("end"), kind.alias("kind"))


def train_pii(spark: SparkSession, samples: DataFrame | None = None, precision: float = PRECISION) -> PiiModel:
    """A model of labelled ``samples`` (those of :func:`labelled_samples` by default), of which every other id calibrates.

    Only counts of distinct feature rows come to the driver, no more than the samples hold proposals. A proposal is right
    when it is exactly the labelled span. Without samples nothing is ever taken.
    """
    samples = labelled_samples(spark) if samples is None else samples
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = samples.select("id", "start", "end", "kind", F.explode(proposals(F.col("text"), none)).alias("x"))
    right = (F.col("x.start").eqNullSafe(F.col("start"))) & (F.col("x.end") == F.col("end")) & (F.col("x.kind") == F.col("kind"))
    counted = found.groupBy((F.floor(F.col("id") / 10) % 2).alias("fold"), F.col("x.kind").alias("k"), F.col("x.features").alias("f")).agg(F.count_if(right).alias("pos"), F.count("*").alias("n")).collect()
    ordered = sorted((r["fold"], r["k"], tuple(r["f"]), r["pos"], r["n"]) for r in counted)
    sides = []
    for fold in (0, 1):
        mine = [r for r in ordered if r[0] == fold]
        rows = np.array([r[2] for r in mine], np.int64).reshape(len(mine), len(mine[0][2]) if mine else 0)
        pos, n = (np.array([r[c] for r in mine], np.int64) for c in (3, 4))
        sides.append((rows, np.array([r[1] for r in mine], np.int64), pos, n - pos))
    trees = fit_trees(sides[0][0], *sides[0][2:])
    rows, kinds, pos, neg = sides[1]
    return PiiModel(trees, [max(0.0, x) for x in least_scores(kinds, trees.scores(rows), pos, neg, len(GENERATORS), precision)])  # even odds at least


def find_pii(docs: DataFrame, model: PiiModel, text_col: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``docs`` with two sorted arrays of (start, kind, end): ``base`` of the fixed patterns, ``spans`` of all finds.

    ``kind`` is the place in KINDS; places are code points from 0, the end exclusive. Matches of one kind do not overlap;
    what the trees add touches no base span. Null and empty texts have empty arrays; repeated rows and null ids are like
    any other row; an empty table gives no rows. Columns called like the two outputs are replaced, all others stay.
    """
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    fixed = row.select("row", base_spans(text).alias("base"))
    proposed = fixed.select("row", "base", proposals(text, F.col("base")).alias("found"))
    added = F.when(F.size("found") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", _chosen(F.col("found"), model))))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (base, spans)]
    return proposed.select(*others, F.col("base").alias(base), added.alias(spans))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
