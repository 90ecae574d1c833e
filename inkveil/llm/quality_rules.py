"""Quality rules with host-level verdicts, in DataFrame functions alone.

Every document is held against the base rules. The failures are summed by host, each host's failure rate is shrunk
towards the others' by a beta prior fitted to the rates themselves, and a host whose shrunken rate stays above the limit
with confidence loses its remaining documents too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.storage import materialize

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
MOST_HOST_RATE = 0.5
DEVIATIONS = 2.0
BROADCAST_HOSTS = 200_000
SALTS = 32
_WHITE = "[ \\t\\n\\x0B\\f\\r]"


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, _WHITE + "+"), lambda w: w != "")


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the word hashes of one text.

    Windows are sorted by (hash, place); those equal to a neighbour are repeated. Going through the repeated places in
    order, each covers as many words as lie before the next place, a window's length at most.
    """
    n = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    places = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        same = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(r: Column) -> Column:
        return F.aggregate(r, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(i - a["at"], F.lit(WINDOW))).alias("n"), i.alias("at")), lambda a: a["n"])

    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)  # noqa: E731  evaluates ``value`` once
    heavy = let(places, lambda s: let(marked(s), covered))
    return F.when(n < 2, F.lit(0).cast("bigint")).when(F.size(F.array_distinct(windows)) == n, F.lit(0).cast("bigint")).otherwise(heavy)


def rule_columns(text: Column) -> dict[str, Column]:
    """The measures that do not need the word list's hashes, from a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return {
        "word_chars": F.length(F.regexp_replace(text, _WHITE + "+", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    }


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: tuple[str, ...] = (), most_host_rate: float = MOST_HOST_RATE
) -> DataFrame:
    """One row per document: id, ``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows count as often as they come; null ids are kept; documents
    without a host form one host of their own; an empty table gives no rows. Input columns are only read by name, and the
    ``carry`` ones come back as they are: they must not bear the name of an output.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), F.col(host_col).cast("string").alias("__host"), *(F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)), text.alias("__text"))
    hashed = base.withColumn("__hashes", F.transform(word_list(F.col("__text")), lambda w: F.xxhash64(w)))
    measured = hashed.select(
        "__id",
        "__host",
        *(f"__carry_{i}" for i in range(len(carry))),
        F.size("__hashes").cast("bigint").alias("n_words"),
        *(c.alias(name) for name, c in rule_columns(F.col("__text")).items()),
        _repeated_words(F.col("__hashes")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = materialize(measured.withColumn("base_failed", failed))
    judged = with_host_verdicts(rows, "__host", "base_failed", most_host_rate)
    return judged.select(
        F.col("__id").alias(id_col),
        *(F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("__host_rejected")).alias("kept"),
    )


def host_rates(rows: DataFrame, host_col: str, failed_col: str) -> DataFrame:
    """(host, n, failures, rate): each host's failure rate shrunk by a beta prior fitted by moments to all hosts' rates."""
    hosts = rows.groupBy(host_col).agg(F.count("*").alias("n"), F.count_if(failed_col).alias("failures"))
    raw = F.col("failures") / F.col("n")
    seen = hosts.agg(F.count("*").alias("hosts"), (F.sum("failures") / F.sum("n")).alias("mean"), F.var_pop(raw).alias("spread"), F.avg(1 / F.col("n")).alias("inverse")).first()
    if not seen["hosts"]:
        alpha = beta = 1.0
    else:
        mean = min(max(seen["mean"], 1e-4), 1 - 1e-4)
        between = max(seen["spread"] - mean * (1 - mean) * seen["inverse"], 1e-6)  # without the noise of counting
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
        alpha, beta = mean * strength, (1 - mean) * strength
    a, b = F.lit(alpha) + F.col("failures"), F.lit(beta) + F.col("n") - F.col("failures")
    total = a + b
    return hosts.withColumns({"rate": a / total, "deviation": F.sqrt(a * b / (total * total * (total + 1)))})


def with_host_verdicts(rows: DataFrame, host_col: str, failed_col: str, most_rate: float) -> DataFrame:
    """``rows`` with ``__host_rejected``. Few hosts are rejected; while they are below a checked number their names are
    broadcast, beyond it they are joined on (host, salt), so that one host's documents never meet in one task."""
    rejected = materialize(host_rates(rows, host_col, failed_col).where(F.col("rate") - DEVIATIONS * F.col("deviation") > most_rate).select(F.col(host_col).alias("__bad")))
    if rejected.count() <= BROADCAST_HOSTS:
        marked = rejected.withColumn("__hit", F.lit(True))
        return rows.join(F.broadcast(marked), F.col(host_col).eqNullSafe(F.col("__bad")), "left").withColumn("__host_rejected", F.coalesce("__hit", F.lit(False)))
    spread = rejected.withColumns({"__hit": F.lit(True), "__salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    salted = rows.withColumn("__salted", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    on = F.col(host_col).eqNullSafe(F.col("__bad")) & (F.col("__salted") == F.col("__salt"))
    return salted.join(spread, on, "left").withColumn("__host_rejected", F.coalesce("__hit", F.lit(False)))
