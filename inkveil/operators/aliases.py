"""Other names of organizations, found until no text gives another one, and a recogniser's verdicts on candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.cleaners import clean_organization
from inkveil.functions.noise import is_noise_entity
from inkveil.functions.organizations import explicit_aliases
from inkveil.functions.scans import let
from inkveil.shared import materialize

MOST_ROUNDS = 50
NEAR = 80  # characters on either side of a candidate within which its calibrated form is looked for
LEAST_CALIBRATED = 2
PIECE = 256  # characters, in which a text is cut for its candidates' surroundings to be found at once


def discover_aliases(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, name, parent, depth): the accepted ``names`` (id, name) at depth 0, and the names that texts give to them, to
    those again, and so on; each name once a document, at its least depth, with the least of the names that lead to it.

    Semi-naive: a round looks only for the names of the round before, and only in documents that found any. The names of
    a document are tested within its array, so that a text is not carried once for each of them. Rounds are written to
    shared storage, and only whether one found anything comes to the driver. Empty and null names and texts give nothing.
    """
    fresh = materialize(names.where(F.col("name") != "").select(F.col(id_col).alias("id"), "name").distinct().select("id", "name", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    accepted = fresh
    for depth in range(1, most_rounds + 2):
        if fresh.isEmpty():
            return accepted.withColumnRenamed("id", id_col)
        asked = fresh.groupBy("id").agg(F.collect_set("name").alias("asked"))
        given = F.flatten(F.transform("asked", lambda n: F.transform(explicit_aliases(F.col("text"), n), lambda a: F.struct(clean_organization(a).alias("name"), n.alias("parent")))))
        found = texts.hint("merge").join(asked, "id").select("id", F.explode(F.array_distinct(given)).alias("g")).where(F.col("g.name") != "")
        each = found.groupBy("id", F.col("g.name").alias("name")).agg(F.min("g.parent").alias("parent"))
        fresh = materialize(each.join(accepted.select("id", "name"), ["id", "name"], "left_anti").select("id", "name", "parent", F.lit(depth).alias("depth")))
        accepted = accepted.unionByName(fresh)
    raise RuntimeError(f"names were still found after {most_rounds} rounds")


def _part(pieces: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` on of a text in pieces of PIECE characters, without a walk from its beginning."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((start + F.greatest(size, F.lit(1)) - 1) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, size)


def apply_verdicts(docs: DataFrame, candidates: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Candidates (id, ord, type, text, start, end, source, confidence) after a recogniser's verdicts.

    Verdicts (id, reject: array of texts, calibrate: map of texts to better ones) are one row a document. A candidate whose
    calibrated form of two characters or more stands near it becomes that form, where it stands first; other candidates
    stay unless they are rejected or can be no entity. Documents without verdicts, and null texts, calibrate nothing.
    """
    own = candidates.groupBy(id_col).agg(F.collect_list(F.struct("ord", "type", F.col("text").alias("found"), "start", "end", "source", F.col("confidence").cast("double").alias("confidence"))).alias("cands"))
    judged = own.join(verdicts.select(id_col, "reject", "calibrate"), id_col, "left").join(docs.select(id_col, F.col(text_col).alias("__text")).hint("merge"), id_col, "left")
    text = F.coalesce(F.col("__text"), F.lit(""))

    def one(x, pieces, noise):
        better = F.btrim(F.try_element_at("calibrate", x["found"]), F.lit(" \t\n\r"))
        low = F.greatest(x["start"] - NEAR, F.lit(0))

        def form(better):
            place = F.when(F.length(better) >= LEAST_CALIBRATED, F.instr(_part(pieces, low, x["end"] + NEAR - low), better))
            start = (low + place - 1).cast("int")
            return F.when(place > 0, F.struct(x["ord"].alias("ord"), x["type"].alias("type"), better.alias("found"), start.alias("start"), (start + F.length(better)).alias("end"), F.lit("linear_llm_calibrated").alias("source"), F.lit(0.95).alias("confidence")))

        plain = F.when(~F.coalesce(F.array_contains("reject", x["found"]), F.lit(False)) & ~F.array_contains(noise, x["found"]), x)
        return F.coalesce(let(better, form), plain)

    found = F.array_distinct(F.transform("cands", lambda x: x["found"]))
    each = lambda pieces, noise: F.transform("cands", lambda x: one(x, pieces, noise))
    judgements = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: let(F.filter(found, is_noise_entity), lambda noise: each(pieces, noise)))
    kept = judged.select(id_col, F.inline(F.array_compact(judgements)))
    return kept.withColumnRenamed("found", "text")
