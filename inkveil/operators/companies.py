"""Masks of organizations, by which all names of one subject are seen to belong together.

What a name consists of is worked out for all of a document's names in one expression; only the identities, where each
name depends on those accepted before it, are resolved one after the other, document by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions.cleaners import clean_organization
from inkveil.functions.ordinals import STEMS
from inkveil.functions.organizations import explicit_aliases, institution_mask, is_noisy_capture, legal_suffix, simple_legal_suffix
from inkveil.functions.rejects import any_of, is_false_organization

TRUSTED = ("linear_llm", "full_document_llm")
LEAST_VARIANT = 4
_INDUSTRY = any_of(sorted(L.INDUSTRY_TERMS, key=len, reverse=True))
_QUOTE = "[“\"'「『（(]?"
_INSTITUTION = re.compile(any_of(L.INSTITUTION_SUFFIXES) + "$")
_LEGAL = re.compile(any_of(L.LEGAL_SUFFIXES) + "$")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def without_place_notes(name: Column) -> Column:
    """Without bracketed places, and without brackets at the ends."""
    noted = F.regexp_replace(name, f"[（(](?=[一-龥]{{2,8}}[）)])(?:{'|'.join(L.PROVINCE_NAMES)}|[一-龥]{{1,7}}[省市区县镇乡])[）)]", "")
    return F.btrim(noted, F.lit("（）() "))


def industry_of(body: Column) -> Column:
    return F.regexp_extract(body, f"({_INDUSTRY})$", 1)


def brand_of(body: Column) -> Column:
    return F.btrim(F.regexp_replace(body, f"{_INDUSTRY}$", ""), F.lit("（）() "))


def without_leading_place(body: Column) -> Column:
    """Without a province, a city, or two to four characters after which a brand of its own stands."""
    starts = any_of(L.INDUSTRY_STARTS)

    def cut(size: int) -> Column:
        rest = F.substring(body, F.lit(size + 1), F.length(body))
        brand = brand_of(rest)
        fits = (F.length(body) > size + 2) & ~F.substring(body, 1, size).isin(*L.PROVINCE_NAMES) & ~rest.rlike("^" + starts)
        return F.when(fits & F.length(brand).between(2, 8) & ~brand.rlike(starts + "$"), rest)

    province = F.regexp_replace(body, "^" + any_of(L.PROVINCE_NAMES) + "(?=..)", "")
    city = F.regexp_replace(body, "^" + any_of(L.CITY_NAMES) + "(?=..)", "")
    named = F.regexp_replace(body, "^[一-龥]{2,8}(?:市|州|盟)", "")
    place = F.when(province != body, province).when(city != body, city).when(named != body, named)
    return F.when(body.rlike(r"^(?:中国|中华|全国)|\s"), body).otherwise(F.coalesce(place, cut(2), cut(3), cut(4), body))


def _known_places(body: Column, places: Column) -> Column:
    """(mask, rest): known places at the beginning, again and again, the longest first; ``places`` are so ordered."""
    start = F.struct(F.lit("").alias("mask"), body.alias("rest"))

    def step(a: Column, _: Column) -> Column:
        hit = F.get(F.filter(places, lambda p: a["rest"].startswith(p["original"]) & (F.length(a["rest"]) > F.length(p["original"]))), 0)
        return F.when(hit.isNull(), a).otherwise(F.struct(F.concat(a["mask"], hit["masked"]).alias("mask"), F.substring(a["rest"], F.length(hit["original"]) + 1, F.length(a["rest"])).alias("rest")))

    return F.aggregate(F.sequence(F.lit(1), F.length(body) + 1), start, step)


def _masked_institution(value: Column, places: Column) -> Column:
    """With its known places masked, or else as its kind."""
    placed = F.aggregate(places, value, lambda t, p: F.replace(t, p["original"], p["masked"]))
    return F.when(placed != value, placed).otherwise(institution_mask(value))


def analysed(name: Column, source: Column, text: Column, places: Column) -> Column:
    """All that the masks of an organization's name depend on."""
    trusted = F.coalesce(source.startswith(TRUSTED[0]) | source.startswith(TRUSTED[1]), F.lit(False))
    raw = F.btrim(name, F.lit(" ：:，,。；;\n\t"))
    value = _let(clean_organization(raw), lambda v: F.when((v == "") & trusted, raw).otherwise(v))

    def parts(v: Column) -> Column:
        legal = legal_suffix(v)
        known = _known_places(F.substring(v, F.lit(1), F.length(v) - F.length(legal)), places)

        def named(k: Column) -> Column:
            whole = without_place_notes(F.substring(v, F.lit(1), F.length(v) - F.length(legal)))
            keyed = _let(F.regexp_replace(whole, "^" + any_of([p + e for p in L.PROVINCE_NAMES for e in ("省", "")]) + "(?=..)", ""), without_leading_place)
            own = _let(without_place_notes(k["rest"]), lambda body: F.when(k["mask"] == "", without_leading_place(body)).otherwise(body))
            return _let(own, lambda o: F.struct(k["mask"].alias("place"), o.alias("body"), brand_of(o).alias("brand"), brand_of(keyed).alias("key")))

        def shown(b: Column) -> Column:
            brand = b["brand"]
            called = text.contains(brand) & text.rlike("简称|下称")
            short = called & F.regexp_like(text, F.concat(F.lit(rf"(?:以下简称|简称为|简称|下称)\s*{_QUOTE}\s*\Q"), brand, F.lit(r"\E")))
            bare = called & F.regexp_like(text, F.concat(F.lit(rf"(?:以下简称|简称|下称){_QUOTE}\s*\Q"), brand, F.lit(r"\E(?!公司|集团)")))
            doubtful = legal.isin("公司", "集团") & is_false_organization(F.concat(brand, F.lit("公司"))) & ~short & ~bare
            return F.struct(
                v.alias("value"), legal.alias("legal"), simple_legal_suffix(legal).alias("form"), b["place"].alias("place"), industry_of(b["body"]).alias("industry"), brand.alias("brand"), b["key"].alias("key"),
                ((F.length(brand) < 2) | doubtful).alias("unfit"), bare.alias("bare"), F.transform(explicit_aliases(text, v), clean_organization).alias("aliases"),
                (~trusted & (is_false_organization(v) | is_noisy_capture(v))).alias("noise"), (trusted & (F.length(v) >= 2) & ~is_false_organization(F.concat(v, F.lit("公司")))).alias("plain"),
                v.rlike(any_of(L.INSTITUTION_SUFFIXES)).alias("institution"), _masked_institution(v, places).alias("institution_mask"), F.regexp_extract(v, f"({any_of(L.OUTLETS)})$", 1).alias("outlet"),
            )

        return _let(_let(known, named), shown)

    return _let(value, parts)


def _ordinal(n: int) -> str:
    return STEMS[n - 1] if n <= len(STEMS) else str(n)


def _is_short(name: dict, brand: str) -> bool:
    """Little more than the brand."""
    v = name["value"]
    return v in (brand, brand + "公司") or (name["legal"] in ("公司", "集团") and len(v) <= max(len(brand or v) + 2, 8))


def _related(text: str, one: str, other: str) -> bool:
    within = rf"[^。！？\n]{{0,100}}(?:{L.SAME_COMPANY})[^。！？\n]{{0,100}}"
    return any(re.search(re.escape(a) + within + re.escape(b), text) for a, b in ((one, other), (other, one)))


class _Subjects:
    """A document's organizations as far as they are accepted, and their mappings."""

    def __init__(self, text: str):
        self.text, self.count, self.known, self.seen, self.rows = text, 0, set(), set(), []
        self.plans: dict[str, dict] = {}
        self.masks: dict[str, str] = {}
        self.owned: dict[str, dict] = {}

    def add(self, name: dict, original: str, masked: str) -> None:
        if original and original != masked and original not in self.seen:
            self.seen.add(original)
            self.rows.append({"ord": name["ord"], "original": original, "masked": masked, "entity_id": name["entity"]})

    def next(self) -> str:
        self.count += 1
        return _ordinal(self.count)

    def find(self, name: dict) -> dict | None:
        """The accepted company that a name belongs to by the strongest tie; none if there are several."""
        v, ties = name["value"], {}
        for organization, plan in self.plans.items():
            brand = plan["brand"]
            if v in plan["aliases"]:
                tie = 95
            elif v in (brand + "公司", brand):
                tie = 90
            elif name["key"] == brand and _is_short(name, brand):
                tie = 85
            elif len(v) >= LEAST_VARIANT and organization.endswith(v):
                tie = 80
            elif (name["key"] == brand or brand in v) and _related(self.text, organization, v):
                tie = 75
            else:
                continue
            ties.setdefault(tie, []).append(plan)
        best = ties[max(ties)] if ties else []
        return best[0] if len(best) == 1 else None

    def surface(self, name: dict, plan: dict) -> str:
        if not _is_short(name, plan["brand"]):
            return plan["full"]
        return plan["mask"] if name["value"] == plan["brand"] else plan["mask"] + plan["form"]

    def accept(self, name: dict) -> None:
        v, entity = name["value"], name["entity"]
        if not v or v in self.known:
            return
        if entity in self.masks:
            plan = self.owned.get(entity)
            self.known.add(v)
            if plan:
                self.plans[v] = plan
            self.add(name, v, self.surface(name, plan) if plan else self.masks[entity])
        elif name["noise"]:
            return
        elif name["institution"]:
            if name["institution_mask"]:
                self.known.add(v)
                self.add(name, v, name["institution_mask"])
        elif name["outlet"]:
            self.known.add(v)
            self.add(name, v, self.next() + name["outlet"])
        elif not name["legal"]:
            if name["plain"]:
                self.add(name, v, self.next() + ("局" if v.endswith("局") else "机构"))
        elif plan := (None if entity else self.find(name)):
            short = _is_short(name, plan["brand"])
            masked = self.surface(name, plan) if short else name["place"] + plan["mask"] + name["industry"] + name["form"]
            self.known.add(v)
            self.plans[v] = {**plan, "full": masked}
            self.add(name, v, masked)
        elif not name["unfit"]:
            self._begin(name)

    def _begin(self, name: dict) -> None:
        """A company of its own, with what the text calls it besides."""
        v, brand, mask = name["value"], name["brand"], self.next()
        full = name["place"] + mask + name["industry"] + name["form"]
        self.known.add(v)
        self.plans[v] = plan = {"full": full, "brand": brand, "mask": mask, "form": name["form"], "aliases": name["aliases"]}
        if name["entity"]:
            self.masks[name["entity"]], self.owned[name["entity"]] = full, plan
        self.add(name, v, full)
        for alias in name["aliases"]:
            self.add(name, alias, full)
            if len(alias) >= 2 and not _LEGAL.search(alias) and not _INSTITUTION.search(alias) and alias + name["form"] in self.text:
                self.add(name, alias + name["form"], full)
        if name["bare"]:
            self.add(name, brand, mask)
        if brand + "公司" in self.text:
            self.add(name, brand + "公司", mask + "公司")


def mask_organizations(organizations: DataFrame, docs: DataFrame | None = None, locations: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, type, original, masked, entity_id): organizations (id, ord, text, and entity and source if known), and the
    other names that their document gives them, with masks.

    A company is masked as the ordinal of its subject, with its industry and a generic legal form, after the masks of the
    ``locations`` (id, original, masked) that its name begins with; short names have no industry. Subjects are those of the
    recogniser, or else names that belong together by a stated alias, brand, ending or change of name in the text. An
    institution keeps its kind, an outlet its ending. Names that can be none are left out.
    """
    optional = lambda c: F.col(c) if c in organizations.columns else F.lit(None).cast("string")
    own = F.struct("ord", F.col("text").alias("name"), optional("entity").alias("entity"), F.coalesce(optional("source"), F.lit("")).alias("source"))
    grouped = organizations.groupBy(id_col).agg(F.array_sort(F.collect_list(own)).alias("names"))
    if docs is None:
        grouped = grouped.withColumn("__text", F.lit(""))
    else:
        grouped = grouped.join(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).hint("merge"), id_col)
    empty = F.array().cast("array<struct<n:int,original:string,masked:string>>")
    if locations is None:
        grouped = grouped.withColumn("places", empty)
    else:
        places = locations.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.length("original")).alias("n"), "original", "masked"))).alias("places"))
        grouped = grouped.join(places, id_col, "left").withColumn("places", F.coalesce("places", empty))
    parts = F.transform("names", lambda x: F.struct(x["ord"].alias("ord"), x["entity"].alias("entity"), analysed(x["name"], x["source"], F.col("__text"), F.col("places")).alias("p")))
    id_type, order = (organizations.schema[c].dataType.simpleString() for c in (id_col, "ord"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rows = [], []
            for i, (text, names) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                subjects = _Subjects(text)
                for x in names:
                    subjects.accept({"ord": x["ord"], "entity": x["entity"], **x["p"]})
                row += [i] * len(subjects.rows)
                rows += subjects.rows
            columns = [pa.array([r[c] for r in rows], batch_type) for c, batch_type in (("ord", ordinal), ("original", pa.string()), ("masked", pa.string()), ("entity_id", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row, pa.int64())), *columns], names=[id_col, "ord", "original", "masked", "entity_id"])

    ordinal = pa.int64() if order == "bigint" else pa.int32()
    found = grouped.select(id_col, "__text", parts.alias("parts")).mapInArrow(resolve, f"`{id_col}` {id_type}, ord {order}, original string, masked string, entity_id string")
    return found.select(id_col, "ord", F.lit("organization").alias("type"), "original", "masked", "entity_id")
