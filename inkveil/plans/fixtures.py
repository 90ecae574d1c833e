"""Small literal tables for operators whose inputs no driver table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L

#: Literal rows that the tests use.
ALIAS_EDGES = [("m1", "a", "b"), ("m1", "b", "c"), ("m1", "d", "e"), ("m2", "a", "d"), ("m2", "x", "y"), ("m2", "y", "z"), ("m2", "z", "w"), ("m2", "w", "v"), ("m3", "k", "k2")]
DIVISION_ROWS = [
    ("130000000000", "河北省", 0), ("130100000000", "石家庄市", 1), ("130102000000", "长安区", 2), ("130102001000", "建北街道", 3), ("130102001001", "棉一社区居委会", 4),
    ("440000000000", "广东省", 5), ("440300000000", "深圳市", 6), ("440300000000", "深圳市（重复）", 7), ("450000000000", "广西壮族自治区", 8),
]


def alias_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIAS_EDGES, "map_id string, a string, b string")


def division_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIVISION_ROWS, "code string, name string, ord int")


#: Parts of names; a row's key picks one of each, so that all of them come together with one another.
SURNAMES = ("张", "欧", "王某", "罗", "李", "安徽", "阿·")
GIVEN = ("三", "建国", "丽", "某", "手", "1", "全", "提", "方", "小明明明", "", "０", "·", *L.NO_PERSON_WORDS, *L.PERSON_WORKS, *L.PERSON_PARTICLES)
CORES = ("华泰", "远大", "张三", "某村", "（北京）华泰", "华泰（北京）", "合同三", "等", "系关联公司", *L.ORG_CORE_PRONOUNS, *L.NO_BRANDS, *L.NO_ORG_CORES, *L.ORG_ACTION_VERBS, *L.ORG_SENTENCE_WORDS)
FRONTS = ("", "大华", "否认其", "长安")
LEGAL_ENDS = ("有限公司", "公司", "", "集团", "集团有限公司", "股份有限公司")
LEADS = ("", "石家庄", "某", *L.PLACE_LEADS)
PLACES = ("长安", "甲", "", "村", "桥东", "社区居民委员会", *L.PLACE_NO_CORES, *L.PLACE_REFERENCES, *L.PLACE_GENERIC, *L.PLACE_NO_STARTS, *L.PLACE_NO_WORDS)
PLACE_ENDS = ("市", "区", "", "村", "村委会", "自治州")
BEFORE = ("", "住", "及", "在", "x")
WRAPS = ("{}", " {}。", "（{}", "{}）", "【{}", "《{}》", "（{}）", "{}及", "{}辩称和", "（（{}", "〈{}")
ORG_WRAPS = (
    "{}", "原告{}", "被告2{}，", "与{}", "曾用名{}", "设立的{}", "到{}", "原{}", "张三与{}", "张三和李四及{}", "（{}", "{}）", "【{}", "名{}", "成立注册{}", "再审申请人：{}", "{}公司", "该{}", "石家庄市{}",
)
ORG_NAMES = ("河北华泰有限公司", "公司", "华泰（北京）科技有限公司", "分公司", "律师事务所", "", "大华银行", "北京集团", "甲乙", "华泰集团有限公司", "石家庄分公司")


def _picked(key: Column, step: int, parts: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, parts)), F.pmod(F.floor(key / step), F.lit(len(parts))).cast("int"))


def _composed(key: Column, *parts: tuple[str, ...]) -> Column:
    steps = [1]
    for p in parts[:-1]:
        steps.append(steps[-1] * len(p))
    return F.concat(*(_picked(key, n, p) for n, p in zip(steps, parts, strict=True)))


def person_names(key: Column) -> Column:
    return _composed(key, SURNAMES, GIVEN)


def organization_names(key: Column) -> Column:
    return _composed(key, FRONTS, CORES, LEGAL_ENDS)


def place_names(key: Column) -> Column:
    return _composed(key, LEADS, PLACES, PLACE_ENDS)


def place_fronts(key: Column) -> Column:
    return _picked(key, 7, BEFORE)


def _wrapped(key: Column, wraps: tuple[str, ...], names: tuple[str, ...]) -> Column:
    return F.replace(_picked(key, 1, wraps), F.lit("{}"), _picked(key, len(wraps), names))


def captured_persons(key: Column) -> Column:
    return _wrapped(key, WRAPS, ("张三", "李及", "王·五", "和", "赵六男女", "（钱七"))


def captured_organizations(key: Column) -> Column:
    return _wrapped(key, ORG_WRAPS, ORG_NAMES)


#: Kind, form of a text and what of it is found ("" if nothing); {} is the identifier, which is made from a key.
IDENTIFIER_FORMS = (
    ("phone", "电话{}。", "电话{}"), ("phone", "a {} b", "{}"), ("phone", "联系电话{}，手机", "联系电话{}"), ("phone", "+86-{}", "+86-{}"), ("phone", "8{}", ""), ("phone", "{}1", ""), ("phone", "😀x{}y", "{}"),
    ("id_number", "公民身份号码{}，", "公民身份号码{}"), ("id_number", "id {}", "{}"), ("id_number", "X{}", ""), ("id_number", "身份证号{}x", ""),
    ("unified_social_credit_code", "统一社会信用代码{}", "统一社会信用代码{}"), ("unified_social_credit_code", "({})", "{}"), ("unified_social_credit_code", "Z{}", ""),
    ("bank_account", "银行账号{} 邮箱", "银行账号{}"), ("bank_account", "账户{}", "账户{}"), ("bank_account", "no {}-", "{}-"), ("bank_account", "{}123456", ""),
    ("email", "邮箱{}。", "邮箱{}"), ("email", "电子邮箱{} x", "电子邮箱{}"), ("email", "<{}>", "{}"),
    ("case_number", "见（2024）冀01民初{}号判决", "（2024）冀01民初{}号"), ("case_number", "(2019)最高法知民终{}号", "(2019)最高法知民终{}号"), ("case_number", "（1999）京执{}", "（1999）京执"), ("case_number", "（3024）冀01民初{}号", ""),
)
PROCEDURES = {"民初": "民初", "知民终": "知民终", "京执": "执"}
LINES = ("审判长  张三", "书记员：李四", "审判员　王五", "正文内容", "法官助理赵六 2024", "  审 判 员 钱七", "审判长在庭上说了很多很多话这一行文字比三十个字还要长所以它不会被当作落款删去", "", "人民陪审员", "执行员·孙八")
DIVISION_CORES = ("石家庄", "长安", "甲", "市辖", "建北", "大名", "内蒙古", "棉一")
DIVISION_ENDS = ("省", "自治区", "特别行政区", "", "市", "自治州", "盟", "地区", "区", "县", "市", "旗", "街道", "镇", "乡", "办", "村", "社区", "村委会", "居委会")


def identifier(kind: Column, key: Column) -> Column:
    """An identifier of a kind, its digits made from a key."""
    digits = lambda n, times: F.lpad(F.pmod(key * times, F.lit(10**n)).cast("string"), n, "0")
    return (
        F.when(kind == "phone", F.concat(F.lit("13"), digits(9, 7919)))
        .when(kind == "id_number", F.concat(F.lit("11010119900307"), digits(3, 7), F.lit("5")))
        .when(kind == "unified_social_credit_code", F.concat(F.lit("91130100MA"), digits(8, 104729)))
        .when(kind == "bank_account", F.concat(F.lit("6222"), digits(15, 1)))
        .when(kind == "email", F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")))
        .otherwise(key.cast("string"))
    )


def identifier_text(key: Column) -> Column:
    kinds, forms, _ = zip(*IDENTIFIER_FORMS, strict=True)
    return F.replace(_picked(key, 1, forms), F.lit("{}"), identifier(_picked(key, 1, kinds), key))


def signed_text(key: Column) -> Column:
    return F.concat_ws("\n", *(_picked(key, step, LINES) for step in (1, 3, 10, 70)))


def divisions(key: Column) -> dict[str, Column]:
    """Code and name of a division, of a level by the key."""
    level, two = key % 5, lambda k: F.lpad(k.cast("string"), 2, "0")
    part = lambda least, value, n: F.when(level >= least, F.lpad(value.cast("string"), n, "0")).otherwise("0" * n)
    code = F.concat(two(F.floor(key / 5) % 3 + 11), part(1, F.floor(key / 15) % 4 + 1, 2), part(2, F.floor(key / 60) % 3 + 1, 2), part(3, F.floor(key / 5) % 4 + 1, 3), part(4, F.floor(key / 10) % 3 + 1, 3))
    name = F.concat(_picked(key, 5, DIVISION_CORES), F.get(F.array(*map(F.lit, DIVISION_ENDS)), (level * 4 + F.floor(key / 40) % 4).cast("int")))
    return {"code": code, "name": name}


def payload(key: Column) -> Column:
    """A recogniser's payload of key mod 5 persons, broken off somewhere."""
    persons = F.when(key % 5 == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(key % 5, F.lit(1))), lambda i: F.concat(F.lit('"p'), i.cast("string"), F.lit('"'))), ", "))
    whole = F.concat(F.lit('note {"persons": ['), persons, F.lit('], "organizations": ["o'), key.cast("string"), F.lit('"]}'))
    return F.substring(whole, F.lit(1), (F.pmod(key * 7, F.length(whole)) + 1).cast("int"))


NAME_STARTS = ("", "原告", "12#", "张三提交", "某人无权代表", "河北", "（", "否认其与", "案涉工程续建由", "甲与")
NAME_BODIES = ("甲乙", "星河建设", "合同一", "综合楼", "二期装修", "长江", "3号", "华夏", "价鉴", "本", "红星", "石家庄市长安区中山东路第一")
NAME_ENDS = ("公司", "工程", "项目", "科技有限公司", "银行", "砖厂", "经营部", "花园", "判决书", "", "系关联公司", "报价单项目", "分行", "有限公司北京分公司")
COMPANIES = ("河北星河建设有限公司", "北京星河科技有限公司", "星河建设公司", "金杜律师事务所", "江苏载道电力工程有限公司", "载道公司", "泽新经销处", "严重违反公司", "广东省人民医院")


def proposed_name(key: Column) -> Column:
    return _composed(key, NAME_STARTS, NAME_BODIES, NAME_ENDS)


def company_text(key: Column) -> Column:
    return F.concat(_picked(key, 1, COMPANIES), F.lit("（以下简称简称甲）与"), _picked(key, 9, COMPANIES), F.lit("签订合同，"), _picked(key, 2, COMPANIES), F.lit("公司不服。"))


ACTIONS = ("keep", "add", "modify", "delete", "other")
SAMPLE_TYPES = ("organization", "person", "location", "manual", "case_number", "grassroots_org", "project")
SAMPLE_NAMES = ("甲乙科技有限公司", "甲", "京", "长安", "石家庄市", "张三", "长江花园小区", "张某甲", "", "王小明", "大桥")
SAMPLE_MASKS = ("甲公司", "张某甲", "甲市", "甲小区", "", "甲工程", "乙集团", "张某", "甲律所")


def sample_rows(key: Column) -> dict[str, Column]:
    """Feedback samples of every action, type, name and mask."""
    tail = F.when(key % 3 == 0, key.cast("string")).otherwise("")
    return {
        "ord": key, "action": _picked(key, 1, ACTIONS), "type": _picked(key, 5, SAMPLE_TYPES), "original": F.concat(_picked(key, 2, SAMPLE_NAMES), tail), "masked": _picked(key, 7, SAMPLE_MASKS),
        "old_original": _picked(key, 11, SAMPLE_NAMES), "new_original": _picked(key, 4, SAMPLE_NAMES), "new_masked": _picked(key, 3, SAMPLE_MASKS),
    }


#: Reports whose number, place of keys and kinds of values change with the key; {k} is the key, {r} another report.
REPORTS = (
    r'{"schema": "v2", "n": {k}, "ok": true}',
    r'{"note": "张三\n住址 {k}", "inner": {r}}',
    r'{"list": ["张三李四", {"original": {k}}, {r}]}',
    r'{"te\u0078t": "x", "origin\u0061l": "y", "inner": [[{r}]]}',
    r'{"privacy": {"sample_entries": "omitted"}, "r": {r}}',
    r'{"privacy": {"sample_entries": ["omitted"]}, "sample_entries": "omitted", "r": {r}}',
    r'{"a": {"leaks": null, "diff": [1, 2.5, {k}]}, "Original": "y", "b": "see /srv/{k}/x"}',
    r'{"filename": "a/{k}.txt", "out_filename": "ok-{k}.txt", "relative_path": "../x", "my_relative_path": "var/{k}", "r": {r}}',
    r'{"relative_path": "in/{k}", "relative_paths": ["/abs"], "win": "C:\\x\\{k}", "msg": "bearer  abc{k}", "r": {r}}',
    r'{"relative_path": "\\\\host\\share", "path": " ~/x", "url": "https://h/{k}", "q": "say \"hi\" /Users/me", "r": {r}}',
    r'{"entities": {}, "token": "t{k}", "one": "张", "two": "ab张三", "far": "龦龧", "e": "", "r": {r}}',
    r'{"body": {"body": {"body": [{"completion": "/opt/x"}, "/opt/y", "x=/opt/{k}"]}}, "s": "secret-token-{k}", "r": {r}}',
    r'["a", {"masked": "b"}]',
    r'{"broken": {k}',
)


def report(key: Column) -> Column:
    """A report of the key, three levels of them in one another."""
    inner = F.lit("{}")
    for step in (len(REPORTS) ** 2, len(REPORTS), 1):
        inner = F.replace(F.replace(_picked(key, step, REPORTS), F.lit("{r}"), inner), F.lit("{k}"), key.cast("string"))
    return inner


def report_sql(key: str) -> str:
    """The same in SQL."""
    listed = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in REPORTS) + "]"
    inner = "'{}'"
    for step in (len(REPORTS) ** 2, len(REPORTS), 1):
        inner = f"replace(replace({listed}[({key} // {step}) % {len(REPORTS)} + 1], '{{r}}', {inner}), '{{k}}', {key}::VARCHAR)"
    return inner


#: Sentences that give names to one another; {a} to {d} are names, {s} a filling of more than 120 characters.
ALIAS_LINES = (
    "{a}（以下简称“{b}”）起诉。{b}，曾用名：{c}，已改制。{c}下称{d}。",
    "{a}（原名 {b}，原系：{c}）。{d}简称为「{a}」。",
    "{a}与丙公司（以下简称{b}）签约。{a}{s}简称{c}。{a}（注）曾用名： {d}。",
    "甲方简称{a}（下称{b}）。{a}；简称{c}。{b}下称{d}",
    "{a}{a}，简称{b}、下称{c}！{c}原为：{a}，原为 {d}；",
    "被告{b}（简称{c}）。{c}下称{d}，{d}原名称：{b}。{a}。",
)
ALIAS_NAMES = (
    ("河北星河建设有限公司", "江苏载道电力工程有限公司", "泽新经销集团"), ("星河", "载道公司", "泽新集团"), ("华泰银行石家庄分行", "远大商业银行", "金杜律师事务所", "红星中学学校"), ("华泰", "远大行", "金杜所"),
)


def _alias_values() -> list[tuple[str, int, tuple[str, ...]]]:
    steps, out = len(ALIAS_LINES), []
    for place, names in zip("abcd", ALIAS_NAMES, strict=True):
        out.append((f"{{{place}}}", steps, names))
        steps *= len(names)
    return [*out, ("{s}", 1, ("，" + "字" * 118,))]


def alias_text(key: Column) -> Column:
    out = _picked(key, 1, ALIAS_LINES)
    for place, step, names in _alias_values():
        out = F.replace(out, F.lit(place), _picked(key, step, names))
    return F.concat(out, F.lit(" "), key.cast("string"))


def alias_name(key: Column) -> Column:
    return _picked(key, len(ALIAS_LINES), ALIAS_NAMES[0])


def alias_sql(key: str) -> tuple[str, str]:
    """The text and the name in SQL."""
    pick = lambda step, names: "[" + ", ".join(f"'{n}'" for n in names) + f"][({key} // {step}) % {len(names)} + 1]"
    out = pick(1, ALIAS_LINES)
    for place, step, names in _alias_values():
        out = f"replace({out}, '{place}', {pick(step, names)})"
    return f"{out} || ' ' || {key}::VARCHAR", pick(len(ALIAS_LINES), ALIAS_NAMES[0])


#: Places as a gazetteer finds them: text, level, full name and code. Some names share a code, some codes a core.
ADMIN_PLACES = (
    ("广东省", "province", "广东省", "44"), ("广东", "province", "广东省", "44"), ("深圳市", "city", "广东省深圳市", "4403"), ("深圳", "city", "广东省深圳市", "4403"), ("南山区", "county", "广东省深圳市南山区", "440305"),
    ("南山", "county", "广东省深圳市南山区", "440305"), ("河北省石家庄市", "city", "河北省石家庄市", "1301"), ("石家庄市长安区建北街道", "township", "建北街道", "130102001"), ("建北街道", "township", "", "130102001"),
    ("辛集市", "county_city", "辛集市", "130181"), ("辛集", "county_city", "", ""), ("棉一社区居委会", "community", "棉一社区居委会", "130102001001"), ("广西壮族自治区", "province", "广西壮族自治区", "45"), ("广西", "province", "广西壮族自治区", "45"),
    ("大理州", "city", "大理白族自治州", "5329"), ("香港特别行政区", "province", "香港特别行政区", "81"), ("西柏坡", "township", "西柏坡镇", "130131"), ("鹿", "county", "", "130110"), ("南山市", "city", "", ""),
    ("河北省石家庄市长安区建北街道棉一社区", "township", "", "1"), ("Ab", "city", "", "7"), ("鼓楼区", "county", "南京市鼓楼区", "320106"), ("鼓楼区", "county", "福州市鼓楼区", "350102"),
)


def admin_candidates(doc: Column, line: Column) -> dict[str, Column]:
    """The candidate of a document's line; places overlap."""
    pick = lambda n: F.get(F.array(*(F.lit(x[n]) for x in ADMIN_PLACES)), F.pmod(doc * 7 + line * (doc % 5 + 1), F.lit(len(ADMIN_PLACES))).cast("int"))
    start = (line * 3 + F.pmod(doc, F.lit(4)) * line).cast("int")
    return {
        "type": F.when((doc + line) % 11 == 0, "grassroots_org").otherwise("location"), "text": pick(0), "start": start, "end": (start + F.length(pick(0))).cast("int"), "level": pick(1), "canonical_name": pick(2), "code": pick(3),
        "source": F.when(doc % 2 == 0, "hebei_admin_db").otherwise("china_admin_db"),
    }
