"""Patterns and constants of structured identifiers. Results depend on every character of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHONE = r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d(?:[-\s]?\d){8}(?!\d)"
ID_NUMBER = r"(?<![0-9Xx])\d{6}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?![0-9Xx])"
CREDIT_CODE = r"(?<![A-Z0-9])[0-9A-Z]{18}(?![A-Z0-9])"
CREDIT_CODE_SHAPE = r"^[159Y][1239][0-9A-HJ-NPQRTUWXY]{16}$"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9._%+-])"
BANK_ACCOUNT = r"(?<!\d)(?:\d[ -]?){16,24}(?!\d)"
CASE_NUMBER = (
    r"[（(][12]\d{3}[）)][一-龥A-Za-z0-9]{1,16}?"
    r"(知民初|知民终|执异|执复|民辖终|民辖初|民辖|民初|民终|民申|民再|行初|行终|行申|刑初|刑终|刑申|刑再|商初|商终|破申|执|民撤|民特|民保|强清|管辖)"
    r"(?:[0-9一二三四五六七八九十百千万]+\s*号)?"
)
LABELS = {
    "phone": ("联系电话", "电话号码", "手机号", "手机", "电话"),
    "id_number": ("公民身份号码", "身份证号码", "身份证号"),
    "unified_social_credit_code": ("统一社会信用代码",),
    "bank_account": ("银行账号", "银行账户", "收款账号", "账号", "账户"),
    "email": ("电子邮箱", "邮箱"),
    "case_number": (),
}
LABEL_REACH = 12
HIGH_RISK = ("id_number", "phone", "bank_account", "address", "unified_social_credit_code", "case_number")
COURT_ROLES = ("审判长", "审判员", "代理审判员", "人民陪审员", "法官助理", "书记员", "执行员", "执行法官", "法 官 助 理", "书 记 员", "审 判 长", "审 判 员")
PROVINCES = "京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川贵云藏陕甘青宁新兵"

#: Detector order; a type's pattern, source, confidence and reason.
DETECTORS = {
    "phone": (PHONE, "regex", 1.0),
    "id_number": (ID_NUMBER, "regex", 1.0),
    "unified_social_credit_code": (CREDIT_CODE, "regex", 1.0),
    "bank_account": (BANK_ACCOUNT, "regex", 0.98),
    "email": (EMAIL, "regex", 1.0),
    "case_number": (CASE_NUMBER, "court_case_number_parser", 1.0),
}


def risk_for(entity_type: Column) -> Column:
    """High for the high-risk types and e-mail addresses, else medium."""
    return F.when(entity_type.isin(*HIGH_RISK, "email"), "high").otherwise("medium")


def map_case_number(number: Column, seed: int = 0) -> Column:
    """A case number with its province abbreviation swapped for another one everywhere in it.

    Which one is a fixed shift of the list, chosen by ``seed``, so equal provinces map equally and different ones
    differently in every document and run. Numbers of the supreme court, and those without a province, stay.
    """
    shift = 1 + seed % (len(PROVINCES) - 1)
    listed = F.split(F.lit(",".join(PROVINCES)), ",")
    first = F.get(F.filter(listed, lambda p: number.contains(p)), 0)  # in the list's order
    swapped = F.replace(number, first, F.translate(first, PROVINCES, PROVINCES[shift:] + PROVINCES[:shift]))
    return F.when(number.rlike("最高法|最高院"), number).otherwise(F.coalesce(swapped, number))


def strip_court_signatures(text: Column) -> Column:
    """Drop signature lines of court personnel, and short lines that begin with a role, if a signature line occurs."""
    roles = "|".join(COURT_ROLES)
    signature = rf"(?U)^\s*(?:{roles})[\s：:]*[一-龥·\s]{{2,20}}$"  # white space of any kind, the ideographic one included
    lines = F.split(text, "\n")
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    begins = lambda x: F.regexp_like(bare(x), F.lit(rf"^(?:{roles})")) & (F.length(bare(x)) < 30)
    kept = F.filter(lines, lambda x: ~(F.regexp_like(bare(x), F.lit(signature)) | begins(x)))
    return F.when(F.exists(lines, lambda x: F.regexp_like(x, F.lit(signature))), F.array_join(kept, "\n")).otherwise(text)
