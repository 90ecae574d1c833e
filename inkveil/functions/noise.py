"""Tests and repairs of names that a recogniser proposes: clauses, documents and figures taken for names. Fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions.cleaners import clean_organization
from inkveil.functions.rejects import any_of

COMPANY_ENDS = ("有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "公司", "集团")
CONTRACT = r"合同[一二三四五六七八九十百零\d]+"
FALSE_CLAUSE = r"^否认其与[^。！？\n，,、；;]{2,24}系关联公司$"
ACTION_CLAUSE = r"(?:否认|称|辩称|主张|认为|发送|出具|提交|告知|通知|转账|汇款|付款|支付|联系)[^。！？\n，,、；;]{0,24}(?:公司|集团|银行|分行|支行|律所)$"
RELATION_CLAUSE = r"^[一-龥]{2,6}(?:系|为|以|代表)[^。！？\n，,、；;]{2,16}(?:公司|集团|银行|分行|支行|律所)$"
INVALID_VARIANT = r"^[我你他她其该此甲乙丙丁戊己庚辛壬癸][与和及向对给由从被把将]|\d{4}年|以下简称|下称|简称|原名称|曾用名|否认其"
DOCUMENT_NAME = (
    r"^\d{1,4}(?:号|#)?(?:补)?(?:鉴定意见书|判决书|裁定书|调解书|起诉状|申请书|通知书)$"
    r"|^[一-龥]{2,16}(?:价鉴|鉴定|评估|审计|检验|检测|勘验)字$|^\d{1,4}\s*#\s*[一-龥A-Za-z0-9]{1,20}(?:项目|工程|地块)$"
)
WRAPPING_WORDS = "一审法院|二审法院|人民法院|上诉人|被上诉人|案外人|原告|被告|第三人|答辩人|驳回|起诉|诉请|未厘清|仍然认|如果其|并未|代表|提交|告知|申请|发送|原名|被指|认为|主张|银行"
ROLE_START = r"^(?:再审申请人|申请执行人|被申请人|被执行人|被上诉人|上诉人|申请人|被告|原告|第三人|案外人|答辩人)[一二三四五六七八九十\d]*[：:、，,\s]*"
BANK_OR_FIRM = ("银行", "分行", "支行", "律所")
NAMED_OUTLETS = ("经营部", "安装部", "安装队", "经销处", "合作社", "商行", "工作室")
FACTORIES = ("制品厂", "加工厂", "制造厂", "修理厂", "砖厂", "石料厂", "砂石厂", "家具厂", "服装厂", "食品厂", "木器厂", "铸造厂", "机械厂", "电器厂", "电子厂", "化工厂")
PROJECT_ENDS = ("风电场", "小区", "花园", "华府", "澜庭", "蓝庭", "公寓", "广场", "大厦", "产业园", "商业综合体", "小镇", "标段", "项目", "工程")
PROJECT_PAPER = "合同|清单|报价单|报价|总款|价款|款项|费用|辅料费|采购单|发票|收据"
PROJECT_NUMBER = r"^\d{1,4}\s*#\s*[一-龥A-Za-z0-9]{1,20}(?:项目|工程|地块)$"
GENERIC_PROJECT = (
    r"^(?:办公大厅|大厅|会议室|机房|楼面|整体|全部|一期|二期|三期|[一二三四五六七八九十\d]+期)?"
    "(?:整体)?(?:装饰|装修|施工|承包|安装|采购|开孔|空调|商厨|改造|维修|装潢|水电|消防|弱电|土建|机电|幕墙|门窗|楼面|大厅|会议室|机房)*(?:工程|施工|项目)$"
)
BARE_PROJECTS = ("建设工程", "工程", "项目", "施工工程", "装修工程", "装饰工程", "安装工程", "整体工程")
GENERIC_SURFACES = ("本工程", "本项目", "该工程", "该项目")
WRAPPERS = " \t\r\n：:，,。；;、\"'“”‘’（）()[]【】"
NARRATIVE_START, CLAUSE_START = "^(?:所属|按照|根据|由|与|和|及|对|向)", "^(?:本院委托|案涉工程续建由)"
CAPTURE_NOISE = "以下简称|下称|简称|原名称|曾用名|否认其|合同"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_clause_around_organization(text: Column) -> Column:
    """A clause that ends with an organization, taken for its name."""
    ends = text.rlike(any_of((*COMPANY_ENDS, "银行")) + "$")
    stands_for = text.contains("代表") & ~text.startswith("法定代表人") & ~text.startswith("诉讼代表人")
    return ends & (stands_for | ((F.length(text) > 12) & text.rlike(WRAPPING_WORDS)))


def is_noise_entity(text: Column) -> Column:
    """Nothing, a document's or a project's number, a clause, or a contract with little else."""
    bare = _strip(text)
    left = F.regexp_replace(F.regexp_replace(bare, CONTRACT, ""), r"[\s，,、；;：:的之与和及]", "")
    return (
        (bare == "") | bare.rlike(DOCUMENT_NAME) | is_clause_around_organization(bare) | bare.rlike(ACTION_CLAUSE) | bare.rlike(RELATION_CLAUSE)
        | (bare.rlike(CONTRACT) & (F.length(left) <= 4)) | bare.rlike(FALSE_CLAUSE)
    )


def is_noise_project(text: Column) -> Column:
    """Too short, a paper, without a project's ending, a number, or work in general."""
    bare = F.btrim(text, F.lit(" ：:，,。；;\n\t"))
    return (F.length(bare) < 3) | bare.rlike(PROJECT_PAPER) | ~bare.rlike(any_of(PROJECT_ENDS) + "$") | bare.rlike(PROJECT_NUMBER) | bare.isin(*BARE_PROJECTS) | bare.rlike(GENERIC_PROJECT)


def unwrapped(text: Column) -> Column:
    """Without marks around it; brackets within stay."""
    return F.btrim(text, F.lit(WRAPPERS))


def complete_organization(text: Column) -> Column:
    """The last whole organization name of a text or of a part of it that a bracket begins; empty if none."""
    parts = F.concat(F.array(text), F.split(text, "[（(]"))
    names = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(L.ORGANIZATION), F.lit(0))))
    cleaned = F.filter(F.transform(names, clean_organization), lambda n: n != "")
    return F.when(F.size(cleaned) > 0, F.element_at(cleaned, -1)).otherwise("")


def recognised_surface(text: Column) -> Column:
    """The organization in what a recogniser proposed: its last whole name, else the text without what leads to it."""
    bare = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(unwrapped(text), NARRATIVE_START, "")), CLAUSE_START, ""))
    tail = complete_organization(bare)
    return F.when(tail != "", tail).otherwise(bare)


def is_company_variant(text: Column) -> Column:
    """Whether a text can be one of the names of an organization."""
    bare = _strip(text)
    captured = ~bare.rlike(CAPTURE_NOISE) & (F.length(bare) >= 4)
    shape = (
        F.when((bare != "") & (F.regexp_extract(bare, L.ORGANIZATION, 0) == bare), captured)
        .when(bare.rlike(any_of(COMPANY_ENDS) + "$"), F.when(bare.rlike("[（(]"), captured).otherwise(F.length(bare) <= 10))
        .when(bare.rlike(any_of(FACTORIES) + "$"), F.length(bare) >= 4)
        .when(bare.rlike(any_of(BANK_OR_FIRM) + "$"), F.length(bare) <= 12)
        .when(bare.rlike(any_of(NAMED_OUTLETS) + "$"), F.length(bare) >= 4)
        .otherwise(F.length(bare).between(2, 8))
    )
    odd = (bare == "") | (bare != unwrapped(bare)) | is_noise_entity(bare) | bare.rlike(ROLE_START) | bare.isin(*GENERIC_SURFACES) | bare.rlike(CLAUSE_START) | bare.rlike(INVALID_VARIANT)
    return ~odd & shape
