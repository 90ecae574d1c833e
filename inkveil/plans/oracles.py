"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from inkveil.functions import lexicon as L
from inkveil.functions import noise as N
from inkveil.functions.organizations import ALIAS_PATTERNS
from inkveil.functions.places import SUFFIXES as L_PLACE_SUFFIXES
from inkveil.operators import admin_paths, privacy
from inkveil.plans import fixtures

_EMAIL = r"(?:^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?:[^A-Za-z0-9._%+-]|$)"


def _emails(source: str, key: str, text: str) -> str:
    """RE2 has no lookarounds: characters that may bound two matches are doubled, then consumed."""
    return rf"select {key}, unnest(regexp_extract_all(regexp_replace({text}, '([^A-Za-z0-9._%+@-])', '\1\1', 'g'), '{_EMAIL}', 1)) as value from {source}"


def _banks(source: str, key: str, text: str) -> str:
    """A sentinel before every digit group anchors the matches. Resident ids are not bank accounts."""
    return (
        rf"select {key}, value from (select {key}, trim(replace(unnest(regexp_extract_all(regexp_replace({text}, '([^0-9])([0-9])', '\1' || chr(1) || '\2', 'g'), "
        rf"'(?:^|\x01)((?:[0-9][ -]?\x01?){{16,24}})(?:[^0-9\x01]|$)', 1)), chr(1), '')) as value from {source}) "
        r"where not regexp_matches(regexp_replace(value, '[^0-9]', '', 'g'), '^[0-9]{6}(18|19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{4}$')"
    )


def _counted(rows: str, key: str) -> str:
    return f"select {key}, value, count(*) as n from ({rows}) group by all"


_REPLACED = "replace(replace(replace({0}, 'tion', '[A]'), 'the', '[B]'), 'qu', '[C]')"
_SPANS = "select l_orderkey as doc_id, l_linenumber, (l_suppkey % 40)::INT as s, floor(l_suppkey % 40 + l_quantity)::INT as e, l_returnflag as type, 't' as text, l_linestatus from lineitem"
_RUNS = "select l_returnflag as run, sum(l_quantity::BIGINT)::BIGINT as quantity, count(*) as lines from lineitem group by 1"


def _metrics(rows: str) -> str:
    p, r = "case when tp + fp = 0 then 1.0 else tp::DOUBLE / (tp + fp) end", "case when tp + fn = 0 then 1.0 else tp::DOUBLE / (tp + fn) end"
    return f"select type, tp, fp, fn, round({p}, 6) as precision, round({r}, 6) as recall, round(case when ({p}) + ({r}) = 0 then 0.0 else 2 * ({p}) * ({r}) / (({p}) + ({r})) end, 6) as f1 from ({rows})"


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _pick(key: str, step: int, parts) -> str:
    return f"{_list(parts)}[(({key} // {step}) % {len(parts)})::INT + 1]"


def _compose(key: str, *parts) -> str:
    out, step = [], 1
    for p in parts:
        out.append(_pick(key, step, p))
        step *= len(p)
    return " || ".join(out)


def _wrap(key: str, wraps, names) -> str:
    return f"replace({_pick(key, 1, wraps)}, '{{}}', {_pick(key, len(wraps), names)})"


def _holds(name: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({name}, w))) > 0"


def _begins(name: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: starts_with({name}, w))) > 0"


def _ends(name: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: ends_with({name}, w))) > 0"


def _verb(core: str) -> str:
    """A verb that does not end a longer core as a trade."""
    return (
        f"len(list_filter({_list(L.ORG_ACTION_VERBS)}, lambda v: contains({core}, v) and not (list_contains({_list(L.INDUSTRY_CORE_SUFFIXES)}, v) and ends_with({core}, v) and length({core}) > length(v) + 1))) > 0"
    )


_STRIP = "trim({0}, {1})"
_PERSON_MARKS, _MARKS = "' ：:，,。；;（）()' || chr(10) || chr(9)", "' ：:，,。、；;' || chr(10) || chr(9)"


def _odd_brackets(rows: str) -> str:
    """Bodies of recursive tables b (k, name, s, i): one pair of brackets in each step."""
    left, right = _list("（(【[《<"), _list("）)】]》>")
    a, z = f"{left}[i % 6 + 1]", f"{right}[i % 6 + 1]"
    return (
        f"select k, name, trim(s) as s, 0 as i from ({rows}) union all select k, name, case when starts_with(s, {a}) and not ends_with(s, {z}) then trim(substring(s, 2)) "
        f"when ends_with(s, {z}) and not starts_with(s, {a}) then trim(substring(s, 1, length(s) - 1)) else s end, i + 1 from b where i < 60"
    )


_SURFACE = "(?:" + "|".join(L.ORG_SURFACES) + ")"
_LONG = "(?:有限责任公司|股份有限公司|集团有限公司|有限公司|集团)"
_NARRATED = (
    "case when regexp_matches(s, '^(?:设立的|成立的|注册的|组建的|设立|成立|注册)') then regexp_replace(s, '^(?:设立的|成立的|注册的|组建的|设立|成立|注册)', '') "
    f"when regexp_matches(s, '^到[一-龥A-Za-z0-9()（）·]{{4,}}{_LONG}') then substring(s, 2) when regexp_matches(s, '^原[一-龥]{{4,}}(?:有限责任公司|股份有限公司|集团有限公司|有限公司)') then substring(s, 2) else s end"
)
_JOINED = f"regexp_matches(s, '^[一-龥·]{{2,4}}(?:与|和|及).+$') and not regexp_matches(regexp_extract(s, '^([一-龥·]{{2,4}})(?:与|和|及)(.+)$', 1), '{_SURFACE}') and regexp_matches(regexp_extract(s, '^([一-龥·]{{2,4}})(?:与|和|及)(.+)$', 2), '{_SURFACE}')"

_ROLES = "(?:审判长|审判员|代理审判员|人民陪审员|法官助理|书记员|执行员|执行法官|法 官 助 理|书 记 员|审 判 长|审 判 员)"
_SIGNED = _ROLES + r"[\s\x{3000}：:]*[一-龥·\s\x{3000}]{2,20}$"
_GENERIC = ("省", "市", "区", "县", "镇", "乡", "街道", "社区", "村", "市辖区", "村村民委员会", "村村委会", "社区居民委员会", "社区居委会")

_SQL_ACTION, _SQL_RELATION, _SQL_FALSE = N.ACTION_CLAUSE, N.RELATION_CLAUSE, N.FALSE_CLAUSE

_KEY = "o_orderkey"
_SAMPLES = f"""
        with s as (select {_KEY} as ord, {_pick(_KEY, 1, fixtures.ACTIONS)} as action, {_pick(_KEY, 5, fixtures.SAMPLE_TYPES)} as kind, {_pick(_KEY, 2, fixtures.SAMPLE_NAMES)} || case when {_KEY} % 3 = 0 then {_KEY}::VARCHAR else '' end as original,
          {_pick(_KEY, 7, fixtures.SAMPLE_MASKS)} as masked, {_pick(_KEY, 4, fixtures.SAMPLE_NAMES)} as new_original, {_pick(_KEY, 3, fixtures.SAMPLE_MASKS)} as new_masked from orders),
        n as (select ord, action, kind, case when action = 'modify' then new_original else original end as name, case when action = 'modify' then new_masked else masked end as mask from s),
        a as (select *, name <> '' and mask <> '' and name <> mask and not (length(name) = 1 and contains('京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川贵云藏陕甘青宁新兵', name)) and kind <> 'case_number' as allowed from n)"""

ORACLES: dict[str, str] = {
    "trusted_samples": f"""{_SAMPLES},
        p as (select *, case when action = 'add' and allowed then case
          when regexp_matches(mask, '(?:公司|集团)$') and ((kind = 'organization' and length(name) >= 2) or (length(name) >= 3 and regexp_matches(name, '公司|集团'))) then 'organization'
          when regexp_matches(mask, '(?:省|市|区|县|镇|乡|村|社区|街道)$') and length(name) >= 2 and (kind in ('location', 'grassroots_org') or regexp_matches(name, '(?:省|市|区|县|镇|乡|村|社区|街道|小区)$') or regexp_matches(mask, '(?:小区|村|镇|县|区|市|省)$')) then 'location'
          when kind in ('person', 'manual') and length(name) between 2 and 4 and regexp_matches(mask, '^[一-龥]某[一-龥]?$') then 'person' when length(name) >= 3 and regexp_matches(mask, '(?:小区|项目|工程)$') then 'project' end end as promoted from a),
        u as (select *, row_number() over (partition by name order by ord) as k from p where name <> '' and mask <> '' and name <> mask and (action in ('keep', 'modify') or promoted is not null))
        select ord, case when kind = 'person' and regexp_matches(mask, '(?:公司|集团|律所|事务所|机构|商行|经营部|合作社)$') then 'organization' else coalesce(promoted, kind) end as type, name as original, mask as masked, 'sample_library:' || action as source from u where k = 1""",
    "sample_lookups": f"{_SAMPLES} select name as original, arg_max(mask, ord) as masked from a where allowed and action in ('keep', 'add', 'modify') group by name",
    "false_persons": f"""
        with n as (select o_orderkey, {_compose('o_orderkey', fixtures.SURNAMES, fixtures.GIVEN)} as name from orders)
        select o_orderkey, name, length(name) not between 2 and 20 or regexp_matches(name, '[0-9０-９.%‰万亿元]') or (contains(name, '某') and not ends_with(name, '某')) or (length(name) > 4 and not regexp_matches(name, '[·•]'))
          or {_holds('name', (*L.NO_PERSON_WORDS, *L.PERSON_WORKS, *L.PERSON_PARTICLES))} or (length(name) = 3 and not contains('{L.COMMON_SURNAMES}', name[1]) and contains('{L.PERSON_TAIL_ACTIONS}', name[3]))
          or (length(name) <= 3 and ({_ends('name', L.PERSON_SHORT_ENDS)} or {_begins('name', L.PERSON_SHORT_STARTS)})) or {_begins('name', L.PROVINCE_NAMES)} as is_false from n""",
    "false_organizations": f"""
        with n as (select o_orderkey, {_compose('o_orderkey', fixtures.FRONTS, fixtures.CORES, fixtures.LEGAL_ENDS)} as name from orders),
        c as (select *, regexp_extract(name, '^(.+?)(?:{"|".join(L.LEGAL_SUFFIXES)})$', 1) as core from n),
        g as (select *, regexp_extract(core, '^(.+?)(?:{"|".join(L.NO_BRANDS)})$', 1) as front from c)
        select o_orderkey, name, regexp_matches(name, '^合同[一二三四五六七八九十百零0-9]+$') or contains(name, '系关联公司') or starts_with(name, '否认其') or starts_with(name, '否认与') or list_contains({_list(L.LEGAL_SUFFIXES)}, name)
          or (regexp_matches(name, '[（）()]') and not regexp_matches(name, '^[一-龥A-Za-z0-9·]+[（(][一-龥A-Za-z0-9·]{{2,12}}[）)][一-龥A-Za-z0-9·]*(?:有限责任公司|股份有限公司|集团有限公司|有限公司|公司|集团)$'))
          or {_holds('name', L.ORG_SENTENCE_WORDS)}
          or case when core <> '' then list_contains({_list((*L.ORG_CORE_PRONOUNS, *L.NO_BRANDS, *L.NO_ORG_CORES))}, core) or length(core) < 2 or contains(core, '我') or contains(core, '两家') or ends_with(core, '等') or ends_with(core, '等公司')
            or {_ends('core', ('省', '市', '区', '县', '旗', '镇', '乡', '街道', '村', '社区'))} or (regexp_matches(core, '^[一-龥]{{2,3}}$') and contains('{L.COMMON_SURNAMES}', core[1])) or {_verb('core')}
            or (front <> '' and (length(front) <= 2 or {_verb('front')}))
          else {_holds('name', L.ORG_PRONOUNS)} or {_verb('name')} end as is_false from g""",
    "false_places": f"""
        with n as (select o_orderkey, {_compose('o_orderkey', fixtures.LEADS, fixtures.PLACES, fixtures.PLACE_ENDS)} as name, {_pick('o_orderkey', 7, fixtures.BEFORE)} as before from orders),
        p as (select *, regexp_replace(name, '^(?:{"|".join(L.PLACE_LEADS)})', '') as bare, regexp_replace(name, '(?:自治区|自治州|街道|社区|省|市|盟|区|县|旗|镇|乡|村)$', '') as body from n)
        select o_orderkey, name, before, {_holds('name', L.PLACE_NO_WORDS)} or case when {_ends('bare', ('村民委员会', '居民委员会', '村委会', '居委会'))} then list_contains({_list(('村村民委员会', '村村委会', '社区居民委员会', '社区居委会'))}, bare)
          else list_contains({_list(L.PLACE_NO_CORES)}, name) or list_contains({_list((*L.PLACE_NO_CORES, *L.PLACE_GENERIC))}, bare) or list_contains({_list(L.PLACE_NO_CORES)}, body) or {_begins('name', L.PLACE_REFERENCES)} or {_begins('bare', L.PLACE_REFERENCES)}
            or {_begins('name', L.PLACE_NO_STARTS)} or regexp_matches(bare, '^[一-龥](?:省|自治区|市|自治州|盟|区|县|旗|镇|乡|街道|村|社区)$') or regexp_matches(bare, '^[一-龥]{{2,4}}村村$') or regexp_matches(body, '[{L.PLACE_NO_CHARS}]')
            or len(list_filter({_list(L.PLACE_LEADS)}, lambda w: starts_with(name, w) and length(name) > length(w))) > 0 or (before <> '' and contains('{L.PLACE_BEFORE}', before))
            or (starts_with(name, '某') and {_ends('name', ('省', '市', '区', '县', '镇', '乡', '街道'))}) end as is_false from p""",
    "proposed_names": f"""
        with n as (select o_orderkey, {_compose('o_orderkey', fixtures.NAME_STARTS, fixtures.NAME_BODIES, fixtures.NAME_ENDS)} as name from orders),
        b as (select *, trim(regexp_replace(name, '[　]', ' ', 'g')) as bare, regexp_replace(regexp_replace(name, '{N.CONTRACT}', '', 'g'), '[\\s，,、；;：:的之与和及]', '', 'g') as rest, '(?:有限责任公司|股份有限公司|集团有限公司|有限公司|公司|集团)$' as ends from n),
        e as (select *, bare = '' or regexp_matches(bare, '{N.DOCUMENT_NAME}')
          or (regexp_matches(bare, '(?:有限责任公司|股份有限公司|集团有限公司|有限公司|公司|集团|银行)$') and ((contains(bare, '代表') and not starts_with(bare, '法定代表人') and not starts_with(bare, '诉讼代表人')) or (length(bare) > 12 and regexp_matches(bare, '{N.WRAPPING_WORDS}'))))
          or regexp_matches(bare, '{_SQL_ACTION}') or regexp_matches(bare, '{_SQL_RELATION}') or (regexp_matches(bare, '{N.CONTRACT}') and length(rest) <= 4) or regexp_matches(bare, '{_SQL_FALSE}') as noise_entity from b),
        w as (select *, regexp_extract(bare, '^(?:[一-龥A-Za-z0-9（）()·]{{2,45}}?(?:有限责任公司|股份有限公司|集团有限公司|有限公司|律师事务所|会计师事务所|保险公司|商业银行|幼儿园|公司|集团|银行)(?:[一-龥A-Za-z0-9·]{{1,20}}(?:分行|支行|分公司|营业部))?|[一-龥A-Za-z0-9（）()·]{{4,45}}(?:医院|学校|人民法院|人民检察院|公安局|税务局))') as whole,
          not regexp_matches(bare, '{N.CAPTURE_NOISE}') and length(bare) >= 4 as captured from e)
        select o_orderkey, name, noise_entity,
          length(bare) < 3 or regexp_matches(bare, '{N.PROJECT_PAPER}') or not regexp_matches(bare, '(?:{"|".join(N.PROJECT_ENDS)})$') or regexp_matches(bare, '{N.PROJECT_NUMBER}') or list_contains({_list(N.BARE_PROJECTS)}, bare) or regexp_matches(bare, '{N.GENERIC_PROJECT}') as noise_project,
          not (bare = '' or bare <> trim(bare, ' ：:，,。；;、"“”‘’（）()[]【】') or noise_entity or regexp_matches(bare, '{N.ROLE_START}') or list_contains({_list(N.GENERIC_SURFACES)}, bare) or regexp_matches(bare, '{N.CLAUSE_START}') or regexp_matches(bare, '{N.INVALID_VARIANT}'))
          and case when bare <> '' and whole = bare then captured when regexp_matches(bare, ends) then case when regexp_matches(bare, '[（(]') then captured else length(bare) <= 10 end when regexp_matches(bare, '(?:{"|".join(N.FACTORIES)})$') then length(bare) >= 4
            when regexp_matches(bare, '(?:银行|分行|支行|律所)$') then length(bare) <= 12 when regexp_matches(bare, '(?:{"|".join(N.NAMED_OUTLETS)})$') then length(bare) >= 4 else length(bare) between 2 and 8 end as company_variant from w""",
    "validated_names": f"""
        with d as (select c_custkey as doc_id, {_pick('c_custkey', 1, fixtures.COMPANIES)} || '（以下简称简称甲）与' || {_pick('c_custkey', 9, fixtures.COMPANIES)} || '签订合同，' || {_pick('c_custkey', 2, fixtures.COMPANIES)} || '公司不服。' as text from customer),
        i as (select doc_id, text, unnest(range(0, {len(fixtures.COMPANIES)})) as nth from d), n as (select *, {_list(fixtures.COMPANIES)}[nth + 1] as name from i),
        c as (select doc_id, 'e' || (nth % 4) as entity_id, name, nth, text from n union all select doc_id, 'f' || nth, name, nth, text from n where (doc_id + nth) % 3 = 0),
        p as (select * from c where contains(text, name)),
        q as (select doc_id, name, count(distinct entity_id) > 1 as conflict from p group by all), m as (select doc_id, entity_id, arg_min(name, nth) as primary_name from p group by all)
        select doc_id, entity_id, name, conflict, primary_name from p join q using (doc_id, name) join m using (doc_id, entity_id)""",
    "cleaned_persons": f"""
        with recursive n as (select c_custkey as k, {_wrap('c_custkey', fixtures.WRAPS, ('张三', '李及', '王·五', '和', '赵六男女', '（钱七'))} as name from customer),
        b as ({_odd_brackets(f"select k, name, {_STRIP.format('name', _PERSON_MARKS)} as s from n")})
        select k as c_custkey, name, trim(case when length(s) < 2 then s else s[1] || regexp_replace(substring(s, 2), '[{L.PERSON_TAILS}]+$', '') end) as cleaned from b where i = 60""",
    "cleaned_organizations": f"""
        with recursive n as (select c_custkey as k, {_wrap('c_custkey', fixtures.ORG_WRAPS, fixtures.ORG_NAMES)} as name from customer),
        b as ({_odd_brackets(f"select k, name, trim(name, {_MARKS} || '（）()') as s from n")}),
        d as (select k, name, trim(regexp_replace(s, '(有限责任公司|股份有限公司|集团有限公司|有限公司)公司$', '\\1'), {_MARKS}) as s from b where i = 60),
        e as (select k, name, s, 0 as i, len(string_split(s, '（')) = len(string_split(s, '）')) and len(string_split(s, '(')) = len(string_split(s, ')')) as even from d),
        f as (select k, name, s, 0 as i from e union all select k, name, case when starts_with(s, {_list('（(【[《<')}[i % 6 + 1]) and not ends_with(s, {_list('）)】]》>')}[i % 6 + 1]) then trim(substring(s, 2))
          when ends_with(s, {_list('）)】]》>')}[i % 6 + 1]) and not starts_with(s, {_list('（(【[《<')}[i % 6 + 1]) then trim(substring(s, 1, length(s) - 1)) else s end, i + 1 from f where i < 60),
        g as (select e.k, e.name, case when e.even then e.s else f.s end as s from e join f on e.k = f.k where f.i = 60),
        h as (select k, name, trim(regexp_replace(s, '^(?:{"|".join(L.PARTY_ROLES)})', ''), {_MARKS}) as s from g),
        j as (select k, name, trim(regexp_replace(s, '^(?:{"|".join(L.NAME_JOINTS)})', ''), {_MARKS}) as s from h),
        r as (select k, name, s, 0 as i from j union all select k, name, case when {_NARRATED} <> s then trim({_NARRATED}, {_MARKS})
          when {_JOINED} then trim(regexp_extract(s, '^([一-龥·]{{2,4}})(?:与|和|及)(.+)$', 2), {_MARKS}) else s end, i + 1 from r where i < 12),
        x as (select k, name, s, regexp_replace(s, '(?:{"|".join(sorted(L.ORG_ENDINGS, key=len, reverse=True))})$', '') as core from r where i = 12)
        select k as c_custkey, name, case when core = '' or regexp_matches(core, '^名(?:{"|".join(L.PROVINCE_NAMES)})') or regexp_matches(s, '^[一-龥]{{2,12}}(?:市)?分公司$') or s in ('公司', '该公司', '本公司', '分公司') then '' else s end as cleaned from x""",
    "detect_email": _counted(_emails("documents", "doc_id", "text"), "doc_id"),
    "detect_email_pages": _counted(_emails("pages", "page_id", "html"), "page_id"),
    "detect_bank_account": _counted(_banks("documents", "doc_id", "text"), "doc_id"),
    "detect_bank_account_pages": _counted(_banks("pages", "page_id", "html"), "page_id"),
    "identifier_counts_by_type": f"select type, count(*) as n, count(distinct doc_id) as n_docs from (select 'email' as type, * from ({_emails('documents', 'doc_id', 'text')}) union all select 'bank_account', * from ({_banks('documents', 'doc_id', 'text')})) group by grouping sets ((type), ())",
    "redact_documents": f"""
        with found as (select distinct doc_id, value from (select * from ({_emails('documents', 'doc_id', 'text')}) union all select * from ({_banks('documents', 'doc_id', 'text')}))),
        lists as (select doc_id, list(value order by length(value) desc, value) as vs from found group by doc_id),
        done as (select doc_id, len(vs)::INT as n_mappings, list_reduce(vs, lambda t, v: replace(t, v, '***'), text) as text from lists join documents using (doc_id)),
        left_over as (select doc_id, count(*) as n from ({_banks('done', 'doc_id', 'text')}) where not contains(value, '***') group by doc_id)
        select doc_id, n_mappings, sha256(text) as redacted_sha256, coalesce(n, 0)::INT as n_leaks from done left join left_over using (doc_id)""",
    "redact_apply_longest_first": f"select doc_id, sha256({_REPLACED.format('text')}) as redacted_sha256, length({_REPLACED.format('text')})::BIGINT as redacted_chars from documents",
    "restore_roundtrip": "select doc_id, replace(replace(replace(r, '[A]', 'tion'), '[B]', 'the'), '[C]', 'qu') = text as exact, sha256(replace(replace(replace(r, '[A]', 'tion'), '[B]', 'the'), '[C]', 'qu')) as restored_sha256 "
    f"from (select doc_id, text, {_REPLACED.format('text')} as r from documents)",
    "placeholder_metric": f"select doc_id, masked, n from (select doc_id, masked, ((length(r) - length(replace(r, masked, ''))) // 3)::BIGINT as n from (select doc_id, {_REPLACED.format('text')} as r from documents), (values ('[A]'), ('[B]'), ('[C]')) m(masked)) where n > 0",
    "leak_scan": _counted(_banks("documents", "doc_id", "text"), "doc_id"),
    "html_escape_highlight": "select page_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, 'tion', chr(1)), 'the', chr(2)), 'qu', chr(3)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), "
    "chr(1), '<mark>tion</mark>'), chr(2), '<mark>the</mark>'), chr(3), '<mark>qu</mark>')) as html_sha256 from pages",
    "trace_first_positions": "select page_id, 'qu' as original, len(p)::BIGINT as n, array_to_string(p[1:20], ',') as positions, len(p) > 20 as truncated from (select page_id, list_filter(range(0, length(html)), lambda i: substring(html, i + 1, 2) = 'qu') as p from pages) where len(p) > 0",
    "detect_identifiers": f"""
        with o as (select o_orderkey, {_pick('o_orderkey', 1, [f[0] for f in fixtures.IDENTIFIER_FORMS])} as type, {_pick('o_orderkey', 1, [f[1] for f in fixtures.IDENTIFIER_FORMS])} as form, {_pick('o_orderkey', 1, [f[2] for f in fixtures.IDENTIFIER_FORMS])} as part from orders),
        v as (select *, case type when 'phone' then '13' || lpad(((o_orderkey * 7919) % 1000000000)::VARCHAR, 9, '0') when 'id_number' then '11010119900307' || lpad(((o_orderkey * 7) % 1000)::VARCHAR, 3, '0') || '5'
          when 'unified_social_credit_code' then '91130100MA' || lpad(((o_orderkey * 104729) % 100000000)::VARCHAR, 8, '0') when 'bank_account' then '6222' || lpad(o_orderkey::VARCHAR, 15, '0')
          when 'email' then 'u' || o_orderkey || '@example.com' else o_orderkey::VARCHAR end as value from o),
        t as (select *, replace(form, '{{}}', value) as whole, replace(part, '{{}}', value) as text from v where part <> '')
        select o_orderkey, type, text, (instr(whole, text) - 1)::BIGINT as start, 'high' as risk_level, case when type <> 'case_number' then null {" ".join(f"when contains(part, '{k}') then '{v}'" for k, v in fixtures.PROCEDURES.items())} end as procedure from t""",
    "signature_lines": f"""
        with t as (select o_orderkey, [{", ".join(_pick('o_orderkey', step, fixtures.LINES) for step in (1, 3, 10, 70))}] as lines from orders),
        m as (select *, list_transform(lines, lambda x: regexp_replace(regexp_replace(x, '^[\\s\\x{{3000}}]+', ''), '[\\s\\x{{3000}}]+$', '')) as bare from t),
        k as (select *, len(list_filter(lines, lambda x: regexp_matches(x, '^[\\s\\x{{3000}}]*{_SIGNED}'))) > 0 as signed from m)
        select o_orderkey, array_to_string(case when signed then list_filter(list_zip(lines, bare), lambda z: not (regexp_matches(z[2], '^{_SIGNED}') or (regexp_matches(z[2], '^{_ROLES}') and length(z[2]) < 30))).list_transform(lambda z: z[1]) else lines end, chr(10)) as kept from k""",
    "candidate_dedupe": """
        with r as (select user_id as doc_id, event_id as ord, event_type as type, strftime(ts, '%Y-%m') as text, 's' || (event_id % 3) as source, value as confidence, event_id % 50 = 0 as needs_review from events)
        select doc_id, type, text, arg_max(ord, (confidence, -ord)) as ord, arg_max(source, (confidence, -ord)) as source, max(confidence) as confidence, bool_or(needs_review) as needs_review,
          max(ord)::VARCHAR as last_k, array_to_string(list_sort(list(distinct source)), ',') as provenance from r group by doc_id, type, text""",
    "overlap_resolution": """
        with recursive s as (select l_orderkey as doc_id, l_linenumber * 1000000 + l_suppkey as ord, (l_suppkey % 40)::INT as s, floor(l_suppkey % 40 + l_quantity)::INT as e, l_discount as c,
            row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 40 when 'A' then 20 else 10 end desc, l_discount desc, floor(l_suppkey % 40 + l_quantity)::INT - (l_suppkey % 40) desc, l_linenumber * 1000000 + l_suppkey) as k from lineitem),
        g as (select doc_id, list({'s': s, 'e': e, 'o': ord, 'c': c} order by k) as xs from s group by doc_id),
        f as (select doc_id, 1 as i, xs, xs[1:1] as kept from g union all
            select doc_id, i + 1, xs, case when len(list_filter(kept, lambda y: y.s < xs[i + 1].e and xs[i + 1].s < y.e)) = 0 then list_append(kept, xs[i + 1]) else kept end from f where i < len(xs)),
        d as (select doc_id, unnest(kept) as x from f where i = len(xs))
        select doc_id, x.o as ord, x.s as start, x.e as end, row_number() over (partition by doc_id order by x.s, x.s - x.e, -x.c, x.o) - 1 as rank from d""",
    "span_containment_antijoin": """
        with o as (select doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, 3) = 'hea')) as i from documents)
        select doc_id, 'hea' as original from o group by doc_id having bool_and(i > 0 and substring(text, i, 4) = 'thea')""",
    "dictionary_substring_join": """
        with o as (select doc_id, term, unnest(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, length(term)) = term)) as i from documents, (values ('tionre'), ('ionr'), ('ement'), ('chlla')) t(term) where contains(text, term))
        select doc_id, term, count(*) as n, min(i)::BIGINT as first_start, sum(i)::BIGINT as sum_start from o group by all""",
    "ordinal_masks_per_key": """
        with c as (select *, substring('张王李赵刘', (c_nationkey % 5 + 1)::INT, 1) as surname from customer),
        o as (select *, row_number() over (partition by c_mktsegment, surname order by c_custkey, c_name) as n from c)
        select c_custkey, c_mktsegment, surname || '某' || case when n <= 10 then substring('甲乙丙丁戊己庚辛壬癸', n::INT, 1) else n::VARCHAR end as masked from o""",
    "alias_components": """
        with recursive m as (select distinct c_nationkey as map_id, floor(o_totalprice / 50)::BIGINT as bucket, c_custkey as b from orders join customer on o_custkey = c_custkey),
        e as (select map_id, min(b) over (partition by map_id, bucket) as a, b from m), both_ways as (select map_id, a, b from e union select map_id, b, a from e),
        reach as (select map_id, a as node, a as other from both_ways union select r.map_id, r.node, b.b from reach r join both_ways b on r.map_id = b.map_id and r.other = b.a)
        select map_id, node, min(other) as component from reach group by all""",
    "gold_metrics": _metrics("""
        with e as (select doc_id, lang from labels join documents using (doc_id) where quality = 0), a as (select doc_id, lang from documents where contains(text, '|') and doc_id in (select doc_id from labels)),
        o as (select coalesce(e.lang, a.lang) as type, e.doc_id is not null as isx, a.doc_id is not null as act from e full join a on e.doc_id = a.doc_id)
        select type, count(*) filter (isx and act) as tp, count(*) filter (not isx) as fp, count(*) filter (not act) as fn from o group by grouping sets ((type), ())"""),
    "identity_errors": """
        with g as (select l_orderkey as case_id, 'e' || l_linenumber as entity_id, case when l_suppkey % 4 <> 0 then 'g' || (l_suppkey % 4) end as alias_group, 'm' || (l_partkey % 3) as masked,
          case when l_partkey % 5 <> 0 then ['e' || (l_linenumber % 7 + 1), 'e' || l_linenumber] end as do_not_merge from lineitem)
        select case_id, 'wrong_split' as error, alias_group as what from g where alias_group is not null group by case_id, alias_group having count(distinct masked) > 1
        union all select distinct l.case_id, 'wrong_merge', least(l.entity_id, r.entity_id) || '/' || greatest(l.entity_id, r.entity_id)
        from g l join g r on l.case_id = r.case_id and l.masked = r.masked and l.entity_id <> r.entity_id and list_contains(l.do_not_merge, r.entity_id)""",
    "audit_categories": f"""
        with s as ({_SPANS}), l as (select doc_id, s, e, text, list_sort(list(distinct type)) as k from s where l_linenumber % 3 <> 0 group by all),
        r as (select doc_id, s, e, text, list_sort(list(distinct case when l_linestatus = 'O' then 'N' else type end)) as k from s where l_linenumber % 2 = 0 group by all),
        b as (select coalesce(l.doc_id, r.doc_id) as doc_id, coalesce(l.s, r.s) as s, coalesce(l.e, r.e) as e, l.k as lk, r.k as rk from l full join r on l.doc_id = r.doc_id and l.s = r.s and l.e = r.e and l.text = r.text),
        lo as (select * from b where rk is null), ro as (select * from b where lk is null),
        c as (select case when lk = rk then 'agreed' else 'type_conflict' end as category from b where lk is not null and rk is not null
          union all select case when exists (select 1 from ro where ro.doc_id = lo.doc_id and ro.s < lo.e and lo.s < ro.e) then 'boundary_conflict' else 'detector_only' end from lo
          union all select case when exists (select 1 from lo where ro.doc_id = lo.doc_id and ro.s < lo.e and lo.s < ro.e) then 'boundary_conflict' else 'registry_only' end from ro)
        select t.category, count(c.category) as n from (values ('agreed'), ('type_conflict'), ('boundary_conflict'), ('detector_only'), ('registry_only')) t(category) left join c using (category) group by 1""",
    "length_strata": "select s.stratum, count(d.doc_id) as n from (values ('lt_10k', 0, 10000), ('10k_30k', 10000, 30000), ('30k_60k', 30000, 60000), ('gte_60k', 60000, 1000000000)) s(stratum, lo, hi) left join documents d on d.n_chars >= lo and d.n_chars < hi group by 1",
    "scenario_label_counts": "select label, count(*) as n from (select unnest(list_filter([lang, source, case when n_chars > 5000 then 'long' end], lambda x: x is not null)) as label from documents) group by 1",
    "input_manifest": "select doc_id, substring(sha256(text), 1, 16) as input_id, length(text)::BIGINT as character_count, case when length(text) < 10000 then 'lt_10k' when length(text) < 30000 then '10k_30k' when length(text) < 60000 then '30k_60k' else 'gte_60k' end as length_stratum, sha256(text) as sha256 from documents",
    "size_guard": "select doc_id, length(text)::BIGINT as characters from documents where length(text) > 10000",
    "sample_upsert_latest": "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen_at from events group by user_id",
    "recent_errors_topk": "select event_id, user_id, value from events where event_type = 'error' order by ts desc, event_id desc limit 100",
    "best_group_with_ties": "select user_id, event_type, n from (select *, rank() over (partition by user_id order by n desc) as r from (select user_id, event_type, count(distinct event_id) as n from events group by all)) where r = 1",
    "unique_binding_lookup": "select conv_id, case count(distinct role) when 0 then 'missing' when 1 then 'unique' else 'ambiguous' end as state, case when count(distinct role) = 1 then min(role) end as role from conversations group by 1",
    "timing_ms_with_reason": """
        with s as (select l_orderkey as o_orderkey, case when l_suppkey % 10 <> 0 then l_shipdate - interval 30 days end as done from lineitem where l_linenumber = 1)
        select o_orderkey, case when done is not null and done >= o_orderdate then (epoch_us(done) - epoch_us(o_orderdate)) // 1000 end::BIGINT as ms,
          case when o_orderdate is null or done is null then 'missing' when done < o_orderdate then 'order' end as reason from orders left join s using (o_orderkey)""",
    "benchmark_deltas": f"with r as ({_RUNS}) select c.run, (c.quantity - b.quantity)::BIGINT as delta_quantity, c.lines - b.lines as delta_lines from r c, r b where b.run = 'A' and c.run <> 'A'",
    "benchmark_recommendation": f"with r as ({_RUNS}), d as (select c.run, c.quantity - b.quantity as dq from r c, r b where b.run = 'N' and c.run <> 'N'), f as (select * from d where dq < 0) "
    "select case when count(*) = 0 then 'keep_baseline' else 'switch' end as decision, arg_min(run, (dq, run)) as candidate, min(dq)::BIGINT as best_delta from f",
    "registry_names": """
        with o as (select doc_id, type, name, unnest(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, length(name)) = name)) as i from documents, (values ('person', 'qu'), ('person', 'zzzz'), ('organization', 'tionre')) t(type, name) where contains(text, name))
        select doc_id, type, name, count(*) as n, min(i)::BIGINT as first_start from o group by all""",
    "repaired_payloads": """
        with w as (select o_orderkey, 'note {"persons": [' || case when o_orderkey % 5 = 0 then '' else array_to_string(list_transform(range(1, o_orderkey % 5 + 1), lambda i: '"p' || i || '"'), ', ') end || '], "organizations": ["o' || o_orderkey || '"]}' as whole from orders),
        c as (select o_orderkey, substring(whole, 1, ((o_orderkey * 7) % length(whole) + 1)::INT) as cut from w), n as (select *, length(cut) - length(replace(cut, ',', '')) as commas from c)
        select o_orderkey, (case when contains(cut, ']') then o_orderkey % 5 when commas > 0 then commas end)::BIGINT as n_persons from n""",
    "division_terms": f"""
        with recursive r as (select c_custkey as k, c_custkey % 5 as l, lpad((c_custkey // 5 % 3 + 11)::VARCHAR, 2, '0') as p, lpad((c_custkey // 15 % 4 + 1)::VARCHAR, 2, '0') as c, lpad((c_custkey // 60 % 3 + 1)::VARCHAR, 2, '0') as d,
          lpad((c_custkey // 5 % 4 + 1)::VARCHAR, 3, '0') as t, lpad((c_custkey // 10 % 3 + 1)::VARCHAR, 3, '0') as v, {_pick('c_custkey', 5, fixtures.DIVISION_CORES)} || {_list(fixtures.DIVISION_ENDS)}[(c_custkey % 5 * 4 + c_custkey // 40 % 4 + 1)::INT] as name from customer),
        q as (select *, rpad(p || case when l >= 1 then c else '' end || case when l >= 2 then d else '' end || case when l >= 3 then t else '' end || case when l >= 4 then v else '' end, 12, '0') as code,
          case l when 0 then '' else rpad(p || case when l >= 2 then c else '' end || case when l >= 3 then d else '' end || case when l >= 4 then t else '' end, 12, '0') end as parent from r),
        u as (select *, ['province', 'city', 'county', 'township', 'village'][l + 1] as level from (select *, row_number() over (partition by code order by k) as n from q) where n = 1),
        f as (select code, name, level, l, name as whole from u where parent not in (select code from u) union all select u.code, u.name, u.level, u.l, f.whole || u.name from u join f on u.parent = f.code),
        e as (select case when whole = name or level <> 'township' then whole end as term, code, whole as canonical_name, level, 0.98 as confidence from f union all select name, code, whole, level, 0.92 from f
          union all select regexp_extract(name, case level when 'province' then '^(.{{2,}})(?:省|自治区|特别行政区)$' when 'city' then '^(.{{2,}})市$' else '^(.{{2,}})[区县市旗]$' end, 1), code, whole, level, 0.9 from f where level in ('province', 'city', 'county')),
        b as (select *, row_number() over (partition by term order by confidence desc, code) as n from e where length(term) >= 2 and not list_contains({_list(_GENERIC)}, term))
        select term, code, canonical_name, level, case when level = 'village' or regexp_matches(term, '(?:村民委员会|居民委员会|村委会|居委会)$') then 'grassroots_org' else 'location' end as entity_type, confidence::DOUBLE as confidence from b where n = 1""",
    "top_of_map": """
        with t as (select p_partkey, ['person', 'project', 'location', 'organization'][(p_size % 4 + 1)::INT] as type, p_name as original from part)
        select p_partkey, type, row_number() over (partition by p_partkey % 10 order by case type when 'organization' then 0 when 'location' then 1 when 'person' then 2 when 'project' then 3 end, -length(original), original, p_partkey) as place from t""",
}


def _report_privacy() -> str:
    """Nodes by json_tree; what the fixture's reports cannot hold (file names without a slash, "." alone) is not told apart."""
    keys = lambda names: ", ".join(f"'{n}'" for n in names)
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    remote = " or ".join(f"regexp_matches(t, {quoted(p)})" for p in privacy.REMOTE_VALUES)
    path = r"""case when trim(t) = '' then null when lower(k) like '%filename%' then case when t like '%/%' or contains(t, '\') then 'filename must be basename' end
      when lower(k) like '%relative_path%' then case when starts_with(t, '\\') then 'path must not be remote or network path' when regexp_matches(t, '^([/~]|[A-Za-z]:[\\/])') then 'path must be relative'
      when contains(t, '\') then 'path must use posix separators' when list_contains(string_split(t, '/'), '..') then 'path must not escape case folder'
      when string_split(t, '/')[1] in ('private', 'Users', 'Volumes', 'var') then 'path must not expose local system path' end end"""
    own_path = r"(starts_with(trim(t), '/') or starts_with(trim(t), '~/') or contains(t, ':\') or contains(t, ' /Users/') or contains(trim(t), ' ~/'))"
    chinese = r"'[\x{4e00}-\x{9fff}]{2,}'"
    return f"""
    with r as (select o_orderkey, {fixtures.report_sql('o_orderkey')} as report from orders),
    v as (select o_orderkey, report, json_valid(report) as ok from r),
    n as (select o_orderkey, report, fullkey as p, case when fullkey like '%]' or fullkey = '$' then null else key end as k, case when type = 'VARCHAR' then atom ->> '$' end as t, json_type(report) = 'OBJECT' as whole
      from v, json_tree(case when ok then report else 'null' end) where ok),
    f as (
      select o_orderkey, 'regression' as validator, 'key' as issue, p as detail from n where whole and k in ({keys(privacy.DIAGNOSTIC_KEYS)})
      union all select o_orderkey, 'regression', 'value', p from n where whole and regexp_matches(t, {chinese})
      union all select o_orderkey, 'runtime', 'key', p from n where whole and (k in ({keys(privacy.RUNTIME_KEYS)}) or (k = 'sample_entries' and not (p = '$.privacy.sample_entries' and t is not distinct from 'omitted')))
      union all select o_orderkey, 'runtime', 'value', p from n where whole and (regexp_matches(t, {chinese}) or regexp_matches(t, {quoted(privacy.ABSOLUTE_PATH)}))
      union all select o_orderkey, 'recognition', 'key', p from n where whole and k in ({keys(privacy.RECOGNITION_KEYS)})
      union all select o_orderkey, 'recognition', 'value', p from n where whole and ({own_path})
      union all select o_orderkey, 'remote', 'key', p from n where k in ({keys(privacy.REMOTE_KEYS)})
      union all select o_orderkey, 'remote', 'path', p || ': ' || w from (select *, {path} as w from n where t is not null) where w is not null
      union all select o_orderkey, 'remote', 'value', p from n where {remote}
      union all select o_orderkey, m, 'unreadable', '$' from v, (values ('regression'), ('runtime'), ('recognition'), ('remote')) x(m) where not ok or (m <> 'remote' and json_type(report) <> 'OBJECT'))
    select * from f"""


ORACLES["report_privacy"] = _report_privacy()

ORACLES["trace_coordinates"] = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
n as (select doc_id, line, length(x) as a, length({_REPLACED.format('x')}) as b from l),
e as (select *, sum(a + 1) over w - 1 as a_end, sum(b + 1) over w - 1 as b_end from n window w as (partition by doc_id order by line rows unbounded preceding))
select doc_id, line::BIGINT as line, (a_end - a)::BIGINT as start, a_end::BIGINT as "end", (b_end - b)::BIGINT as new_start, b_end::BIGINT as new_end, true as same from e
"""

#: Lines end as Python's str.splitlines has it.
_LINE_ENDS = "[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
ORACLES["restore_preview"] = f"""
with l as (select doc_id, unnest(regexp_split_to_array(text, '{_LINE_ENDS}')) as x from documents),
c as (select doc_id, count(*) filter (x <> {_REPLACED.format('x')}) as n from l group by doc_id)
select doc_id, true as exact, 3::BIGINT as n_restored_entries, 0::BIGINT as n_skipped_entries, coalesce(n, 0)::BIGINT as n_removed, coalesce(n, 0)::BIGINT as n_added from documents left join c using (doc_id)
"""

ORACLES["restored_word_files"] = f"select doc_id, true as exact, ((length(r) - length(replace(replace(replace(r, '[A]', ''), '[B]', ''), '[C]', ''))) // 3)::BIGINT as n_restored from (select doc_id, {_REPLACED.format('text')} as r from documents)"

ORACLES["redacted_workbooks"] = f"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents),
r as (select doc_id, list_transform(x, lambda t: {_REPLACED.format('t')}) as y, x from l)
select doc_id, case when doc_id % 10 = 0 then 'Sheet1!B2' else '' end as formulas, case when doc_id % 10 = 0 then 0 else len(list_filter(list_zip(x, y), lambda p: p[1] <> p[2])) end::BIGINT as n_cells,
  case when doc_id % 10 <> 0 then sha256(array_to_string(list_filter(y, lambda t: t <> ''), chr(10))) end as text_sha256
from r
"""


def _discovered_aliases() -> str:
    """Mentions by splitting at the name; each one's clause, then the three patterns over it."""
    text, name = fixtures.alias_sql("o_orderkey")
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    given = " || ".join(f"regexp_extract_all(w, {quoted(p)}, 1)" for p in ALIAS_PATTERNS)
    bracket = r"regexp_extract(rest, '^[（(][^）)]*[）)]')"
    clause = r"left(regexp_extract(tail, '^[^。！？；]*'), 120)"
    return f"""
    with recursive o as (select o_orderkey, {text} as text, {name} as name from orders),
    f(o_orderkey, text, name, parent, depth, seen) as (
      select o_orderkey, text, [name], [null::VARCHAR], 0, [name] from o
      union all
      select o_orderkey, text, list_transform(fresh, lambda x: x.alias), list_transform(fresh, lambda x: x.parent), depth + 1, seen || list_transform(fresh, lambda x: x.alias)
      from (
        select o_orderkey, text, depth, seen, list({{'alias': alias, 'parent': parent}} order by alias) as fresh
        from (
          select o_orderkey, text, depth, seen, alias, min(parent) as parent
          from (
            select o_orderkey, text, depth, seen, parent, unnest({given}) as alias
            from (
              select *, bracket || case when regexp_matches(tail, '^[与及和]') then '' else {clause} end as w
              from (
                select *, {bracket} as bracket, substring(rest, length({bracket}) + 1) as tail
                from (
                  select o_orderkey, text, depth, seen, parent, list_reduce(parts[1:i], lambda a, b: a || parent || b) as before, list_reduce(parts[i + 1:], lambda a, b: a || parent || b) as rest
                  from (
                    select o_orderkey, text, depth, seen, parent, parts, unnest(range(1, len(parts))) as i
                    from (select o_orderkey, text, depth, seen, parent, string_split(text, parent) as parts from (select o_orderkey, text, depth, seen, unnest(name) as parent from f))
                  )
                )
              )
              where not regexp_matches(before, '(以下简称|简称为|简称|下称)\\s*$')
            )
          )
          where alias <> parent and alias <> '' and not list_contains(seen, alias)
          group by all
        )
        group by o_orderkey, text, depth, seen
      )
    )
    select o_orderkey, unnest(name) as name, unnest(parent) as parent, depth::BIGINT as depth from f
    """


ORACLES["discovered_aliases"] = _discovered_aliases()

ORACLES["recogniser_verdicts"] = """
with p as (select doc_id, d.text as whole, t.w as text, unnest(list_filter(range(0, length(d.text)), lambda i: substring(d.text, i + 1, length(t.w)) = t.w)) as start from documents d, (values ('tion'), ('the'), ('qu')) t(w)),
v as (select *, doc_id % 4 <> 3 as told, start + length(text) as "end", greatest(start - 80, 0) as low from p),
b as (select *, case when told and text = 'tion' then case when doc_id % 2 = 0 then 'tions' else 'ention' end end as better from v),
i as (select *, instr(substring(whole, (low + 1)::BIGINT, ("end" + 80 - low)::BIGINT), better) as place from b)
select doc_id, start as ord, case when place > 0 then better else text end as text, case when place > 0 then low + place - 1 else start end as start, case when place > 0 then low + place - 1 + length(better) else "end" end as "end",
  case when place > 0 then 'linear_llm_calibrated' else 'rule' end as source, case when place > 0 then 0.95 else 0.5 end::DOUBLE as confidence
from i where place > 0 or not told or not list_contains(case when doc_id % 3 = 0 then ['qu', 'tion'] else ['the'] end, text)
"""


def _admin_path_masks() -> str:
    """Candidates are taken one after the other by recursion; ordinals are ranks of subjects' first places."""
    listed = lambda n: "[" + ", ".join(f"'{x[n]}'" for x in fixtures.ADMIN_PLACES) + "]"
    pick = lambda n: f"{listed(n)}[(l_orderkey * 7 + l_linenumber * (l_orderkey % 5 + 1)) % {len(fixtures.ADMIN_PLACES)} + 1]"
    ends = "[" + ", ".join(f"'{e}'" for e in admin_paths.ENDINGS) + "]"
    ending = lambda c: f"list_filter({ends}, lambda e: ends_with({c}, e))[1]"
    part = [r"(?:[一-龥]+?(?:省|自治区))", r"(?:[一-龥]+?(?:市|自治州))", r"(?:[一-龥]*?[一-龥&&[^社]]区|[一-龥]+?县)", r"(?:[一-龥]+?(?:街道|镇|乡))", r"(?:[一-龥]+?(?:居民委员会|居委会|村民委员会|村委会|社区|村))"]
    part[2] = r"(?:[一-龥]*?[一-礽礿-龥]区|[一-龥]+?县)"  # no 社 before 区
    shape = "^" + "".join(f"({p})?" for p in part) + "$"
    pieces = ", ".join(f"regexp_extract(text, '{shape}', {k})" for k in range(1, 6))
    core = "text_piece"
    for _ in range(3):
        core = rf"case when ends_with({core}, '小镇') then {core} else regexp_replace({core}, '^(.{{2,}}?)({'|'.join(L_PLACE_SUFFIXES)})$', '\1') end"
    kinds = "[" + ", ".join(f"['{a}', '{b}']" for a, b in (("自治区", "自治区"), ("省", "省"), ("自治州", "自治州"), ("市", "市"), ("居民委员会", "社区居民委员会"), ("居委会", "社区居委会"), ("村民委员会", "村民委员会"), ("村委会", "村委会"), ("社区", "社区"), ("区", "区"), ("县", "县"), ("街道", "街道"), ("镇", "镇"), ("乡", "乡"), ("村", "村"))) + "]"
    direct = ", ".join(f"'{x}'" for x in admin_paths.REGIONAL_LEVELS)
    return rf"""
    with recursive c as (select distinct l_orderkey, {pick(0)} as text, l_linenumber * 3 + (l_orderkey % 4) * l_linenumber as start, {pick(1)} as level, {pick(2)} as canonical, {pick(3)} as code, (l_orderkey + l_linenumber) % 11 as other from lineitem),
    a as (select l_orderkey, text, start, start + length(text) as "end", level, canonical, code from c where other <> 0 and case when l_orderkey % 2 = 0 then level in ({direct}) else level in ('province', 'city', 'county', 'county_city') and (level <> 'county' or ends_with(text, '区')) end),
    o as (select *, row_number() over (partition by l_orderkey order by start, "end", text, code) as n from a),
    f(l_orderkey, n, kept) as (
      select distinct l_orderkey, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT, l VARCHAR, n BIGINT)[] from o
      union all
      select o.l_orderkey, o.n, case when len(list_filter(kept, lambda k: k.e > o.start and k.s < o."end" and not (k.l = o.level and o.level in ({direct})))) > 0 then kept else list_append(kept, {{'s': o.start, 'e': o."end", 'l': o.level, 'n': o.n}}) end
      from f join o on o.l_orderkey = f.l_orderkey and o.n = f.n + 1),
    last as (select l_orderkey, arg_max(kept, n) as kept from f group by l_orderkey),
    k as (select o.* from o join (select l_orderkey, unnest(kept).n as n from last) x using (l_orderkey, n)),
    p as (select *, list_filter([{pieces}], lambda x: x <> '') as parts,
      case when ends_with(text, '村民委员会') then '村民委员会' when ends_with(text, '村委会') then '村委会' when ends_with(text, '居民委员会') then '社区居民委员会' when ends_with(text, '居委会') then '社区居委会' when level = 'community' then '社区' when level = 'village' then '村'
        else coalesce({ending('text')}, {ending('canonical')}, case level when 'province' then '省' when 'city' then case when ends_with(canonical, '自治州') then '自治州' else '市' end when 'county_city' then '市' when 'county' then '县' when 'township' then '镇' else '' end) end as suffix from k),
    w as (select *, len(parts) <= 1 and suffix <> '' as whole from p),
    x as (select *, unnest(case when whole then [text] else parts end) as text_piece, generate_subscripts(case when whole then [text] else parts end, 1) as nth from w),
    y as (select *, {core} as core, case when whole and code <> '' then code end as own from x),
    z as (select *, case when own is not null then first_value(core) over (partition by l_orderkey, own order by n, nth) else core end as subject from y),
    r as (select *, dense_rank() over (partition by l_orderkey order by first) as ordinal from (select *, min(n * 10 + nth) over (partition by l_orderkey, subject) as first from z)),
    m as (select *, case when ordinal <= 10 then substring('甲乙丙丁戊己庚辛壬癸', ordinal, 1) else ordinal::VARCHAR end || case when whole then suffix else list_filter({kinds}, lambda q: ends_with(text_piece, q[1]))[1][2] end as shown from r)
    select l_orderkey, start::BIGINT as start, "end"::BIGINT as "end", text as original, string_agg(shown, '' order by nth) as masked, level, code from m group by l_orderkey, n, start, "end", text, level, code
    """


ORACLES["admin_path_masks"] = _admin_path_masks()

ORACLES["sample_store_batches"] = """
select user_id, event_id, event_type, value, strftime(f, '%Y-%m-%d %H:%M:%S') as first_seen_at, strftime(l, '%Y-%m-%d %H:%M:%S') as last_seen_at
from (select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, min(ts) as f, max(ts) as l from events where user_id is not null group by user_id)
where event_type <> 'error'
"""
