"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
CJK = "一-鿿"

#: Relation types: name, keywords of which two must occur, base score.
RELATION_TYPES = [
    ("资金往来", ["转账", "汇款", "支付", "收款", "金额", "万元", "元", "资金"], 0.8),
    ("雇佣关系", ["任职", "担任", "员工", "经理", "董事", "法定代表人", "负责人", "股东"], 0.85),
    ("亲属关系", ["配偶", "子女", "父母", "兄弟", "姐妹", "夫妻", "父子", "母女"], 0.9),
    ("通话记录", ["通话", "电话", "联系", "拨打", "接听", "主叫", "被叫"], 0.75),
    ("证据链", ["证明", "证实", "佐证", "印证", "相符", "吻合"], 0.7),
    ("时间关联", ["同时", "之后", "之前", "当天", "同日", "次日"], 0.65),
    ("地点关联", ["位于", "地址", "住所", "经营地", "注册地"], 0.7),
    ("合同关系", ["合同", "协议", "签署", "甲方", "乙方", "签订"], 0.8),
    ("共犯关系", ["伙同", "共谋", "指使", "授意", "参与", "协助"], 0.85),
    ("受害人关系", ["被害人", "受害者", "受害人", "侵害", "骗取"], 0.8),
]
MONEY = r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:万|亿)?\s*(?:元|美元|人民币)"

#: Document types: name, keywords of which two must occur; the first that fits counts.
DOCUMENT_TYPES = [
    ("起诉书", ["起诉书", "公诉", "指控", "被告人"]),
    ("判决书", ["判决书", "判决如下", "裁定如下", "本院认为"]),
    ("裁定书", ["裁定书", "裁定"]),
    ("证人证言", ["证人", "证言", "证明", "作证"]),
    ("讯问笔录", ["讯问", "笔录", "问:", "答:", "犯罪嫌疑人"]),
    ("鉴定报告", ["鉴定", "鉴定意见", "检验", "司法鉴定"]),
    ("银行流水", ["银行", "流水", "账户", "交易记录", "转账"]),
    ("合同协议", ["合同", "协议", "甲方", "乙方"]),
]
LEGAL_REFERENCES = [r"《([^》]+)》\s*第\s*(\d+)\s*条", r"第\s*(\d+)\s*条\s*之", r"刑法\s*第\s*(\d+)\s*条", r"刑事诉讼法\s*第\s*(\d+)\s*条"]
KEY_NUMBERS = [MONEY, r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*笔", r"共计?\s*(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:元|万|亿)"]

DAY = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]"
ANY_DAY = r"(\d{4})[年\-./](\d{1,2})[月\-./](\d{1,2})"
MONTH = r"(\d{4})\s*年\s*(\d{1,2})\s*月"
MERGE_DATES = [DAY, ANY_DAY, MONTH]
TIMELINE_DATES = [
    DAY,
    ANY_DAY,
    r"(\d{4})\s*年(?!.{0,6}(?:出生|[诞產]生|[出诞]生于))[\s\S]{0,6}?(\d{1,2})\s*月",
    r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})",
    r"(20\d{2})\.(\d{1,2})\.(\d{1,2})",
]
#: Relative dates: pattern and days a unit; tried in this order.
RELATIVE_DATES = [(r"(\d+)\s*天\s*[后前]", 1), (r"(\d+)\s*[个]?\s*月\s*[后前]", 30), (r"(\d+)\s*[个]?\s*[周年]\s*[后前]", 365)]

#: Spellings of entity types and the standard type that each stands for.
ENTITY_TYPES = {
    "人物": "person",
    "人": "person",
    "嫌疑人": "person",
    "证人": "person",
    "被告人": "person",
    "被害人": "person",
    "受害者": "person",
    "个人": "person",
    "犯罪嫌疑人": "person",
    "罪犯": "person",
    "当事人": "person",
    "组织": "organization",
    "机构": "organization",
    "公司": "organization",
    "单位": "organization",
    "公安机关": "organization",
    "检察院": "organization",
    "法院": "organization",
    "派出所": "organization",
    "分局": "organization",
    "政府": "organization",
    "企业": "organization",
    "部门": "organization",
    "地点": "location",
    "位置": "location",
    "地址": "location",
    "地": "location",
    "省": "location",
    "市": "location",
    "事件": "event",
    "案件": "event",
    "活动": "event",
    "物品": "object",
    "证据": "evidence",
    "文件": "document",
    "概念": "concept",
    "person": "person",
    "people": "person",
    "organization": "organization",
    "org": "organization",
    "company": "organization",
    "location": "location",
    "place": "location",
    "address": "location",
    "event": "event",
    "incident": "event",
    "object": "object",
    "evidence": "evidence",
    "document": "document",
    "concept": "concept",
}
ORGANIZATION_MARKS = ["公安局", "法院", "检察院", "派出所", "分局", "支队", "总队", "政府", "委员会", "公司", "集团", "银行", "医院", "学校", "大队", "中队", "看守所", "监狱"]
PLACE_MARKS = ["省", "市", "区", "县", "镇", "乡", "村", "路", "街", "巷", "号", "小区", "广场"]
STREET_MARKS = ["路", "街", "巷", "号", "小区", "广场"]

COMPARABLE_ATTRIBUTES = ["age", "gender", "sex", "name", "id_number", "amount", "date", "time", "location", "address", "role", "title", "position", "status", "result", "conclusion", "verdict"]

TABLE_TOTALS = ["统计", "排名", "最多", "最少", "占比", "分组", "排行"]
COMPLEX_WORDS = ["证据", "分析", "责任", "法律", "判决", "犯罪", "案件", "关键", "核心", "矛盾", "疑点", "争议", "定性", "定罪", "量刑", "依据", "充分", "链条"]
MEDIUM_WORDS = ["关系", "关联", "如何", "为什么", "原因", "经过", "摘要", "概述", "过程", "情况", "背景", "影响", "演变", "发展", "联系", "区别"]
#: Question types, tried in this order; a question of the first kind is complex if it asks for totals.
TABLE_WORDS = ["表格", "表里", "表中的", "数据表", "Excel", "excel", "统计表"]
TOTAL_WORDS = ["统计", "排名", "最多", "最少", "平均", "占比", "总计", "分组", "排行", "TOP", "top", "求和", "数量", "多少个", "几种", "各类"]
QUESTION_TYPES = [
    ("comparative", ["对比", "比较", "矛盾", "不一致", "差异", "不同"]),
    ("evidential", ["证据", "证明", "证据链", "物证", "书证"]),
    ("analytical", ["为什么", "动机", "原因", "目的", "起因", "缘由"]),
    ("temporal", ["什么时候", "时间", "时间线", "先后", "经过", "日程"]),
    ("relational", ["关系", "关联", "联系", "之间"]),
]
#: Lines that begin a chapter.
CHAPTER_LINES = [
    r"^第[一二三四五六七八九十百千万\d]+\s*[章节回卷集篇幕]",
    r"^#\s*第.+$",
    r"^(?i:Chapter)\s+\d+",
    r"^卷[一二三四五六七八九十百千万\d]+",
]
#: Lines that begin a volume.
VOLUME_LINES = [
    r"^第[一二三四五六七八九十百千万\d]+\s*卷",
    r"^卷[一二三四五六七八九十百千万\d]+$",
]
#: Further words of a question that make it complex or of medium complexity, where its type does not decide.
INTENT_COMPLEX = ["综合", "全面", "所有", "全部", "完整", "深度", "详细分析", "为什么", "动机", "原因", "证据链", "矛盾"]
INTENT_MEDIUM = ["关系", "关联", "对比", "经过", "时间线"]
#: Words that are no names in questions.
QUESTION_STOPWORDS = ["什么", "怎么", "为什么", "如何", "哪里", "那个", "这个", "哪些", "怎样", "多少", "几个", "是否", "能否", "可以"]
CONJUNCTIONS = ["和", "与", "同", "及", "、"]
CONJUNCT_STOPWORDS = ["案件", "证据", "关系", "问题", "动机", "原因"]
TIME_EXPRESSION = r"\d{4}年|\d{1,2}月\d{1,2}日|\d{1,2}[月日]|\d{4}[/-]\d{1,2}"

#: Characters and words that full-text words leave out.
SEARCH_PARTICLES = "的了是在和与或就着过们这那个一不也有会被从到把给向让"
SEARCH_STOPWORDS = [
    "什么", "怎么", "为什么", "如何", "哪里", "哪个", "这个", "那些",
    "怎样", "多少", "几个", "是否", "能否", "可以", "还是", "一个",
    "一些", "起来", "出来", "下去", "过来", "回来",
    "关于", "对于", "根据", "按照", "通过", "需要", "已经",
    "应该", "可能", "没有", "不是", "或者", "而且", "因为", "所以",
]

#: Characters and words that entity candidates leave out.
GRAMMAR_PARTICLES = "的了是在和与或就着过们这那"
CANDIDATE_STOPWORDS = [
    "的是", "了的", "是在", "在了", "可以和", "和与", "或者是",
    "一个", "一些", "一切", "一起", "一定", "一般",
    "因为", "因此", "所以", "然而", "但是", "不过",
    "如果", "如果的", "假如", "假设",
    "这种", "这些", "那些", "哪个", "哪些",
    "进行", "进行着", "进行了",
    "由于", "关于", "对于", "来说",
    "而且", "或者", "否则", "除了",
    "正在", "已经", "将会", "将要",
    "他的", "她的", "它的", "他们的",
    "我们", "你们", "他们", "她们",
    "什么", "怎么", "为什么", "如何",
    "可以", "可能", "能够", "应该",
    "这个", "那个", "这里", "那里",
    "之后", "之前", "同时", "然后",
    "以及", "及其", "还是",
]

#: What marks a stored chunk's header in a text, and actions that make an event's title, each tried in this order.
TITLE_ARTIFACTS = ["**Is Overlap:**", "Token Count:**", "---", "```"]
TITLE_PATTERNS = [
    r"(对[^，。；\n]+(?:进行|作出|实施|依法))",
    r"([^，。；\n]*(?:拘留|逮捕|立案|判决|起诉|通知|认定|查明|核实|调取|冻结|扣押|询问|讯问|侦查|鉴定|批准|决定)[^，。；\n]*)",
    r"([^，。；\n]*?(?:公安局|检察院|法院|分局|派出所|鉴定中心)[^，。；\n]*?(?:对|将|依法|决定)[^，。；\n]*)",
]

#: Parts of the keys under which JSON results keep names, relations and documents.
NAME_KEYS = ["name", "entity", "person", "title", "label"]
NAME_LIST_KEYS = ["entities", "names", "persons", "mentioned"]
RELATION_KEYS = ["relation", "role", "type", "connection", "predicate"]
DOCUMENT_KEYS = ["doc_id", "document_id", "source", "doc"]

#: Where a question about a graph names its entities, each tried in this order.
GRAPH_NAME_PATTERNS = [r"[\"']([^\"']+)[\"']", r"(?:实体|人物|组织|地点|公司)[\"\s:]*([^\s，。]+)", r"([^\s，。]+)(?:的|之)(?:关系|关联)"]
GRAPH_PAIR_PATTERNS = [r"([^\s，。]+)(?:和|与|跟|同)([^\s，。]+)", r"([^\s，。]+)(?:到|至|->)([^\s，。]+)"]
#: The line of an abstract that lists its entities, and entries that name none.
ABSTRACT_ENTITIES = r"关键实体[：:]\s*(.+)"
ABSTRACT_NONE = ["无", "暂无", "未提及"]

SIMPLE_WORDS = ["是谁", "叫什么", "什么时候", "在哪", "时间", "地点", "名字", "什么人", "哪个", "几位", "多少", "何时", "哪里", "姓名"]
# -------------------------------------------------------------------------------------------------------------------


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text."""
    return reduce(Column.__add__, [text.contains(w).cast("int") for w in words])


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a run of CJK characters is one token."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def token_estimate(text: Column) -> Column:
    """1.5 for each character beyond U+2E80 and 1.3 for each blank-separated word of the rest, rounded down."""
    rest = F.regexp_replace(text, r"[\x{2E81}-\x{10FFFF}]", "")
    words = F.size(F.filter(F.split(rest, r"\s+"), lambda w: w != ""))
    return F.floor((F.length(text) - F.length(rest)) * 1.5 + words * 1.3).cast("int")


def context_token_estimate(text: Column, ranges: str = CJK + "　-〿") -> Column:
    """1.8 for each character in the ranges and 0.25 for each other one, rounded down."""
    rest = F.length(F.regexp_replace(text, f"[{ranges}]", ""))
    return F.floor((F.length(text) - rest) * 1.8 + rest * 0.25).cast("int")


def last_tokens(text: Column, n: int) -> Column:
    """The last words that make up about n estimated tokens, at least one."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    total = F.greatest(F.lit(1), token_estimate(text))
    k = F.greatest(F.lit(1), F.floor(F.size(words) * n / total).cast("int"))
    return F.array_join(F.slice(words, -F.least(k, F.greatest(F.size(words), F.lit(1))), k), " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda, what stands in an expression twice is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_positions(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches; start counts characters from 0."""

    def placed(b: Column) -> Column:
        def start(value: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(b["between"], 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
            own = F.aggregate(F.slice(b["found"], 1, i), F.lit(0), lambda a, x: a + F.length(x))
            return F.struct((before + own).alias("start"), value.alias("value"))

        return F.transform(b["found"], start)

    def split(found: Column) -> Column:
        return bound(F.struct(found.alias("found"), F.when(F.size(found) > 0, F.split(text, pattern)).alias("between")), placed)

    return bound(F.regexp_extract_all(text, F.lit(pattern), 0), split)


def normalise_name(name: Column) -> Column:
    """Trimmed; ideographic blanks and double blanks become one."""
    return F.replace(F.replace(F.trim(F.regexp_replace(name, r"^\s+|\s+$", "")), F.lit("　"), F.lit(" ")), F.lit("  "), F.lit(" "))


def normalise_id(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, f"[^a-zA-Z0-9{CJK}]+", "_"), "^_+|_+$", ""))


def normalise_value(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), " ()", "")


def entity_type(raw: Column) -> Column:
    """One of the standard types; an unknown spelling is lower-cased, null or empty is unknown."""
    known = F.when(F.coalesce(raw, F.lit("")) == "", "unknown").when(F.lower(raw) == "unknown", "unknown")
    for kind in dict.fromkeys(ENTITY_TYPES.values()):
        known = known.when(raw.isin([name for name, k in ENTITY_TYPES.items() if k == kind]), kind)
    return known.otherwise(F.lower(raw))


def entity_type_from_name(name: Column) -> Column:
    place = contains_any(name, PLACE_MARKS) & ((F.length(name) > 6) | contains_any(name, STREET_MARKS))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "unknown")
        .when(contains_any(name, ORGANIZATION_MARKS), "organization")
        .when(place, "location")
        .when(name.rlike(f"^[{CJK}]{{2,4}}$"), "person")
        .otherwise("unknown")
    )


def relation_type(text: Column) -> Column:
    """struct<type, score>: the type with the best score; two keywords must occur; a sum of money is the fallback."""
    best = F.struct(F.lit(0.5).alias("score"), F.lit(0).alias("order"), F.lit("相关").alias("type"))
    options = [best]
    for i, (kind, words, base) in enumerate(RELATION_TYPES):
        n = hits(text, words)
        score = F.when(n >= 2, F.least(F.lit(1.0), F.round(base + 0.05 * n, 10))).otherwise(0.0)
        options.append(F.struct(score.alias("score"), F.lit(-1 - i).alias("order"), F.lit(kind).alias("type")))
    top = F.greatest(*options)
    # an equal score does not replace what came before: the default has the largest order, earlier types larger ones
    money = (top["type"] != "资金往来") & text.rlike(MONEY) & (top["score"] < 0.7)
    return F.struct(F.when(money, "资金往来").otherwise(top["type"]).alias("type"), F.when(money, 0.7).otherwise(top["score"]).alias("score"))


def document_type(text: Column) -> Column:
    return F.coalesce(*[F.when(hits(text, words) >= 2, kind) for kind, words in DOCUMENT_TYPES], F.lit("其他"))


def legal_references(text: Column) -> Column:
    """Groups of all matches, joined, distinct, sorted, at most ten."""
    named = F.zip_with(F.regexp_extract_all(text, F.lit(LEGAL_REFERENCES[0]), 1), F.regexp_extract_all(text, F.lit(LEGAL_REFERENCES[0]), 2), lambda a, b: F.concat(a, b))
    rest = [F.regexp_extract_all(text, F.lit(p), 1) for p in LEGAL_REFERENCES[1:]]
    return F.slice(F.array_sort(F.array_distinct(F.concat(named, *rest))), 1, 10)


def key_numbers(text: Column) -> Column:
    """array<struct<value, context>>: sums and counts with 30 characters on either side, at most ten."""
    out = [
        F.transform(
            match_positions(text, p),
            lambda m: F.struct(
                F.trim(m["value"]).alias("value"),
                F.trim(F.replace(F.substring(text, F.greatest(F.lit(0), m["start"] - 30) + 1, m["start"] + F.length(m["value"]) + 30 - F.greatest(F.lit(0), m["start"] - 30)), F.lit("\n"), F.lit(" "))).alias("context"),
            ),
        )
        for p in KEY_NUMBERS
    ]
    return F.slice(F.concat(*out), 1, 10)


def merge_dates(text: Column) -> Column:
    """Dates by three patterns in turn, unchecked, repeats kept: ``YYYY-MM-DD`` or ``YYYY-MM``."""
    return F.concat(*[_dates(text, p) for p in MERGE_DATES])


def _dates(text: Column, pattern: str) -> Column:
    groups = 3 if pattern.count("(\\d{1,2})") == 2 else 2
    parts = [F.regexp_extract_all(text, F.lit(pattern), i + 1) for i in range(groups)]
    zipped = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])
    return F.transform(zipped, lambda z: F.concat_ws("-", z["g0"], *[F.lpad(z[f"g{i}"], 2, "0") for i in range(1, groups)]))


def timeline_dates(text: Column) -> Column:
    """array<struct<start, date>> by five patterns in turn, with 1900-2100, 1-12 and 1-31 checked."""
    found = []
    for pattern in TIMELINE_DATES:
        dated = F.transform(match_positions(text, pattern), _dater(pattern))
        found.append(F.filter(dated, lambda d: d["date"].isNotNull()))
    return F.concat(*found)


def _dater(pattern: str):
    # a value alone may not match a pattern that looks ahead, so its numbers are taken plainly
    def date(m: Column) -> Column:
        numbers = F.transform(F.slice(F.regexp_extract_all(m["value"], F.lit(r"(\d+)"), 1), 1, 3), lambda n: n.cast("int"))
        return F.struct(m["start"].alias("start"), bound(numbers, checked).alias("date"))

    def checked(numbers: Column) -> Column:
        y, mo, d = (F.get(numbers, F.lit(i)) for i in range(3))
        ok = y.between(1900, 2100) & mo.between(1, 12)
        if pattern.count("(\\d{1,2})") == 2:
            ok = ok & d.between(1, 31)
            text = F.format_string("%d-%02d-%02d", y, mo, d)
        else:
            text = F.format_string("%d-%02d", y, mo)
        return F.when(ok, text)

    return date


def relative_days(text: Column) -> Column:
    """The days by which the first relative expression in ``text`` moves a date; null if there is none."""
    out = None
    for pattern, days in RELATIVE_DATES:
        n = F.try_multiply(F.regexp_extract(text, pattern, 1).try_cast("int"), F.lit(days))
        moved = F.when(F.regexp_extract(text, pattern, 0).contains("后"), n).otherwise(-n)
        out = (F if out is None else out).when(text.rlike(pattern), moved)
    out = out.when(text.rlike("[次翌]日"), 1).when(text.rlike("当[天日]"), 0)
    return F.when(text.rlike("[后前]|[次翌]日|当[天日]"), out)


def full_day(date: Column) -> Column:
    return F.try_to_timestamp(F.substring(date, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def relative_date(base: Column, text: Column) -> Column:
    """``base`` (a full date as text) moved by the first relative expression in ``text``; null if there is none."""
    return F.date_format(F.date_add(full_day(base), relative_days(text)), "yyyy-MM-dd")


def question_complexity(query: Column) -> Column:
    return (
        F.when(contains_any(query, TABLE_TOTALS), "complex")
        .when(contains_any(query, COMPLEX_WORDS), "complex")
        .when(contains_any(query, MEDIUM_WORDS), "medium")
        .when(contains_any(query, SIMPLE_WORDS), "simple")
        .otherwise("medium")
    )


def wikilinks(text: Column) -> Column:
    """array<struct<target, display>> of ``[[target|display]]``; display is the target where none is given."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)
    return F.transform(
        inner,
        lambda x: F.struct(
            F.trim(F.substring_index(x, "|", 1)).alias("target"),
            F.trim(F.when(x.contains("|"), F.regexp_replace(x, r"^[^|]*\|", "")).otherwise(x)).alias("display"),
        ),
    )


def budgeted(text: Column, limit: int = 8000) -> Column:
    """The first 70 % and last 20 % of a limit, with a mark between them that says how much was cut."""
    head, tail = int(limit * 0.7), int(limit * 0.2)
    mark = F.concat(F.lit("\n\n[... 已截断 "), (F.length(text) - head - tail).cast("string"), F.lit(" 字符 ...]\n\n"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), mark, F.right(text, F.lit(tail))))


def ngram_words(text: Column) -> Column:
    """Search words, at most eight: of CJK runs, without particles, the greedy non-overlapping 4-, 3- and 2-grams; other
    words of two characters or more. Stop-words are left out."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(text, "[\\]\\[？?！!。，,、；;：:\"'（()）【】\\n\\r\\t]", " "), r"\s+", " "))

    def parts(segment: Column) -> Column:
        bare = F.translate(segment, SEARCH_PARTICLES, "")
        grams = [F.transform(F.when(F.length(bare) >= n, F.sequence(F.lit(0), F.floor(F.length(bare) / n).cast("int") - 1)).otherwise(F.array().cast("array<int>")), _cut(bare, n)) for n in (4, 3, 2)]
        return F.when(segment.rlike(f"^[{CJK}]+$"), F.concat(*grams)).when(F.length(segment) >= 2, F.array(segment)).otherwise(F.array().cast("array<string>"))

    words = F.flatten(F.transform(F.filter(F.split(cleaned, " "), lambda s: s != ""), parts))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(SEARCH_STOPWORDS))), 1, 8)


def entity_candidates(text: Column, most: int = 50) -> Column:
    """CJK runs of two to six characters that may be names, each once, in order of appearance."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,6}})"), 1))
    good = F.filter(runs, lambda x: ~x.isin(CANDIDATE_STOPWORDS) & ~x.rlike(f"^[{GRAMMAR_PARTICLES}]"))
    return F.slice(good, 1, most)


def graph_name(query: Column) -> Column:
    """The entity that a question about a graph names: quoted, after a keyword, before ``的关系``, else the longest word."""
    words = F.regexp_extract_all(query, F.lit(f"([{CJK}]+|[a-zA-Z]+)"), 1)
    longest = F.element_at(F.array_sort(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w")))), -1)["w"]
    tried = [F.when(query.rlike(p), F.regexp_extract(query, p, 1)) for p in GRAPH_NAME_PATTERNS]
    return F.coalesce(*tried, F.when(F.size(words) > 0, longest), query)


def graph_pair(query: Column) -> Column:
    """Two names that a question joins by ``A和B`` or ``A到B``; else its first two words."""
    tried = [F.when(query.rlike(p), F.array(F.regexp_extract(query, p, 1), F.regexp_extract(query, p, 2))) for p in GRAPH_PAIR_PATTERNS]
    return F.coalesce(*tried, F.slice(F.regexp_extract_all(query, F.lit(f"([{CJK}]+|[a-zA-Z]+)"), 1), 1, 2))


def abstract_entities(abstract: Column) -> Column:
    """Names in an abstract's line of key entities, each once, without those that say there are none."""
    parts = F.transform(F.split(F.regexp_extract(abstract, ABSTRACT_ENTITIES, 1), "[,，;；、]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin(ABSTRACT_NONE)))


def _json_items(text: Column) -> Column:
    """The entries of a JSON object, or of each object of a JSON list, as array<struct<key, value>>; values are JSON text."""
    one = F.from_json(text, "map<string,string>")
    many = F.from_json(text, "array<map<string,string>>")
    none = F.array().cast("array<struct<key:string,value:string>>")
    objects = F.when(F.ltrim(text).startswith("["), F.flatten(F.transform(F.filter(many, lambda m: m.isNotNull()), lambda m: F.map_entries(m)))).otherwise(F.map_entries(one))
    return F.coalesce(objects, none)


def _under(items: Column, keys: list[str]) -> Column:
    return F.filter(items, lambda x: contains_any(F.lower(x["key"]), keys) & x["value"].isNotNull())


def json_names(text: Column) -> Column:
    """Names of 2 to 30 characters in a JSON object or list of objects, sorted, each once: texts under keys that speak of
    names, and members of lists under keys that speak of several. A text that is no JSON gives its entity candidates."""
    items = _json_items(text)
    own = F.transform(F.filter(_under(items, NAME_KEYS), lambda x: ~x["value"].startswith("[")), lambda x: x["value"])
    listed = F.flatten(F.transform(_under(items, NAME_LIST_KEYS), lambda x: F.coalesce(F.from_json(x["value"], "array<string>"), F.array().cast("array<string>"))))
    found = F.filter(F.concat(own, listed), lambda x: F.length(x).between(2, 30))
    return F.array_sort(F.array_distinct(F.when(F.ltrim(text).rlike(r"^[\[{]"), found).otherwise(entity_candidates(text))))


def json_values(text: Column, keys: list[str]) -> Column:
    """Texts under keys that hold one of ``keys`` in a JSON object or list of objects, sorted, each once."""
    plain = F.filter(_under(_json_items(text), keys), lambda x: ~x["value"].rlike(r"^[\[{]"))
    return F.array_sort(F.array_distinct(F.transform(plain, lambda x: x["value"])))


def question_names(query: Column) -> Column:
    """Names in a question, sorted, each once: before particles, beside conjunctions, in quotes, after ``关于``."""
    before = F.filter(F.regexp_extract_all(query, F.lit(f"([{CJK}]{{2,4}})(?=的|在|与|和|对|向|被|把|从|到|给)"), 1), lambda x: ~x.isin(QUESTION_STOPWORDS))
    beside = []
    for c in CONJUNCTIONS:
        heads = F.transform(F.split(query, c), lambda p: F.regexp_extract(F.trim(p), f"^([{CJK}]{{2,4}})", 1))
        beside.append(F.when(query.contains(c), F.filter(heads, lambda x: (x != "") & ~x.isin(QUESTION_STOPWORDS + CONJUNCT_STOPWORDS))).otherwise(F.array().cast("array<string>")))
    quoted = F.regexp_extract_all(query, F.lit("[「\"'《【](.{2,10})[」\"'》】]"), 1)
    about = F.filter(F.array(F.regexp_extract(query, "(?:关于|涉及|有关)(.{2,10}?)(?:的|问题|事情|案件|事件)", 1)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(before, *beside, quoted, about)))


def question_time_range(query: Column) -> Column:
    """struct<first, last> of a question's time expressions; last is empty where there is one, both are null without any."""
    found = F.regexp_extract_all(query, F.lit(f"({TIME_EXPRESSION})"), 1)
    last = F.when(F.size(found) > 1, F.element_at(found, -1)).when(F.size(found) == 1, "")
    return F.struct(F.get(found, F.lit(0)).alias("first"), last.alias("last"))


def intent_complexity(query: Column, kind: Column) -> Column:
    """simple, medium or complex, from a question's words and its type."""
    return (
        F.when(kind == "tabular", F.when(contains_any(query, TOTAL_WORDS), "complex").otherwise("medium"))
        .when(contains_any(query, INTENT_COMPLEX) | kind.isin("analytical", "comparative"), "complex")
        .when(contains_any(query, INTENT_MEDIUM) | (kind == "relational"), "medium")
        .otherwise("simple")
    )


def sub_queries(query: Column, names: Column, kind: Column, complexity: Column) -> Column:
    """array<struct<query, layer, search, priority>>: the question itself, one query for each of its first three names, and
    for a complex one those that join two names or look for contradictions."""

    def part(text: Column, layer: Column, search: str | Column, priority: int) -> Column:
        return F.struct(text.alias("query"), layer.alias("layer"), (F.lit(search) if isinstance(search, str) else search).alias("search"), F.lit(priority).alias("priority"))

    def about(name: Column) -> Column:
        text = F.when(kind == "relational", F.concat(name, F.lit(" 关系"))).when(kind == "temporal", F.concat(name, F.lit(" 时间线"))).when(kind == "evidential", F.concat(name, F.lit(" 证据"))).otherwise(name)
        layer = F.when(kind == "temporal", "L1").when(kind == "evidential", "L2").otherwise("L0")
        search = F.when(kind == "temporal", "keyword").when(kind == "evidential", "hybrid").otherwise("graph")
        return part(text, layer, search, 2)

    first = F.array(part(query, start_level(kind, complexity), "hybrid", 1))
    broad = complexity == "complex"
    two = F.when(broad & (F.size(names) >= 2), part(F.concat(F.get(names, F.lit(0)), F.lit(" "), F.get(names, F.lit(1)), F.lit(" 关系")), F.lit("L1"), "hybrid", 2))
    against = F.when(broad & (F.size(names) >= 1) & kind.isin("comparative", "analytical"), part(F.concat(F.get(names, F.lit(0)), F.lit(" 矛盾 不一致")), F.lit("L1"), "keyword", 3))
    return F.concat(first, F.transform(F.slice(names, 1, 3), about), F.array_compact(F.array(two, against)))


def _cut(segment: Column, n: int):
    return lambda i: F.substring(segment, i * n + 1, F.lit(n))


def question_type(query: Column) -> Column:
    out = F.when(contains_any(query, TABLE_WORDS + TOTAL_WORDS), "tabular")
    for kind, words in QUESTION_TYPES:
        out = out.when(contains_any(query, words), kind)
    return out.otherwise("factual")


def start_level(kind: Column, complexity: Column) -> Column:
    """The layer that a search begins with."""
    return F.when(kind == "tabular", "L1").when(complexity == "simple", "L0").when(kind == "evidential", "L2").otherwise("L1")


#: One pattern for all lines that begin a chapter.
CHAPTER = "|".join(CHAPTER_LINES)


def heading(text: Column, pattern: str = CHAPTER) -> Column:
    """The first line that begins a chapter or volume; null if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))


def json_object(text: Column) -> Column:
    """The JSON text of a model's answer: a fenced block, else the first object with balanced braces; else null.

    Braces in quotes do not count. Texts are an answer each, so a fold over their marks is short.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    rest = F.when(text.contains("{"), F.substring(text, F.instr(text, "{"), F.length(text)))
    marks = F.regexp_extract_all(rest, F.lit(r'(?s)([{}]|"(?:[^"\\]|\\.)*"|[^{}"]+|")'), 1)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, m: Column) -> Column:
        depth = s["depth"] + F.when(m == "{", 1).when(m == "}", -1).otherwise(0)
        at = s["at"] + F.length(m)
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when((m == "}") & (depth == 0), at).otherwise(0).alias("end")))

    end = F.aggregate(marks, state, step)["end"]
    return F.when(fenced != "", fenced).when(end > 0, F.substring(rest, F.lit(1), end))


def word_pairs(text: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) >= 2)
