"""Text functions as JVM-side column expressions. A null argument gives null unless the docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the domain.
LATIN_TOKEN = r"(?U)[A-Za-z]+(?:[-_/][A-Za-z0-9]+)*|\d+(?:\.\d+)?"
HAN_RUN = r"[\x{4e00}-\x{9fff}]+"
NUMBER = r"(?U)\d+(?:\.\d+)?"
NUMBER_UNIT = r"(?iU)[-+]?\d+(?:\.\d+)?(?:mm|cm|m|MPa|kPa|Pa|N·m|Nm|℃|°C|%)?"
MENTION_MARKS = r"(?U)[\s，。；：、（）()\-_/]"
MENTION_PREFIX = "^(?:故障|该|此|现有|相关|重新|局部|原)"
QUESTION = "(?:检查|复查|确认|验证)?(?:有无|是否)"
NEGATION = "无|未|没有|不得|不应|不能|消失|为零"
INSPECTION = "有无|是否|检查|复查|确认|验证|试验"
EVENT_NEGATIVE = "无法|不能|未|没有|为零|无压力|不合格|失效"
EVENT_REPAIRED = "采用新|更换|修复|完成装配|合格|恢复正常|有效防松"
ENDPOINT_NEGATIVE = "无法|不能|未采用|未安装|没有|为零|无压力|不合格|失效|仍然|又未"
ENDPOINT_REPAIRED = "采用新|更换|修复|完成装配|合格|恢复正常|有效防松|已完成"
ENDPOINT_FAILURE = "裂纹|泄漏|松动|磨损|断裂|变形|异响|碰磨|损伤|深槽"
SUSPECTED = "怀疑|疑似|初步判断|初步认为"
POSSIBLE = "可能|可导致|风险|或为|推测"
CONFIRMED = "确认|发现|显示|证实|结果为|检查可见"
DETAIL = r"(?U)(?:\d+(?:\.\d+)?(?:mm|cm|MPa|kPa|N·m|℃|%|号)?|[A-Za-z0-9]+(?:[-_/][A-Za-z0-9.]+)+|未|无|没有|不得|不能|已|重新|更换|修复|报废|合格|异常|损伤|裂纹|泄漏)"
CONCEPT_MARKS = r"(?U)[\s，。；、：:,.!?！？（）()【】\[\]<>《》“”\"'‘’\-—_]+"
CONCEPT_SYNONYMS = (("换装|换新|替换", "更换"), ("拧紧|压紧|重新紧固", "紧固"), ("复测|重新测量", "测量"), ("气密性试验|气密检查", "气密试验"), ("清洁", "清理"), ("拆卸|拆开", "分解"), ("重新安装|回装", "复装"))
RELATION_TYPES = ("CAUSE", "TREAT", "VERIFY", "TEMPORAL")
SENTENCE_END = "。！？；\\n"
SLOT_PATTERNS = {
    "component": r"(?U)(?:\d+号)?(?:轴承|转子|涡轮|压气机|叶片|导向器|机匣|法兰|O型圈|密封圈|封严环|回油管|燃油管|滑油管|液压管|管路|接头|软管|齿轮|齿轮箱|传感器|电缆|插头|作动筒|活门|泵|喷嘴|燃烧室|整流罩|支架|螺栓|螺母|垫片|衬套|轴颈|轴|端盖)",
    "location": r"[\x{4e00}-\x{9fff}A-Za-z0-9]{0,14}(?:进气端|排气端|前端|后端|内侧|外侧|上部|下部|根部|尖部|边缘|端面|结合面|密封面|安装孔|轴承腔|检查盖|接头处|法兰面|沟底|槽底|局部)",
    "stage": r"(?:总装|装配|复装|分解|拆卸|试装|试车|运转|运行|起动|巡航|盘转|气密试验|功能试验|性能试验|入库|运输|检修|返工|对接|紧固)(?:过程中|阶段|后|前|时)?",
    "phenomenon": r"(?:漏油|渗油|泄漏|冒泡|异响|打鼓声|啸叫声|振动(?:偏高|超限)?|温度(?:偏高|异常)|卡滞|不灵活|压力(?:下降|异常|为零)|假信号|信号异常|金属屑|堵塞|不同步|间隙异常|转动阻力(?:大|异常)|无法转动|无响应)",
    "damage_state": r"(?:挤压坑|压伤|划伤|划痕|裂纹|断裂|磨损|擦伤|凹陷|变形|翘曲|切伤|咬伤|烧蚀|剥落|脱落|掉块|崩边|毛刺|翻边|腐蚀|过热|变色|疲劳|松动|错位|窜动|报废)",
    "inspection_evidence": r"(?:检查|测量|复测|检验|鉴定|分析|显示|发现|确认|观察|试验|探伤|吹扫)",
    "cause": r"(?:原因|由于|因|导致|造成|形成|未按|未能|不当|错误|偏差|不匹配|不足|过大|过小)",
    "maintenance_action": r"(?:更换|换新|拆除|拆下|分解|清理|清洗|修整|修平|打磨|补焊|重加工|调整|涂敷|润滑|返修|报废)",
    "reassembly_control": r"(?:复装|重新安装|重新装配|对接|自然贴合|分级紧固|对称紧固|星形紧固|控制力矩|控制间隙)",
    "verification": r"(?:复查|复测|验证|确认合格|重新检查|气密试验|功能测试|功能试验|盘转检查|试车|压力稳定|无气泡|无异响)",
}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, then) -> Column:
    """then(value) with value evaluated once: as the element of an array it is a variable, which no use of it computes again."""
    return F.transform(F.array(value), then)[0]


def _pieces(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def _grams(text: Column, size: int) -> Column:
    """All n-grams of a text in order; a shorter text gives itself."""
    return bound(text, lambda t: _pieces(t, size))


def fold(text: Column) -> Column:
    """Caseless form: lower case with the sharp s opened."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def domain_tokens(text: Column) -> Column:
    """Latin and number tokens, then of every ideograph run all characters and all pairs; a multiset."""
    t = fold(text)
    han = F.flatten(F.transform(_all(t, HAN_RUN), lambda r: F.concat(_grams(r, 1), F.when(F.length(r) > 1, _grams(r, 2)).otherwise(F.array().cast("array<string>")))))
    return F.concat(_all(t, LATIN_TOKEN), han)


def gram_set(text: Column, size: int = 2) -> Column:
    """Distinct n-grams without white space; a shorter text is its own gram, an empty one has none."""
    cut = lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < size, F.array(t)).otherwise(F.array_distinct(_pieces(t, size)))
    return bound(F.regexp_replace(fold(text), r"(?U)\s+", ""), cut)


def set_dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice similarity of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def dice(left: Column, right: Column, size: int = 2) -> Column:
    """set_dice() of n-gram sets."""
    both = F.struct(gram_set(left, size).alias("l"), gram_set(right, size).alias("r"))
    return bound(both, lambda x: set_dice(x["l"], x["r"]))


def normalize_mention(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), MENTION_MARKS, ""), MENTION_PREFIX, "")


def mention_form(text: Column) -> Column:
    """What form_similarity() compares: the normalized mention and its n-gram set. Make it a column once where a mention meets several others."""
    return bound(normalize_mention(text), lambda n: F.struct(n.alias("normal"), gram_set(n).alias("grams")))


def form_similarity(left: Column, right: Column) -> Column:
    """0 if empty, 1 if equal, at least .82 for containment, else Dice, of two mention_form() columns."""
    a, b = left["normal"], right["normal"]
    la, lb = F.length(a), F.length(b)
    d = set_dice(left["grams"], right["grams"])
    return (
        F.when((la == 0) | (lb == 0), 0.0)
        .when(a == b, 1.0)
        .when(a.contains(b) | b.contains(a), F.greatest(d, 0.82 + 0.18 * F.least(la, lb) / F.greatest(la, lb)))
        .otherwise(d)
    )


def mention_similarity(left: Column, right: Column) -> Column:
    """form_similarity() of two texts."""
    both = F.struct(mention_form(left).alias("l"), mention_form(right).alias("r"))
    return bound(both, lambda x: form_similarity(x["l"], x["r"]))


def token_set(text: Column) -> Column:
    """Distinct tokens longer than one character or holding a digit."""
    return F.filter(F.array_distinct(domain_tokens(text)), lambda t: (F.length(t) > 1) | t.rlike(r"(?U)\d"))


def _number_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, NUMBER)))


def numeral_conflict(left: Column, right: Column) -> Column:
    a, b = _number_set(left), _number_set(right)
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def negation_conflict(left: Column, right: Column) -> Column:
    negative = lambda t: F.regexp_replace(t, QUESTION, "").rlike(NEGATION)
    return negative(left) != negative(right)


def event_state(text: Column) -> Column:
    return F.when(text.rlike(INSPECTION), "inspection").when(text.rlike(EVENT_NEGATIVE), "negative").when(text.rlike(EVENT_REPAIRED), "repaired").otherwise("neutral")


def endpoint_state(text: Column) -> Column:
    return (
        F.when(text.rlike(INSPECTION), "inspection")
        .when(text.rlike(ENDPOINT_NEGATIVE), "negative")
        .when(text.rlike(ENDPOINT_REPAIRED), "repaired")
        .when(text.rlike(ENDPOINT_FAILURE), "failure")
        .otherwise("neutral")
    )


def state_conflict(left: Column, right: Column, state=endpoint_state) -> Column:
    """One side negative, the other repaired."""
    return F.array_sort(F.array(state(left), state(right))) == F.array(F.lit("negative"), F.lit("repaired"))


def role_compatible(left: Column, right: Column) -> Column:
    return F.upper(left).isin(*RELATION_TYPES) & F.upper(right).isin(*RELATION_TYPES)


def modality(text: Column) -> Column:
    return F.when(text.rlike(SUSPECTED), "suspected").when(text.rlike(POSSIBLE), "possible").when(text.rlike(CONFIRMED), "confirmed").otherwise("unknown")


def sentence_array(text: Column) -> Column:
    """(start, end, sentence) structs: cut after an end mark or line break, blank ones dropped, start behind leading white space."""
    parts = F.split(text, f"(?<=[{SENTENCE_END}])", -1)
    blank = r"(?U)^[\s\x1c-\x1f]+"
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p)).alias("at"),
        F.concat(
            acc["out"],
            F.array(
                F.struct(
                    (acc["at"] + F.length(p) - F.length(F.regexp_replace(p, blank, ""))).alias("start"),
                    (acc["at"] + F.length(p)).alias("end"),
                    F.regexp_replace(F.regexp_replace(p, blank, ""), r"(?U)[\s\x1c-\x1f]+$", "").alias("sentence"),
                )
            ),
        ).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,sentence:string>>").alias("out"))
    return F.filter(F.aggregate(parts, start, step)["out"], lambda s: F.length(s["sentence"]) > 0)


def slot_values(text: Column, slot: str) -> Column:
    return _all(text, SLOT_PATTERNS[slot])


def global_id(document: Column, local: Column) -> Column:
    """The id prefixed by its document unless it is already; then the first ':' becomes '_'."""
    own = local.startswith(F.concat(document, F.lit("_"))) | local.startswith(F.concat(document, F.lit(":")))
    return F.when(own, F.regexp_replace(local, "^([^:]*):", "$1_")).otherwise(F.concat(document, F.lit("_"), local))


def sentence_evidence(text: Column, start: Column, end: Column) -> Column:
    """The sentences a span touches, right mark included; '' for an invalid span."""
    left = F.regexp_extract(F.substring(text, F.lit(1), start), f"[^{SENTENCE_END}]*\\z", 0)
    middle = F.substring(text, start + 1, end - start)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), f"^[^{SENTENCE_END}]*[{SENTENCE_END}]?", 0)
    valid = (F.length(text) > 0) & (start >= 0) & (end > start) & (end <= F.length(text))
    return F.when(valid, F.regexp_replace(F.concat(left, middle, right), r"(?U)^\s+|\s+$", "")).otherwise("")


def detail_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DETAIL))


def concept_text(text: Column) -> Column:
    """Lower case without punctuation, synonyms rewritten in order; null counts as empty."""
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), CONCEPT_MARKS, "")
    for pattern, word in CONCEPT_SYNONYMS:
        out = F.regexp_replace(out, pattern, word)
    return out


def number_units(text: Column) -> Column:
    """Numbers with their unit, lower case, as a sorted multiset."""
    return F.array_sort(F.transform(_all(F.coalesce(text, F.lit("")), NUMBER_UNIT), F.lower))


def number_safe(left: Column, right: Column) -> Column:
    a, b = number_units(left), number_units(right)
    return ~((F.size(a) > 0) & (F.size(b) > 0) & (a != b))


def gram_containment(left: Column, right: Column) -> Column:
    """Shared pairs over the smaller set; texts are taken as they are."""
    grams = lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) < 2, F.array(t)).otherwise(F.array_distinct(_grams(t, 2)))
    a, b = grams(left), grams(right)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def concept_id(role: Column, label: Column) -> Column:
    return F.concat(F.lit("C_"), F.substring(role, 1, 3), F.lit("_"), F.substring(F.sha1(F.concat(role, F.lit("|"), label)), 1, 12))


def pattern_signature(roles: Column, concepts: Column, relations: Column) -> Column:
    return F.concat(F.array_join(F.zip_with(roles, concepts, lambda r, c: F.concat(r, F.lit(":"), c)), ">"), F.lit("||"), F.array_join(relations, "|"))


def pattern_id(signature: Column) -> Column:
    return F.concat(F.lit("PAT_"), F.substring(F.sha1(signature), 1, 16))


def pattern_nodes(signature: Column) -> Column:
    """Nodes of a signature's path; 0 without a path."""
    path = F.split_part(signature, F.lit("||"), F.lit(1))
    return F.when(F.length(path) == 0, 0).otherwise(F.regexp_count(path, F.lit(">")) + 1)
