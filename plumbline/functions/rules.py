"""Rule sets: word lists, vocabularies and decision tables, as data and as column expressions."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import blank, cleaned_reply

# Word lists, labels and aliases that results must agree on.
POSITIVE = r"好看|漂亮|高级|舒服|舒适|丝滑|清爽|清透|通透|质感|喜欢|爱了|不错|真棒|很棒|惊艳|好用|流畅|用心|满意|支持|真香|终于有|终于更新|解决了|更好看|更好用|更流畅|无广告|没有广告"
NEGATIVE = r"丑|难看|土|差评|不喜欢|难受|失望|恶心|后悔|难用|不好用|不如以前|退步|垃圾|越更越拉|bug|问题|故障|异常|闪退|卡顿|割裂|变形|偏移|重复|缺陷|用不了|不能用|不支持|找不到|不显示|没了|缺了|少了|不方便|广告|强制跳|版权不够|音质差"
FEATURE_GAP = r"什么时候|啥时候|何时|能不能|可以不可以|怎么还|为什么还|希望.{0,20}(加|上|适配|支持|恢复|优化|修)|建议|赶紧"
FEATURE_WORD = r"功能|适配|一起听|本地音乐|歌单|排序|批量|导入|皮肤|装扮|图标|背景|歌词|播放器|音效|倍速|搜索|车机|会员|广告|积分|收藏|权限|入口|播放|下载|评论|私信|分享"
ABSENCE = r"没有|还是没有|依然没有|仍然没有|没了|缺少|不见了|被砍|阉割"
AD_FREE = r"没有.{0,4}广告|无广告"
INFO_QUESTION = r"什么版本|哪个版本|多少版本|在哪更新|哪里更新|怎么更新|更新了吗|是正式版吗|在哪里|在哪儿|怎么设置|怎么换|如何换|怎么弄|有教程吗|什么机型|鸿蒙几"
SOLUTION = r"可以.{0,10}(换|改|设置|关闭|打开)|换回|切回|在.{0,12}(设置|播放器|应用市场)|点.{0,10}(这里|进去|右上角)|重新安装|清缓存"
AGREE = r"^(?:回复\s+[^:：]+\s*[:：]\s*)?(是|是的|对|对的|确实|没错|同感|我也是|真的|就是|加一|\+1|赞同|认同|一样)[啊呀呢吧嘛。！!~～…]*$"
AGREE_PREFIX = r"^(?:回复\s+[^:：]+\s*[:：]\s*)?(对|是的|确实|同感|我也是|加一|赞同|认同)[，,。！!：:]"
DISAGREE = r"^(?:回复\s+[^:：]+\s*[:：]\s*)?(不是|不对|没有吧|哪有|明明|我觉得还好|我觉得挺好|我觉得好看)"
RELIEF = r"谢谢|感谢|明白|好的|收到|解决了|可以了"
POS_EMOJI = r"😍|🥰|😘|👍|❤|❤️|💕|💗|🔥|🎉|🥳|🤩|\[赞R\]|\[色色R\]|\[哇R\]"
NEG_EMOJI = r"😡|🤢|🤮|💔|🙄|😤|\[失望R\]|\[生气R\]|\[哭惹R\]"
EMOJI_OR_PUNCT = r"^[\W_\d\s☀-⟿\x{1F000}-\x{1FAFF}]+\z"
TOPICS = {
    "界面与视觉": r"界面|UI|ui|视觉|好看|漂亮|丑|难看|通透|沉浸|光感|质感|颜色|字体|图标|皮肤|装扮",
    "性能与稳定": r"流畅|卡顿|闪退|崩溃|发热|耗电|加载|性能|稳定|bug|BUG|故障|异常",
    "鸿蒙适配": r"鸿蒙|HarmonyOS|适配|原生鸿蒙|星河版|NEXT|智感握姿|碰一碰",
    "功能缺口": r"没有|缺少|少了|没了|什么时候|啥时候|希望|建议|能不能|不支持|找不到|功能",
    "播放与音质": r"播放|播放器|音质|音效|歌词|倍速|歌单|本地音乐|下载|收藏|一起听",
    "账号与社交": r"登录|账号|私信|好友|评论|分享|关注|动态|bubble|DM|一起听",
    "会员与商业化": r"会员|SVIP|绿钻|广告|付费|收费|价格|积分|权益|商城",
    "版本与更新": r"版本|更新|正式版|测试版|内测|尝鲜|升级|回退|安装包",
}
FINAL_LABELS = ("", "正向", "负向", "混合", "中性", "未判定")
ASSISTED_LABELS = ("正向", "负向", "混合", "中性", "待语境")
OTHER_TOPIC = "其他/未归类"
RATING_TEXT = {"非常棒": 5, "很不错": 4, "还可以": 3, "不太好": 2, "非常差": 1}
DEVICES = (
    ("matepad|pad|平板", "平板系列"),
    ("matex|mate x|pocket|折叠", "MateX折叠屏"),
    ("pura|p60|p70|p80", "Pura系列"),
    ("nova", "nova系列"),
    ("畅享|enjoy", "畅享系列"),
    ("mate", "Mate直板机"),
)
MODULES = {
    "核心播放": "播放|暂停|歌单|排序|歌词|本地|导入",
    "内容发现": "推荐|榜|由你榜|搜索|活动|抽卡",
    "社交互动": "一起听|好友|连麦|评论|分享",
    "鸿蒙特性": "鸿蒙|原生|适配|动效|分布式|智感",
    "账号体系": "登录|会员|绿钻|权益|付费|已购",
    "个性化": "装扮|皮肤|背景|勋章|等级|头像",
    "体验问题": "卡|闪退|白屏|广告|摇一摇|跳转",
}
PRESENT = ("已验证存在",)
PARTIAL = ("仅入口存在", "部分可用")
ABSENT = ("明确缺失",)
UNKNOWN = ("未检查", "受阻", "未收录", "状态冲突")
ALLOWED_STATUSES = ("已验证存在", "仅入口存在", "部分可用", "明确缺失", "未检查", "受阻")
STATUS_ALIASES = {
    "页面已验证": "已验证存在",
    "入口已验证": "仅入口存在",
    "功能已验证": "已验证存在",
    "控件已验证": "已验证存在",
    "流程页已验证": "已验证存在",
    "流程已验证": "已验证存在",
    "状态已验证": "已验证存在",
    "链路已验证": "已验证存在",
    "交互已验证": "已验证存在",
    "存在": "已验证存在",
    "缺失": "明确缺失",
    "未验证": "未检查",
}
STATUS_RANK = {"状态冲突": 6, "明确缺失": 5, "部分可用": 4, "已验证存在": 3, "仅入口存在": 2, "受阻": 1, "未检查": 0}
DIRECTIONS = ("正向", "负向", "混合")
REASONS = {
    "mixed": "同一评论同时包含明确认可与问题或保留意见",
    "positive": "文本包含直接正向评价或正向比较",
    "negative": "文本包含直接负向评价、功能缺失或使用阻碍",
    "gap": "以询问或建议表达当前能力尚未满足",
    "question": "主要询问版本、设备、入口或操作方法",
    "solution": "主要提供设置、切换或修复方法",
    "up": "使用明确正向表情",
    "down": "使用明确负向表情",
    "open": "文本本身缺少足够极性，需要结合帖子或上级评论",
    "agrees_post": "简短赞同表达结合帖子%s立场判断",
    "signs_post": "纯表情或标点结合帖子%s立场判断",
    "agrees_root": "简短赞同表达继承根评论的%s立场",
    "agrees_neutral": "赞同的是事实或操作信息，并非产品褒贬",
    "against_negative": "回复反驳根评论的负面判断",
    "against_positive": "回复反驳根评论的正面判断",
    "relief": "回复表明上级问题获得解释或解决",
    "solution_reply": "针对上级问题提供方法，未直接评价产品",
    "signs_root": "纯表情或标点结合根评论的%s立场判断",
}
NATURES = ("头号缺失需求", "满意度毒药", "信任风险", "基础体验欠账", "已上线·回正", "口碑亮点", "差异化优势")
#: From store columns to the columns that tagging reads.
STANDARD_FIELDS = {"发布时间": "日期", "地区": "省份", "设备": "机型", "评分描述": "评分文字", "用户": "用户名"}
# End of the fixed values.

# Ours: the specification gives descriptions, not patterns, for these; first match wins.
ISSUE_TYPES = (
    ("BUG", "异常|白屏|闪退|无法播放|乱码|失效|(?i)bug"),
    ("功能缺失", "没有.{0,8}功能|什么时候|啥时候|安卓.{0,6}有"),
    ("性能问题", "卡顿|很慢|发热|耗电"),
    ("广告问题", "广告|开屏|弹窗|摇一摇|跳转"),
    ("体验差", "不好用|难用|复杂|难看|不方便"),
    ("鸿蒙适配好评", "(?:鸿蒙|原生|适配).{0,10}(?:好|棒|流畅|快)"),
    ("正面反馈", POSITIVE + "|感谢|谢谢"),
    ("功能建议", "建议|希望|能不能|增加"),
)
#: Names of other products; a project gives its own.
COMPETITORS = (("网易云|云音乐", "网易云音乐"), ("酷狗", "酷狗音乐"), ("酷我", "酷我音乐"), ("汽水音乐", "汽水音乐"), ("(?i)spotify", "Spotify"), ("(?i)apple\\s?music", "Apple Music"))
TRUST = "广告|扣费|续费|会员权益|隐私|欺骗"
URGENT = "退款|卸载|付费|会员|无法播放|闪退|用不了"
HEATED = "垃圾|恶心|退款|卸载|骂"
QUESTION = r"[?？]|吗|怎么|如何"


@dataclass(frozen=True)
class RuleSet:
    """Everything a labelling run depends on, frozen: name, version and a digest go with the results."""

    name: str = "compat"
    version: str = "v1"
    positive: str = POSITIVE
    negative: str = NEGATIVE
    feature_gap: str = FEATURE_GAP
    feature_word: str = FEATURE_WORD
    absence: str = ABSENCE
    ad_free: str = AD_FREE
    info_question: str = INFO_QUESTION
    solution: str = SOLUTION
    topics: tuple[tuple[str, str], ...] = tuple(TOPICS.items())
    devices: tuple[tuple[str, str], ...] = DEVICES
    modules: tuple[tuple[str, str], ...] = tuple(MODULES.items())
    issue_types: tuple[tuple[str, str], ...] = ISSUE_TYPES
    competitors: tuple[tuple[str, str], ...] = COMPETITORS
    trust: str = TRUST
    weights: dict[str, float] = field(default_factory=lambda: {"V": 0.30, "D": 0.30, "G": 0.15, "U": 0.15, "F": 0.10})

    @property
    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), ensure_ascii=False, sort_keys=True).encode()).hexdigest()

    def with_topics(self, config: dict) -> RuleSet:
        """These rules with topics of {name: pattern}; anything but text for text is an error."""
        if not isinstance(config, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in config.items()):
            raise ValueError("topics must map names to patterns")
        return RuleSet(**{**self.__dict__, "name": f"{self.name}+topics", "topics": tuple(config.items())})


DEFAULT = RuleSet()


#: Ideographs, kana, their punctuation and wide forms.
_WIDE = "\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef"


#: Runs of other characters from this length on are left out of what is searched for wide ones.
_FAR = 64


def wide_only(c: Column) -> Column:
    """The text where it has a wide character, without runs of 64 and more others (a line break stands for each), else the
    empty text: what patterns that need a wide character, and reach less far than that, have to search."""
    near = F.regexp_replace(c, f"[^{_WIDE}]{{{_FAR},}}", "\n")
    return F.when(c.rlike(f"[{_WIDE}]"), near).otherwise("")


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern, cut at | outside of groups and classes."""
    out, depth, in_class, at = [], 0, False, 0
    for i, x in enumerate(pattern):
        if i and pattern[i - 1] == "\\":
            continue
        if in_class:
            in_class = x != "]"
        elif x == "[":
            in_class = True
        elif x in "()":
            depth += 1 if x == "(" else -1
        elif x == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


@functools.cache
def needs_wide(branch: str) -> bool:
    """Whether an alternative can only match where there is a wide character: it has one by itself, or a group all of whose
    alternatives need one, that no ?, * or { makes optional. In doubt it does not; nor does one with an anchor, or with a
    repetition that may reach 64 characters."""
    if re.search(r"[\^$]|\\[zbAZ]|[*+]|\{\d*,\}", branch.replace("[^", "[")) or any(int(n) >= _FAR for n in re.findall(r"(\d+)\}", branch)):
        return False
    i = 0
    while i < len(branch):
        x = branch[i]
        end = i + 1
        if x == "\\":
            end, found = i + 2, False
        elif x == "[":
            end, found = branch.index("]", i) + 1, False
        elif x == "(":
            depth = 0
            for end in range(i, len(branch)):
                depth += {"(": 1, ")": -1}.get(branch[end], 0)
                if not depth:
                    break
            inner, end = branch[i + 1 : end], end + 1
            found = not inner.startswith("?") or inner.startswith("?:")
            found = found and all(needs_wide(y) for y in _branches(inner.removeprefix("?:")))
        else:
            found = bool(re.match(f"[{_WIDE}]", x))
        if found and branch[end : end + 1] not in ("?", "*", "{"):
            return True
        i = end
    return False


def has(c: Column, pattern: str, wide: Column | None = None) -> Column:
    """Whether the pattern occurs, whatever the case. Unicode classes and case tables cost several times the search, so
    they are asked for only where the pattern has a class or a cased letter beyond ASCII. wide: wide_only(c) as a column of
    its own; then alternatives that need a wide character search that alone, which costs nothing for most other texts."""
    flags = lambda p: "i" + "u" * any(x > "\x7f" and x.lower() != x.upper() for x in p) + "uU" * bool(re.search(r"\\[wWsSdDbB]", p))
    search = lambda on, p: on.rlike(f"(?{flags(p)})(?:{p})")
    if wide is None:
        return search(c, pattern)
    other = [b for b in _branches(pattern) if not needs_wide(b)]
    if len(other) == len(_branches(pattern)):
        return search(c, pattern)
    return search(wide, pattern) | search(c, "|".join(other)) if other else search(wide, pattern)


def _verdict(sentiment: str | Column, intent: str, confidence: str, reason: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(sentiment).alias("sentiment"), F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), lit(reason).alias("reason"))


def _first_of(rules: list[tuple[Column | None, Column]]) -> Column:
    """The verdict of the first rule whose condition holds; a condition of None always holds."""
    out = None
    for condition, verdict in rules:
        if condition is None:
            return out.otherwise(verdict)
        out = F.when(condition, verdict) if out is None else out.when(condition, verdict)
    return out


def direct_classify(text: Column, rules: RuleSet = DEFAULT, wide: Column | None = None, cleaned: bool = False) -> Column:
    """struct(sentiment, intent, confidence, reason) of a comment by itself; the first rule that holds decides. wide:
    wide_only(text) as a column, which spares most texts without wide characters the search. cleaned: text is
    cleaned_reply() of the comment as a column of its own, which each pattern reads again."""
    t = text if cleaned else cleaned_reply(text)
    w = None if wide is None else cleaned_reply(wide)
    positive, word = has(t, rules.positive, w), has(t, rules.feature_word, w)
    negative = has(t, rules.negative, w) | (has(t, rules.absence, w) & word & ~has(t, rules.ad_free, w))
    up, down = has(t, POS_EMOJI), has(t, NEG_EMOJI)
    bad = REASONS["negative"]
    return _first_of(
        [
            (positive & negative, _verdict("混合", "褒贬并陈", "高", REASONS["mixed"])),
            (positive, _verdict("正向", "赞美/认可", "高", REASONS["positive"])),
            (negative & word, _verdict("负向", "功能缺口/投诉", "高", bad)),
            (negative, _verdict("负向", "批评/不满", "高", bad)),
            (has(t, rules.feature_gap, w) & word, _verdict("负向", "功能需求/期待改进", "中", REASONS["gap"])),
            (has(t, rules.info_question, w), _verdict("中性", "求助/版本询问", "高", REASONS["question"])),
            (has(t, rules.solution, w), _verdict("中性", "解释/解决方案", "高", REASONS["solution"])),
            (up & ~down, _verdict("正向", "情绪表达", "中", REASONS["up"])),
            (down & ~up, _verdict("负向", "情绪表达", "中", REASONS["down"])),
            (None, _verdict("待语境", "待语境", "低", REASONS["open"])),
        ]
    )


def contextualize(text: Column, direct: Column, root: Column, stance: Column, is_root: Column, rules: RuleSet = DEFAULT, cleaned: bool = False) -> Column:
    """What the post's stance or the root comment's sentiment adds where a comment by itself decides nothing. cleaned: as in
    direct_classify."""
    t = text if cleaned else cleaned_reply(text)
    agrees = has(t, AGREE) | has(t, AGREE_PREFIX)
    signs, against = has(t, EMOJI_OR_PUNCT), has(t, DISAGREE)
    stance, root = blank(stance), blank(root)
    takes_side, root_side = stance.isin(*DIRECTIONS), root.isin(*DIRECTIONS)
    about = lambda key, label: F.format_string(REASONS[key], label)
    by_post = _first_of(
        [
            (agrees & takes_side, _verdict(stance, "回应帖子/赞同", "中", about("agrees_post", stance))),
            (signs & takes_side, _verdict(stance, "回应帖子/情绪表达", "低", about("signs_post", stance))),
            (None, direct),
        ]
    )
    by_root = _first_of(
        [
            (agrees & root_side, _verdict(root, "赞同上级评论", "高", about("agrees_root", root))),
            (agrees & (root == "中性"), _verdict("中性", "赞同中性信息", "中", REASONS["agrees_neutral"])),
            (against & (root == "负向"), _verdict("正向", "反驳负面评价", "中", REASONS["against_negative"])),
            (against & (root == "正向"), _verdict("负向", "反驳正面评价", "中", REASONS["against_positive"])),
            (has(t, RELIEF) & (root == "负向"), _verdict("正向", "问题缓解", "中", REASONS["relief"])),
            (has(t, rules.solution), _verdict("中性", "解释/解决方案", "高", REASONS["solution_reply"])),
            (signs & root_side, _verdict(root, "回应上级评论/情绪表达", "低", about("signs_root", root))),
            (None, direct),
        ]
    )
    return F.when(direct["sentiment"] != "待语境", direct).when(is_root, by_post).otherwise(by_root)


def matches(text: Column, table: tuple[tuple[str, str], ...], other: str | None, wide: Column | None = None) -> Column:
    """All names whose pattern occurs, in table order; [other] if none does."""
    found = F.filter(F.array(*(F.when(has(text, p, wide), F.lit(n)) for n, p in table)), lambda x: x.isNotNull())
    return found if other is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


def topics_for(text: Column, rules: RuleSet = DEFAULT) -> Column:
    return matches(text, rules.topics, OTHER_TOPIC)


def first_match(text: Column, table: tuple[tuple[str, str], ...], other: str, wide: Column | None = None) -> Column:
    out = None
    for pattern, name in table:
        found = has(text, pattern, wide)
        out = F.when(found, name) if out is None else out.when(found, name)
    return F.lit(other) if out is None else out.otherwise(other)


def device_series(device: Column, rules: RuleSet = DEFAULT) -> Column:
    """struct(series, keyword, low_confidence): the first rule of the frozen order whose pattern occurs."""
    d = F.lower(blank(device))
    series = first_match(d, rules.devices, "其他")
    keyword = F.coalesce(*(F.nullif(F.regexp_extract(d, f"({p})", 1), F.lit("")) for p, _ in rules.devices), F.lit(""))
    return F.struct(series.alias("series"), keyword.alias("keyword"), (keyword == "").alias("low_confidence"))


def effective_label(final: Column, context: Column) -> Column:
    label = F.coalesce(F.nullif(final, F.lit("")), F.nullif(context, F.lit("")), F.lit("未判定"))
    return F.when(label == "待语境", "未判定").otherwise(label)


def thread_label(p: Column, n: Column, m: Column) -> Column:
    """The label of a thread with p positive, n negative and m mixed comments."""
    return (
        F.when(p + n + m == 0, "中性/未判定")
        .when((n == 0) & (m == 0), "正向")
        .when((p == 0) & (m == 0), "负向")
        .when(p >= F.greatest(F.lit(2), 2 * n + m), "正向为主")
        .when(n >= F.greatest(F.lit(2), 2 * p + m), "负向为主")
        .otherwise("正负并存")
    )


def diff_type(left: Column, right: Column, left_label: str, right_label: str) -> Column:
    """How two statuses of one feature compare; the first rule that holds decides."""
    has_left, has_right = (s.isin(*PRESENT, *PARTIAL) for s in (left, right))
    return (
        F.when(left.isin(*UNKNOWN) | right.isin(*UNKNOWN), "待核验")
        .when(left.isin(*ABSENT) & right.isin(*ABSENT), "双方均明确缺失")
        .when(left.isin(*ABSENT) & has_right, f"{left_label}明确缺失")
        .when(right.isin(*ABSENT) & has_left, f"{right_label}明确缺失")
        .when(left.isin(*PRESENT) & right.isin(*PRESENT), "能力对齐")
        .when(has_left & has_right, "完整度差异")
        .otherwise("待核验")
    )


def lookup(c: Column, table: dict) -> Column:
    """table's value for c, c itself where it has none."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), c)


def colour(mean: Column) -> Column:
    """The colour band of a mean rating; bands hold their lower end."""
    return F.when(mean < 2.2, "red").when(mean < 2.6, "orange").when(mean < 3.0, "blue").otherwise("green")


def theme_nature(theme: Column, rank: Column, mean: Column, bad: Column, gap: Column, recovered: Column, rules: RuleSet = DEFAULT) -> Column:
    """What a theme means for the product (rule nature_v1, ours; first match wins): launched and better since; a verified gap
    that leads the table; a matter of trust with mostly bad ratings; a mean below 2.2; good ratings alone (mean of 4 and
    more); good where others lack it; else debt of the basics. gap: absent, partial, entry or null; recovered: boolean."""
    lacking = F.coalesce(gap, F.lit("")).isin("absent", "partial")
    return (
        F.when(F.coalesce(recovered, F.lit(False)), NATURES[4])
        .when(lacking & (rank == 1), NATURES[0])
        .when(has(blank(theme), rules.trust) & (bad >= 0.5), NATURES[2])
        .when(mean < 2.2, NATURES[1])
        .when((mean >= 4) & (gap == "ahead"), NATURES[6])
        .when(mean >= 4, NATURES[5])
        .otherwise(NATURES[3])
    )
