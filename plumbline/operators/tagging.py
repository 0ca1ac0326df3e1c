"""Deterministic tagging of reviews by a frozen rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import DEFAULT, HEATED, POSITIVE, QUESTION, RATING_TEXT, STANDARD_FIELDS, URGENT, RuleSet, device_series, first_match, has, matches, wide_only
from plumbline.functions.text import blank, clean, source_record_id

IDENTITY = ("channel", "app_id", "date", "rating", "text", "province", "device")


def rating(r: Column, text: Column) -> Column:
    """The rating, else what its wording stands for, else null."""
    wording = F.try_element_at(F.create_map(*(F.lit(x) for kv in RATING_TEXT.items() for x in kv)), blank(text))
    return F.coalesce(r.cast("int"), wording)


#: Columns of collected reviews under the names that tagging reads, by way of the standard fields.
_READ_AS = {"渠道": "channel", "应用标识": "app_id", "平台": "platform", "日期": "date", "省份": "province", "机型": "device", "评分": "rating", "评分文字": "rating_text", "评论内容": "text"}
_READ_AS |= {"published_at": "date", "region": "province"}


def standard_fields(df: DataFrame) -> DataFrame:
    """Collected reviews with the columns that tag() reads: store columns by the standard mapping, then the names used here.
    Dates are cut to the day, missing provinces, channels, apps and platforms are 未知, the user name goes. All other columns
    (evidence: list position, displayed and collection time, source file and row) stay."""
    names: dict[str, str] = {}
    for c in df.columns:
        name = STANDARD_FIELDS.get(c, c)
        if name != "用户名" and c not in ("user", "user_name"):
            names.setdefault(_READ_AS.get(name, name), c)
    out = df.select(*(F.col(f"`{c}`").alias(name) for name, c in names.items()))
    known = lambda c: F.when(blank(F.col(c)) == "", "未知").otherwise(F.col(c)) if c in names else F.lit("未知")
    given = lambda c, kind: F.col(c) if c in names else F.lit(None).cast(kind)
    filled = {c: known(c) for c in ("channel", "app_id", "platform", "province")} | {c: given(c, "string") for c in ("date", "device", "rating_text", "text", "source_record_id")}
    return out.withColumns(filled | {"rating": given("rating", "int").try_cast("int"), "date": F.substring(given("date", "string"), 1, 10)})


def tag(df: DataFrame, rules: RuleSet = DEFAULT, spam: Column | None = None) -> DataFrame:
    """df(row_idx, channel, app_id, date, province, device, rating, rating_text, text, source_record_id) with labels.

    Invalid rows have the first reason that holds: no rating, no content (empty or signs only), repeated (duplicate_of
    names the first), spam (the given predicate; none by default). User names take no part. Null and empty are one.
    Columns that only a person or a language model can fill (core_ask, pm_action) are null. Texts are labelled where they
    lie; only record ids and row numbers are sorted to find repeats.
    """
    stars = rating(F.col("rating"), F.col("rating_text"))
    rows = df.withColumn("rating", F.when(stars.between(1, 5), stars)).withColumn("source_record_id", source_record_id(F.col("source_record_id"), *(F.col(c) for c in IDENTITY)))
    rows = rows.withColumn("_t", clean(F.col("text")))
    rows = rows.withColumn("_w", wide_only(F.col("_t")))
    t, w = F.col("_t"), F.col("_w")
    found = lambda p: has(t, p, w)
    heated, good, bad = found(HEATED), found(POSITIVE), F.col("rating") <= 2
    emotion = F.when(heated, -2).when(good & ~bad, F.when(F.col("rating") == 5, 2).otherwise(1)).when(bad, -1).otherwise(0)
    expression = F.when(found(QUESTION), "求助提问").when(found("希望|建议|什么时候"), "功能许愿").when(found("比|不如"), "对比抱怨").when(heated, "情绪宣泄").when(found("哈哈|笑死"), "调侃玩梗").otherwise("理性评价")
    urgency = F.when(found(URGENT), "高").when(bad, "中").otherwise("低")
    device = device_series(F.col("device"), rules)
    early = F.when(F.col("rating").isNull(), "缺少评分").when(t.rlike(r"(?U)^[\W_]*\z"), "无评论内容")
    labelled = rows.withColumns(
        {
            "_early": early,
            "_spam": F.lit(False) if spam is None else spam,
            "device_series": device["series"],
            "device_keyword": device["keyword"],
            "modules": matches(t, rules.modules, "其他", w),
            "issue_type": first_match(t, tuple((p, n) for n, p in rules.issue_types), "吐槽抱怨", w),
            "competitor": F.nullif(first_match(t, rules.competitors, "", w), F.lit("")),
            "emotion": emotion,
            "urgency": urgency,
            "expression": expression,
            "taxonomy_version": F.lit(f"{rules.name}-{rules.version}"),
            "core_ask": F.lit(None).cast("string"),
            "pm_action": F.lit(None).cast("string"),
            "evidence_excerpt": F.substring(t, 1, 40),
        }
    ).drop("_t", "_w")
    ids = rows.select("source_record_id", "row_idx")
    firsts = ids.groupBy("source_record_id").agg(F.min("row_idx").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = labelled.join(firsts, "source_record_id", "left")
    again = F.when(F.col("row_idx") > F.col("_first"), F.col("source_record_id"))
    out = joined.withColumn("duplicate_of", again)
    reason = F.coalesce("_early", F.when(F.col("duplicate_of").isNotNull(), "重复评论").when(F.col("_spam"), "广告垃圾"))
    columns = [*df.columns, *(c for c in ("source_record_id",) if c not in df.columns)]
    added = [c for c in labelled.columns if c not in columns and not c.startswith("_")]
    return out.withColumn("invalid_reason", reason).select(*columns, "duplicate_of", "invalid_reason", F.col("invalid_reason").isNull().alias("is_valid"), *added)


def qa_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """About `percent` of 100 rows, the same on every run and in every engine: by the first 8 hex digits of the key's
    SHA-256, modulo 100."""
    number = F.conv(F.substring(F.sha2(blank(F.col(key)).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return df.where(number % 100 < percent)


def qa_result(sample: DataFrame, checked: DataFrame, key: str, fields: list[str], most: float = 0.10) -> DataFrame:
    """(field, checked, wrong, error_rate, redo): how often a person's labels (checked, by key) differ from the sample's;
    fields wrong in more than `most` of the checked rows are to be labelled anew. Rows not checked do not count."""
    pairs = sample.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).join(checked.select(key, *(F.col(f).cast("string").alias(f"_{f}") for f in fields)), key)
    flags = F.array(*(F.struct(F.lit(f).alias("field"), (~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias("bad")) for f in fields))
    each = pairs.select(F.explode(flags).alias("x")).groupBy("x.field").agg(F.count("*").alias("checked"), F.count_if("x.bad").alias("wrong"))
    return each.withColumn("error_rate", F.col("wrong") / F.col("checked")).withColumn("redo", F.col("error_rate") > most)


def pii_flags(c: Column) -> Column:
    """struct of flags: an e-mail form, a path of a home folder, a word that announces a secret. A hit needs a person."""
    t = blank(c)
    return F.struct(t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]").alias("email"), t.rlike(r"(?:/home/|/Users/|[A-Z]:\\Users\\)").alias("path"), t.rlike(r"(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[:=]").alias("secret"))
