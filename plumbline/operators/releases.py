"""Release records: canonical columns, de-duplication, validation, timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import lookup
from plumbline.functions.text import blank, casefold, clean, iso_date
from plumbline.operators.issues import issue, report
from plumbline.sources.steps import once

# Fixed values.
FIELDS = ["app_name", "package_name", "platform", "release_channel", "version", "version_code", "published_at", "test_start", "test_end", "update_text", "source_type", "source", "collected_at", "evidence_file", "verification_status", "notes"]
ALIASES = {
    "应用名称": "app_name",
    "应用": "app_name",
    "包名": "package_name",
    "平台": "platform",
    "渠道": "release_channel",
    "版本类型": "release_channel",
    "版本性质": "release_channel",
    "版本": "version",
    "版本号": "version",
    "版本代码": "version_code",
    "发布日期": "published_at",
    "发布时间": "published_at",
    "测试开始": "test_start",
    "测试结束": "test_end",
    "更新内容": "update_text",
    "应用市场更新说明": "update_text",
    "来源类型": "source_type",
    "来源": "source",
    "证据来源": "source",
    "采集时间": "collected_at",
    "证据文件": "evidence_file",
    "验证状态": "verification_status",
    "备注": "notes",
    "本次分析判断": "notes",
}
CHANNELS = ("正式版", "尝鲜版", "内测版", "公测版", "测试计划", "未知")
STATUSES = ("已验证", "仅页面可见", "外部佐证", "待核验")
CHANNEL_ALIASES = {"正式": "正式版", "正式版本": "正式版", "尝鲜": "尝鲜版", "测试版": "测试计划", "测试": "测试计划", "内测": "内测版", "公测": "公测版"}
IDENTITY = ("package_name", "app_name", "release_channel", "version", "published_at", "test_start", "test_end", "update_text")
# End of the fixed values.


def canonical(df: DataFrame, non_blank_wins: bool = False, **defaults: str) -> DataFrame:
    """The 16 fields from any aliased columns, plus row_idx.

    Of several source columns of one field the last that a record has (null: it has none) wins even where it is blank
    (non_blank_wins: the last that is not).
    Blank fields take the defaults. A combined 时间 column is used only if all three dates are blank: two ISO dates are a
    test window, one is the publishing date of a public release, else the start of a test.
    """
    sources: dict[str, list[str]] = {}
    for c in df.columns:
        sources.setdefault(ALIASES.get(c, c), []).append(c)

    def value(field: str):
        columns = [F.col(f"`{c}`") for c in reversed(sources.get(field, []))]
        there = [F.when(c.isNotNull(), clean(c)) for c in columns]
        return F.coalesce(*(F.nullif(c, F.lit("")) for c in there), F.lit("")) if non_blank_wins else F.coalesce(*there, F.lit(""))

    rows = df.select("row_idx", *(F.when(value(f) == "", clean(F.lit(defaults.get(f, "")))).otherwise(value(f)).alias(f) for f in FIELDS), (clean(F.col("`时间`")) if "时间" in df.columns else F.lit("")).alias("_time"))
    dates = F.regexp_extract_all("_time", F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    free = (F.col("published_at") == "") & (F.col("test_start") == "") & (F.col("test_end") == "")
    channel = lookup(F.col("release_channel"), CHANNEL_ALIASES)
    window, single = free & (F.size(dates) >= 2), free & (F.size(dates) == 1)
    d = lambda i: F.get(dates, F.lit(i))
    return rows.withColumns(
        {
            "published_at": F.when(single & (channel == "正式版"), d(0)).otherwise(F.col("published_at")),
            "test_start": F.when(window | (single & (channel != "正式版")), d(0)).otherwise(F.col("test_start")),
            "test_end": F.when(window, d(1)).otherwise(F.col("test_end")),
            "platform": F.when(F.col("platform") == "", "HarmonyOS").otherwise(F.col("platform")),
            "release_channel": F.when(F.col("release_channel") == "", "未知").otherwise(channel),
            "verification_status": F.when(F.col("verification_status") == "", "待核验").otherwise(F.col("verification_status")),
        }
    ).drop("_time")


def _identity():
    return casefold(F.concat_ws("\x1f", *(blank(F.col(c)) for c in IDENTITY)))


def _date():
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("published_at", "test_start", "test_end", "collected_at")), F.lit(""))


def timeline(df: DataFrame) -> DataFrame:
    """Unique releases, newest first: by date, version and channel down, equal ones as they came; of equal identities the
    first in that order stays. nth numbers the rows within an app (app and package name)."""
    order = [F.desc("_date"), F.desc("version"), F.desc("release_channel"), F.asc("row_idx")]
    rows = df.withColumn("_date", _date()).withColumn("_id", _identity())
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(*order))).where("_n = 1")
    nth = F.row_number().over(Window.partitionBy("app_name", "package_name").orderBy(*order))
    return first.withColumn("nth", nth).withColumnRenamed("_date", "sort_date").drop("_n", "_id")


def validate(df: DataFrame) -> DataFrame:
    """Findings of canonical rows; row numbers count the header as 1. A repeated identity names the row that has it first."""
    f = {c: F.col(c) for c in FIELDS}
    empty = lambda c: f[c] == ""
    by = Window.partitionBy("_id").orderBy("row_idx")
    rows = df.withColumn("_id", _identity()).withColumn("_again", F.row_number().over(by) > 1).withColumn("_first", F.first_value("row_idx").over(by) + 2)
    dates = [issue(~empty(c) & iso_date(f[c]).isNull(), "error", "invalid_date", c) for c in ("published_at", "test_start", "test_end", "collected_at")]
    return report(
        rows,
        F.col("row_idx") + 2,
        [
            issue(empty("app_name") & empty("package_name"), "error", "required", "app_name|package_name"),
            issue(empty("version") & empty("update_text") & empty("test_start") & empty("test_end"), "error", "required", "version|update_text|test"),
            issue(empty("source") & empty("evidence_file"), "error", "required", "source|evidence_file"),
            issue(~f["release_channel"].isin(*CHANNELS), "error", "vocabulary", "release_channel"),
            issue(~f["verification_status"].isin(*STATUSES), "error", "vocabulary", "verification_status"),
            *dates,
            issue(iso_date(f["test_end"]) < iso_date(f["test_start"]), "error", "end_before_start", "test_end"),
            issue((f["verification_status"] == "已验证") & empty("update_text"), "warning", "verified_without", "update_text"),
            issue((f["verification_status"] == "已验证") & empty("version") & (f["release_channel"] != "测试计划"), "warning", "verified_without", "version"),
            issue(F.col("_again"), "warning", "duplicate", F.concat(F.lit("row "), F.col("_first").cast("string"))),
        ],
    )


def normalize(df: DataFrame, **defaults: str) -> tuple[DataFrame, DataFrame]:
    """The unique releases of a table with any aliased columns, newest first over all apps (row_no, from 2 as in the file that
    lists them), and the findings of these rows: errors stop nothing here. Rows are numbered by date, dates by how many rows
    come before them, so no task orders all. Written once, as files and findings read them many times."""
    rows = timeline(canonical(df, **defaults))
    before = F.sum("_rows").over(Window.orderBy(F.desc("sort_date")).rowsBetween(Window.unboundedPreceding, -1))  # a row for each date
    days = rows.groupBy("sort_date").agg(F.count("*").alias("_rows")).select("sort_date", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("sort_date").orderBy(F.desc("version"), F.desc("release_channel"), "row_idx"))
    placed = rows.withColumn("_own", own).join(days, "sort_date").withColumn("row_no", (F.col("_before") + F.col("_own") + 1).cast("long")).drop("_own", "_before")
    placed = once(placed, "releases")
    return placed, validate(placed.withColumn("row_idx", F.col("row_no") - 2))


def verified(df: DataFrame) -> DataFrame:
    """Releases that may act as official events in analyses."""
    return df.where("verification_status = '已验证'")
