"""Quirks and decision tables, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.operators import inventory, issues, metrics, releases, reviews, tagging, threads
from plumbline.sources import readers, sinks
from plumbline.streaming import incremental


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "sentiment", "confidence"),
    [
        ("不喜欢这个", "混合", "高"),
        ("不满意", "正向", "高"),
        ("无广告", "混合", "高"),
        ("闪退", "负向", "高"),
        ("没有歌词", "负向", "高"),
        ("希望适配一下", "负向", "中"),
        ("哪个版本", "中性", "高"),
        ("换回旧的", "中性", "高"),
        ("😍", "正向", "中"),
        ("🙄", "负向", "中"),
        ("嗯", "待语境", "低"),
        ("回复 某人：好看", "正向", "高"),
        ("", "待语境", "低"),
        (None, "待语境", "低"),
    ],
)
def test_direct(spark, text, sentiment, confidence):
    got = one(spark, text, R.direct_classify)
    assert (got["sentiment"], got["confidence"]) == (sentiment, confidence)


@pytest.mark.parametrize(
    ("text", "root", "stance", "is_root", "want"),
    [
        ("是的", None, "正向", True, "正向"),
        ("！！！", None, "负向", True, "负向"),
        ("是的", None, "", True, "待语境"),
        ("确实", "负向", "", False, "负向"),
        ("对，", "中性", "", False, "中性"),
        ("明明可以了", "负向", "", False, "正向"),
        ("哪有", "正向", "", False, "负向"),
        ("谢谢", "负向", "", False, "正向"),
        ("？？", "正向", "", False, "正向"),
        ("？？", None, "", False, "待语境"),
        ("中文而已", "正向", "", False, "待语境"),
    ],
)
def test_context(spark, text, root, stance, is_root, want):
    df = spark.createDataFrame([(text, root, stance)], "t string, root string, stance string")
    got = df.select(R.contextualize(F.col("t"), R.direct_classify(F.col("t")), F.col("root"), F.col("stance"), F.lit(is_root))).first()[0]
    assert got["sentiment"] == want


@pytest.mark.parametrize(("shown", "day", "time"), [("3分钟前 | a", "2026-06-15", ""), ("昨天 08:30 | x", "2026-06-14", "08:30"), ("前天", "2026-06-13", ""), ("2025/2/30", None, ""), ("5月7日", "2026-05-07", ""), ("12/31", "2025-12-31", ""), ("6/30", "2026-06-30", ""), ("2024.1.2 9:05", "2024-01-02", "9:05"), ("", None, ""), (None, None, "")])
def test_displayed_date(spark, shown, day, time):
    df = spark.createDataFrame([(shown,)], "t string")
    got = df.select(*X.displayed_date(F.col("t"), F.lit("2026-06-15").cast("date"))).first()
    assert (got[0] and got[0].isoformat(), got[1]) == (day, time)


@pytest.mark.parametrize(("shown", "n"), [("1.2万", 12000), ("3k", 3000), ("1,234", 1234), ("赞", 0), ("", 0), (None, 0), ("2.5 千", 2500)])
def test_parse_count(spark, shown, n):
    assert one(spark, shown, X.parse_count) == n


def test_text(spark):
    assert one(spark, "a　\u001c b \n", X.clean) == "a b"
    assert one(spark, "Ａ１", X.nfkc) == "A1"
    assert one(spark, "é", X.nfc_key) == "é"
    assert one(spark, "你好吗呢".encode().decode("gbk"), X.repair_mojibake) == "你好吗呢"
    assert one(spark, "plain", X.repair_mojibake) == "plain"
    assert one(spark, "4.9", X.star) == 4 and one(spark, "x", X.star) is None
    got = spark.createDataFrame([("5月1日 | 北京 | Mate 60 | Pro",)], "t string").select(*X.post_info(F.col("t"))).first()
    assert tuple(got) == ("5月1日", "北京", "Mate 60 | Pro")
    assert one(spark, "a|b\nc", X.markdown_cell) == "a\\|b<br>c"
    assert one(spark, "MatePad Pro", lambda c: R.device_series(c)["series"]) == "平板系列"
    assert one(spark, "Mate X5", lambda c: R.device_series(c)["series"]) == "MateX折叠屏"
    assert one(spark, "Mate 60", lambda c: R.device_series(c)["series"]) == "Mate直板机"


def test_diff_type(spark):
    cases = [("未检查", "明确缺失", "待核验"), ("明确缺失", "明确缺失", "双方均明确缺失"), ("明确缺失", "部分可用", "A明确缺失"), ("仅入口存在", "明确缺失", "B明确缺失"), ("已验证存在", "已验证存在", "能力对齐"), ("已验证存在", "部分可用", "完整度差异"), ("?", "已验证存在", "待核验")]
    df = spark.createDataFrame(cases, "l string, r string, want string")
    assert df.where(R.diff_type(F.col("l"), F.col("r"), "A", "B") != F.col("want")).isEmpty()


def test_thread_label(spark):
    cases = [(0, 0, 0, "中性/未判定"), (1, 0, 0, "正向"), (0, 3, 0, "负向"), (3, 1, 0, "正向为主"), (1, 3, 0, "负向为主"), (1, 1, 0, "正负并存"), (0, 0, 2, "正负并存")]
    df = spark.createDataFrame(cases, "p int, n int, m int, want string")
    assert df.where(R.thread_label(F.col("p"), F.col("n"), F.col("m")) != F.col("want")).isEmpty()


def test_combine_is_idempotent_and_first_wins(spark):
    a = spark.createDataFrame([(0, "7", "2026-01-03", "5", "x", "r", "d", "one"), (1, "8", "2026-01-04", "4", "y", "r", "d", "two")], "row_idx long, list_pos string, published_at string, rating string, text string, region string, device string, extra string")
    b = spark.createDataFrame([(0, "9", "2026-01-03", "5", "x", "r", "d")], "row_idx long, list_pos string, published_at string, rating string, text string, region string, device string")
    rows = {(r["seq"], r["text"], r["extra"], r["list_pos"]) for r in reviews.combine(a, b).collect()}
    assert rows == {(1, "y", "two", "8"), (2, "x", "one", "7")}
    assert {(r["seq"], r["text"]) for r in reviews.combine(a, a, b).repartition(3).collect()} == {(1, "y"), (2, "x")}


def test_upsert(spark):
    df = spark.createDataFrame([(1, 1, "5", "abc"), (1, 2, "", "abd"), (1, 3, "4", "z"), (2, 1, None, None)], "idx int, seq int, stars string, text string")
    assert {tuple(r) for r in reviews.upsert(df, "idx", "seq", ["stars"], "text").collect()} == {(1, "4", "abd"), (2, "", "")}


def test_releases(spark, tmp_path):
    path = tmp_path / "updates.json"
    path.write_text('{"updates": [{"应用": "A", "渠道": "测试", "时间": "2026-01-02 ~ 2026-01-09", "版本号": "1"}, 5, {"app_name": "B", "release_channel": "怪", "published_at": "2026-13-01"}]}', encoding="utf-8")
    rows = readers.update_records(spark, str(path), source="web")
    first = rows.orderBy("row_idx").first()
    assert (first["app_name"], first["release_channel"], first["test_start"], first["test_end"], first["source"]) == ("A", "测试计划", "2026-01-02", "2026-01-09", "web")
    found = {(r["code"], r["field"]) for r in releases.validate(rows).collect()}
    assert found == {("required", "version|update_text|test"), ("vocabulary", "release_channel"), ("invalid_date", "published_at")}
    assert "Unsupported channel" in sinks.release_timeline(releases.timeline(rows))
    late = spark.createDataFrame([(0, "a", "b")], "row_idx long, `版本` string, `版本号` string")
    assert releases.canonical(late).first()["version"] == "b"
    blank = spark.createDataFrame([(0, "a", "")], "row_idx long, `版本` string, `版本号` string")
    assert releases.canonical(blank).first()["version"] == "" and releases.canonical(blank, non_blank_wins=True).first()["version"] == "a"


def test_inventory_legacy(spark, tmp_path):
    header = ["应用", "模块", "一级功能", "二级功能", "三级功能", "四级功能", "五级功能", "六级功能", "验证状态", "证据文件", "备注"]
    repaired = lambda cells: readers.repaired(spark.createDataFrame([(cells,)], "cells array<string>"), header).first()["cells"]
    assert repaired(["a", "m", "x", "y", "页面已验证", "f.png", "n1", "n2"]) == ["a", "m", "x", "y", "", "", "", "", "页面已验证", "f.png", "n1；n2"]
    assert repaired(["a", "m", "1", "2", "3", "4", "5", "6", "7", "缺失"])[7:9] == ["6 / 7", "缺失"]
    assert repaired(["a"]) == ["a"] + [""] * 10
    assert repaired(["a", "m", "1", "", "3", "", "5", "6", "7", "缺失"])[2:9] == ["1", "", "3", "5", "6", "7", "缺失"]
    path = tmp_path / "i.csv"
    path.write_text("﻿" + ",".join(header) + "\na,m,x,y,页面已验证,f.png,n\n\n", encoding="utf-8")
    rows = inventory.keyed(readers.inventory(spark, str(path)))
    assert [(r["key"], r["path"], r["status"], r["evidence"]) for r in rows.orderBy("row_idx").collect()] == [("xy", "x > y", "已验证存在", "f.png"), ("", "", "", "")]
    assert [(r["row_no"], r["code"]) for r in inventory.validate(rows).collect()] == [(3, "missing_key")]


def test_threads(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text('{"items": [{"id": "p1", "title": "t", "stance": "正向", "comments": [{"id": "c1", "text": "闪退", "likes": "1.2万", "replies": [{"id": "c2", "content": "确实"}, {"id": "c3", "text": ""}]}, {"id": "c4", "text": "同感", "is_reply": true}, {"id": "c1", "text": "again"}, {"text": "", "image_urls": ["u"]}]}, 3]}', encoding="utf-8")
    rows = {r["comment_id"]: r for r in threads.prepare(threads.read_posts(spark, str(path))).collect()}
    assert rows["c1"]["final_sentiment"] == "负向" and rows["c1"]["likes"] == 12000
    assert (rows["c2"]["final_sentiment"], rows["c2"]["level"], rows["c2"]["root_text"]) == ("负向", "回复1级", "闪退")
    assert rows["c4"]["thread_id"] == "c1" and rows["c4"]["final_sentiment"] == "负向"
    assert "c3" not in rows and len(rows) == 4


def test_ui_tree(spark, tmp_path):
    (tmp_path / "screen_0001.json").write_text('{"attributes": {}, "children": [{"attributes": {"key": "CommentDetailText3", "text": "好"}}, {"attributes": {"key": "CommentDetailStars3", "originalText": "5"}}]}', encoding="utf-8")
    (tmp_path / "screen_0002.json").write_text("{broken", encoding="utf-8")
    fields, corrupt = readers.screens(spark, str(tmp_path), spark.createDataFrame([("screen_0001.json", 2)], "screen string, shift int"))
    assert [(r["idx"], r["Text"], r["Stars"], r["Username"]) for r in fields.collect()] == [(5, "好", "5", "")]
    assert [r["screen"] for r in corrupt.collect()] == ["screen_0002.json"]


def test_tagging(spark):
    rows = [(0, "c", "a", "2026-01-01", "京", "Mate 60", 1, "", "闪退", ""), (1, "c", "a", "2026-01-01", "京", "Mate 60", 1, "", "闪退", ""), (2, "c", "a", None, "京", None, None, "很不错", "好用", None), (3, "c", "a", "", "", "", None, "", "x", ""), (4, "c", "a", "", "", "", 5, "", "😀！", "")]
    df = spark.createDataFrame(rows, "row_idx long, channel string, app_id string, date string, province string, device string, rating int, rating_text string, text string, source_record_id string")
    got = {r["row_idx"]: r for r in tagging.tag(df).collect()}
    assert [got[i]["invalid_reason"] for i in range(5)] == [None, "重复评论", None, "缺少评分", "无评论内容"]
    assert got[1]["duplicate_of"] == got[0]["source_record_id"] and got[2]["rating"] == 4
    assert got[0]["issue_type"] == "BUG" and got[0]["modules"] == ["体验问题"]


def test_metrics_invariants(spark):
    df = spark.createDataFrame([(i, i % 5 + 1, dt.date(2026, 1, 1 + i % 28)) for i in range(100)], "id int, rating int, d date")
    r = metrics.by_key(df.withColumn("k", F.lit(1)), "k").first()
    assert abs(r["bad"] + r["mid"] + r["good"] - 1) < 1e-12 and r["n"] == 100
    assert metrics.weekly(df).agg(F.sum("n")).first()[0] == 100


def test_many_releases_and_offsets(spark, tmp_path):
    n, start = 10_050, dt.date(1990, 1, 1)
    days = [(i, start + dt.timedelta(days=4 * i)) for i in range(n)]
    df = spark.createDataFrame([(i, f"t{i}", 1 + i % 5, d + dt.timedelta(days=k)) for i, d in days for k in (-1, 2)], "id long, theme string, rating int, d date").repartition(4)
    releases = spark.createDataFrame([(f"t{i}", f"v{i}", d) for i, d in days], "theme string, version string, release_date date")
    got = metrics.flood(df, releases.drop("theme")).collect()
    assert sorted((r["version"], r["day"], r["n"], r["mean"]) for r in got) == sorted((f"v{i}", 2, 1, float(1 + i % 5)) for i in range(n))
    few = releases.drop("theme").where(F.col("release_date") < dt.date(1991, 1, 1))
    assert sorted(metrics.flood(df, few).collect()) == sorted(r for r in got if start + dt.timedelta(days=4 * int(r["version"][1:])) < dt.date(1991, 1, 1))
    assert metrics.reversal(df, releases.drop("version")).where("n_before = 1 and n_after = 1").count() == n
    (tmp_path / "screen_last.json").write_text('{"attributes": {}, "children": [{"attributes": {"key": "CommentDetailText3", "text": "好"}}]}', encoding="utf-8")
    offsets = spark.range(100_050).select(F.when(F.col("id") == 100_049, "screen_last.json").otherwise(F.concat(F.lit("s"), "id")).alias("screen"), F.lit(2).alias("shift"))
    assert readers.screens(spark, str(tmp_path), offsets)[0].first()["idx"] == 5


def test_stream_upsert(spark, tmp_path):
    schema = "idx int, seq int, Username string, Stars string, StarMessage string, Text string, PostInfo string"
    target, source = str(tmp_path / "log"), str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "u", "5", "", "long text", "today")], schema).write.parquet(source)
    incremental.collect_screens(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "cp"), align=False).awaitTermination()
    spark.createDataFrame([(1, 1, "u", "4", "", "", "today")], schema).write.mode("append").parquet(source)
    incremental.collect_screens(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "cp"), align=False).awaitTermination()
    r = incremental.current(spark, target).first()
    assert (r["Stars"], r["Text"]) == ("4", "long text")
    with pytest.raises(ValueError, match="overlaps nothing"):
        incremental.merge_batch(spark.createDataFrame([(9, 1, "u", "1", "", "other", "elsewhere")], schema), 9, target)


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a|b", ["x", "y"])], "n int, t string, l array<string>")
    assert sinks.csv_text(df) == '﻿n,t,l\r\n1,a|b,"x,y"\r\n'
    assert "a\\|b" in sinks.markdown_table(df.select("n", "t"))
    with pytest.raises(ValueError, match="at most"):
        sinks.csv_text(spark.range(5), most=4)
    claims = spark.createDataFrame([("c", "Trend", "m")], "claim string, section string, metric string")
    matrix = sinks.evidence_matrix(claims, spark.createDataFrame([], "metric string, value double, source string"))
    with pytest.raises(ValueError, match="without evidence"):
        sinks.satisfaction_report(matrix, spark.createDataFrame([], "rule_version string"))


def test_stream_alignment_progress_and_gaps(spark, tmp_path):
    schema = "idx int, seq int, Username string, Stars string, StarMessage string, Text string, PostInfo string"
    target = str(tmp_path / "t")
    row = lambda i, at, info: (i, at, "u", "5", "", f"text {info}", f"2026-01-0{info} | x | y")
    incremental.merge_batch(spark.createDataFrame([row(1, 1, 1), row(2, 2, 2)], schema), 0, target, bound="2026-02-01")
    incremental.merge_batch(spark.createDataFrame([row(0, 1, 2), row(4, 2, 6)], schema), 1, target, bound="2026-02-01")
    assert {r["idx"] for r in incremental.current(spark, target).collect()} == {1, 2, 6}
    notes = incremental.progress(spark, target).orderBy("screen").collect()
    assert [(n["screen"], n["records"], n["shift"], str(n["newest_date"])) for n in notes] == [(0, 2, 0, "2026-01-02"), (1, 2, 2, "2026-01-06")]
    assert incremental.should_stop(incremental.progress(spark, target), F.lit("2026-01-07").cast("date"), 99)
    assert not incremental.should_stop(incremental.progress(spark, target), F.lit("2026-01-01").cast("date"), 99)
    before, after = incremental.fill_gaps(spark, target, spark.createDataFrame([row(2, 1, 2), row(3, 2, 3), row(4, 3, 4)], schema), 2)
    assert [tuple(r) for r in before.collect()] == [("all", 3, [3, 4, 5])] and [tuple(r) for r in after.collect()] == [("all", 1, [5])]
    whole = sorted(incremental.current(spark, target).collect())
    incremental.compact(spark, target, 1)
    assert sorted(incremental.current(spark, target).collect()) == whole
    source, stream = str(tmp_path / "in"), lambda: spark.readStream.schema(schema).parquet(source)
    run = lambda: incremental.collect_screens(stream(), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([row(1, 1, 1)], schema).write.parquet(source)
    run()
    spark.createDataFrame([(9, 1, "u", "1", "", "other", "elsewhere")], schema).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="overlaps nothing"):
        run()


def test_reasons_and_summary(spark, tmp_path):
    path = tmp_path / "posts.json"
    path.write_text('[{"id": "p1", "title": "t", "stance": "正向", "expected_comments": 9, "comments": [{"id": "c1", "text": "闪退", "likes": 3, "replies": [{"id": "c2", "content": "确实"}]}, {"id": "c4", "text": "同感"}, {"id": "c5", "text": "嗯嗯啊"}]}]', encoding="utf-8")
    rows = threads.prepare(threads.read_posts(spark, str(path)))
    assert set(threads.COLUMNS) <= set(rows.columns) and len(threads.COLUMNS) == 27
    reason = {r["comment_id"]: r["reason"] for r in rows.collect()}
    assert reason["c2"] == "简短赞同表达继承根评论的负向立场" and reason["c4"] == "简短赞同表达结合帖子正向立场判断"
    parts = threads.summarize(rows)
    t = parts["totals"].first()
    assert (t["comments"], t["negative"], t["positive"], t["undecided"], t["unresolved"], t["needs_review"], t["likes_negative"], t["ratio"], t["expected_comments"]) == (4, 2, 1, 1, 1, 1, 3, 0.5, 9)
    report = sinks.sentiment_report(parts)
    assert "66.7%" in report and "## Limits" in report
    with pytest.raises(ValueError, match="vocabulary final_sentiment"):
        threads.summarize(rows.withColumn("final_sentiment", F.lit("?")))


def test_whole_files(spark, tmp_path):
    df = spark.createDataFrame([(0, "é", "a,\"b\"\nc"), (1, "", "x")], "row_idx long, k string, v string")
    (tmp_path / "a.csv").write_text(sinks.csv_text(df, ["k", "v"]), encoding="utf-8", newline="")
    assert sorted(map(tuple, readers.csv_table(spark, str(tmp_path / "a.csv")).collect())) == sorted(map(tuple, df.collect()))
    assert readers.csv_table(spark, str(tmp_path / "a.csv"), cleaned=True).where("v = 'a,\"b\" c'").count() == 1
    header = ["序号"]
    assert readers.template(spark, header).columns == header


def test_record_ids_and_dates(spark):
    one = spark.createDataFrame([("e\u0301 x", "\u00e9  x")], "a string, b string")
    assert one.select(X.source_record_id(F.lit(None), F.col("a")) == X.source_record_id(F.lit(""), F.col("b"))).first()[0]
    dates = ["2024-01-01", "2024-01-01T10:00", "2024-01-01 23:59:59Z", "2024-01-01T10:00:00.5+08:00", "2024-01-01Tgarbage", "2024-01-01T25:00", "2024-13-01", "2024-01-01 10:61"]
    got = spark.createDataFrame([(d,) for d in dates], "d string").select("d", X.iso_date(F.col("d")).alias("x")).collect()
    assert [r["x"] is not None for r in got] == [True] * 4 + [False] * 4
    fold = spark.createDataFrame([("Straße", "STRASSE")], "a string, b string").select(X.casefold(F.col("a")) == X.casefold(F.col("b"))).first()[0]
    assert fold


def test_wide_prefilter_changes_nothing(spark):
    texts = ["好看 BUG", "bug", "Bug 故障", "", "Spotify é", "鸿蒙很好", "没有功能", "能不能 加 歌词", "plain text", "ＢＵＧ", "网易云", "x" * 90 + " 希望 " + "y" * 15 + "支持" + "z" * 200 + "闪退", "希望" + "y" * 21 + "加", "没有" + "a" * 70 + "功能", "w" * 64 + "好看"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", R.wide_only(F.col("t")))
    patterns = [R.POSITIVE, R.NEGATIVE, R.FEATURE_GAP, R.SOLUTION, R.TRUST, R.QUESTION, *(p for _, p in R.ISSUE_TYPES), *(p for p, _ in R.COMPETITORS), *R.TOPICS.values()]
    for p in patterns:
        assert df.where(R.has(F.col("t"), p) != R.has(F.col("t"), p, F.col("w"))).isEmpty(), p
    assert R.needs_wide("希望.{0,20}(加|上)") and not R.needs_wide("(加|x)") and not R.needs_wide("a好?") and not R.needs_wide("[好]")


def test_standard_fields_and_report(spark, tmp_path):
    df = spark.createDataFrame([(0, "2026-01-02 10:00", "", "Mate 60", "非常差", "小明", "1", "闪退 网易云", 7)], "row_idx long, `发布时间` string, `地区` string, `设备` string, `评分描述` string, `用户` string, `评分` string, `评论内容` string, `列表位置` int")
    row = tagging.tag(tagging.standard_fields(df)).first()
    assert (row["date"], row["province"], row["rating"], row["competitor"], row["列表位置"], row["channel"]) == ("2026-01-02", "未知", 1, "网易云音乐", 7, "未知")
    assert "用户" not in row.asDict() and "小明" not in map(str, row)
    tagged = tagging.tag(tagging.standard_fields(df))
    sinks.tagged(tagged, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/jsonl")).count() == 1
    assert next((tmp_path / "out/csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert "valid: 1" in sinks.tagging_summary(tagged, R.DEFAULT, tagging.IDENTITY, ["列表位置"])
    assert issues.tagging_gates(tagged, R.DEFAULT).where("not passed").isEmpty()
    empty = spark.createDataFrame([], "claim string, section string, metric string, value double, source string, resolved boolean")
    first = metrics.priority(spark.createDataFrame([("t", 3, 2.0, 0.5, "absent", "core", "2w", False)], "theme string, mentions long, mean double, bad double, gap_status string, audience_class string, feasibility string, risk_override boolean"))
    road = spark.createDataFrame([("immediate", "g", "a", "e")], "stage string, goal string, action string, expected string")
    report = sinks.satisfaction_report(empty, first, road, method=["m"])
    quotes = spark.createDataFrame([("sha256:1",)], "source_record_id string")
    assert sinks.report_checks(report, empty, first, quotes).where("not passed").isEmpty()
    with pytest.raises(ValueError, match="stages"):
        sinks.satisfaction_report(empty, first, road.withColumn("stage", F.lit("never")))
    names = sinks.analysis_folder(spark, str(tmp_path / "an"), dict.fromkeys(sinks.TABLES, road), road, ["f"], spark.createDataFrame([("c", True, "0")], "check string, passed boolean, detail string"))
    assert all((tmp_path / "an" / n).exists() for n in names) and len(names) == 3 + len(sinks.TABLES)


def test_inventory_refuses_errors_and_feeds_priorities(spark):
    table = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, `模块` string, `一级功能` string, `标准功能ID` string, `验证状态` string, `证据文件` string")
    a = table([("m", "x", "f1", "明确缺失", ""), ("m", "y", "f2", "仅入口存在", "e")])
    b = table([("m", "x", "f1", "已验证存在", "e"), ("m", "y", "f2", "已验证存在", "e")])
    matrix = inventory.compare_tables(a, b)
    assert {tuple(r) for r in inventory.gap_status(matrix).collect()} == {("f1", "absent"), ("f2", "entry")}
    themes = spark.createDataFrame([("t1", "f1"), ("t2", None)], "theme string, feature_id string")
    assert {(r["theme"], r["gap_status"]) for r in inventory.themes_with_gaps(themes, matrix).collect()} == {("t1", "absent"), ("t2", None)}
    with pytest.raises(ValueError, match="errors"):
        inventory.compare_tables(a, table([("m", "x", "f1", "不明", "")]))
    assert inventory.status_histogram(inventory.keyed(a)).count() == 2


def test_page_envelope(spark):
    seen = [(1, "c1", True, "a"), (2, "c2", False, "b"), (3, "c1", True, "a2"), (4, "c3", True, "c"), (5, "c4", False, "d")]
    df = spark.createDataFrame(seen, "at long, id string, root boolean, text string")
    found = threads.dom_comments(df, "id", "at", ["text"], "root")
    post = threads.envelope({"id": "p", "expected_comments": 9}, found, {"text": "text"})
    assert post["collected_comments"] == 4 and post["collection_status"] == "部分"
    assert [(c["comment_id"], c["text"], [r["comment_id"] for r in c["replies"]]) for c in post["comments"]] == [("c1", "a2", ["c2"]), ("c3", "c", ["c4"])]


def test_gaps_in_stretches(spark):
    have = [1, 2, 5, 9, 10, 11, 30, 31, 64, 100]
    df = spark.createDataFrame([("a", p) for p in have * 2] + [("b", 4), ("b", 5), ("c", None)], "g string, p long")
    missing = [p for p in range(1, 101) if p not in have]
    for stretch in (1, 7, 10, 1 << 20):
        got = reviews.position_gaps(df, ["g"], "p", 30, stretch).collect()
        assert [(r["g"], r["gap_count"], r["first_gaps"]) for r in got] == [("a", len(missing), missing[:30])]
