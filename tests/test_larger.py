"""Queries under limits that larger tables meet: rows of a recursion, rows of a task, what a task of Python holds."""

import csv
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.functions import text
from plumbline.operators import metrics, releases, reviews
from plumbline.plans import catalogue
from plumbline.sources import readers, sinks, steps

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def few_nodes(spark):
    """The session's limit of a recursion's rows, here far under the nodes of the small tables."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_ui_tree_fields_of_any_number_of_nodes(spark, few_nodes):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id % 6").distinct().count()
    assert __spark_entry__.queries()["ui_tree_fields"](spark, SF).count() == events


def test_nested_flatten_of_any_number_of_comments(spark, few_nodes):
    assert __spark_entry__.queries()["nested_flatten"](spark, SF).count() > 50


def test_visible_text_of_any_number_of_nodes(spark, few_nodes):
    shown = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "props").distinct().count()
    assert __spark_entry__.queries()["visible_text"](spark, SF).count() == shown


def test_stream_replayed_of_any_number_of_nodes(spark, few_nodes):
    assert __spark_entry__.queries()["stream_replayed"](spark, SF).count() > 50


def test_dealt_grows_with_the_files(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert steps.dealt(lines, "l_orderkey").rdd.getNumPartitions() == 4
    many = steps.dealt(lines.where("l_quantity > 3").select("l_orderkey"), "l_orderkey", share=1000)
    assert many.rdd.getNumPartitions() > 20
    assert _rows(many.distinct()) == _rows(lines.where("l_quantity > 3").select("l_orderkey").distinct())


def test_themes_are_dealt_out_by_number(spark):
    plan = catalogue.themed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_first_wins_is_dealt_out_by_number(spark):
    rows = spark.createDataFrame([(0, "a", None), (1, "a", ""), (2, "b", "")], "row_idx long, x string, y string")
    first = reviews.first_wins(rows, ["x", "y"])
    assert "REPARTITION_BY_NUM" in first._jdf.queryExecution().executedPlan().toString()
    assert first.columns == rows.columns and sorted(r["row_idx"] for r in first.collect()) == [0, 2]


def test_normalized_releases_are_stored_once(spark):
    source = spark.createDataFrame([(0, "app", "1")], "row_idx long, app_name string, version string")
    rows, _ = releases.normalize(source)
    assert rows.inputFiles() and rows.count() == 1


def _csv_rows(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return [[unicodedata.normalize("NFKC", c).strip() for c in row] for row in csv.reader(f)]


def test_inventory_is_read_in_splits(spark, tmp_path):
    """Quoted cells with commas, quotes and breaks of all kinds, also over the ends of splits, are as Python's reader has them."""
    draw = random.Random(7)
    parts = ["a", "Ｂ", '"', '""', ",", "\n", "\r\n", "\r", '"x\ny"', '"p,""q"', "\n\n", "长长的字", " "]
    path = tmp_path / "odd.csv"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for k in range(4):
            content = "﻿" * (k % 2) + "".join(draw.choices(parts, k=150)) + "\n" * (k % 3)
            path.write_text(content, encoding="utf-8", newline="")
            rows = sorted(readers._cells(readers._blocks(spark, str(path))).select("row", "cells").collect())
            assert [r["cells"] for r in rows] == _csv_rows(path), (k, content)
            assert [r["row"] for r in rows] == list(range(len(rows)))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        path.write_text('一级功能,x\n"a\nb",c\n' + "a,b\n" * 300 + '"a\n' + "b,c\n" * 50 + '"\n' + "c,d\n" * 50, encoding="utf-8")
        rows = sorted(readers._cells(readers._blocks(spark, str(path))).select("row", "cells").collect())
        assert [r["cells"] for r in rows] == _csv_rows(path) and [r["row"] for r in rows] == list(range(len(rows)))
        got = readers.inventory(spark, str(path))
        assert "BinaryFile" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == len(rows) - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mojibake_goes_to_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(None,), ("",), ("plain ",), ("你好吗呢".encode().decode("gbk"),)], "text string")
    assert [r[0] for r in docs.select(text.repair_mojibake(F.col("text"))).collect()] == ["", "", "plain", "你好吗呢"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_audit_moves_each_row_once(spark):
    rows = [("a", 1, "x", 1, "2001-01-01"), ("a", 1, "x", 1, "2001-01-02"), ("a", 1, "y", 1, None), ("a", 70_000, "", None, "2001-01-03"), ("a", None, "z", 2, None), ("a", None, "z", 2, None), ("b", None, None, None, None), (None, 5, "", 0, None), (None, 7, None, 0, None), (None, 7, "", 0, None)]
    df = spark.createDataFrame(rows, "g string, p long, t string, r int, d string")
    got = reviews.audit(df, ["g"], ["p", "t", "r"], "d", "p", "t", "r")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("REPARTITION_BY_NUM") == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 6, "2001-01-01", "2001-01-03", 2, 69_998, 1, 1), ("b", 1, None, None, 0, 0, 1, 1), (None, 3, None, None, 1, 1, 3, 0)], key=str)
    assert got.schema["gap_count"].dataType.simpleString() == "bigint" == got.schema["duplicate_rows"].dataType.simpleString()
    assert reviews.audit(df.where("false"), ["g"], ["p", "t", "r"], "d", "p", "t", "r").count() == 0


def test_analysis_files_computes_each_table_once(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(sinks, "analysis_folder", lambda spark, folder, tables, *rest: given.update(tables, checks=rest[-1]))
    monkeypatch.setattr(readers, "csv_table", lambda spark, path: spark.createDataFrame([], "rank string, theme string, mentions string"))
    __spark_entry__.queries()["analysis_files"](spark, SF)
    assert set(sinks.TABLES) < set(given)
    shared = spark.conf.get("spark.checkpoint.dir")
    assert [name for name, table in given.items() if not all(shared in f for f in table.inputFiles())] == []


def test_joins_of_large_sides_are_dealt_out_by_number(spark):
    few = _rows(catalogue.themed(spark, SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalogue.themed(spark, SF)
        plan = found._jdf.queryExecution().executedPlan().toString()
        devices = catalogue.with_device(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == devices.count("REPARTITION_BY_NUM") == 4
        assert _rows(found) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _theme_tables(spark, monkeypatch, name):
    """How often a query has its themes ranked, and whether what its gates or texts read of them is stored."""
    made, read, ranked, scored = [], [], metrics.themes, metrics.priority
    monkeypatch.setattr(metrics, "themes", lambda df, *rest: made.append(df) or ranked(df, *rest))
    monkeypatch.setattr(metrics, "priority", lambda df, *rest: read.append(df) or scored(df, *rest))
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
    shared = spark.conf.get("spark.checkpoint.dir")
    return len(made), [any(shared in f for f in df.inputFiles()) for df in read]


def test_report_gates_ranks_themes_once(spark, monkeypatch):
    assert _theme_tables(spark, monkeypatch, "report_gates") == (1, [True])


def test_satisfaction_text_ranks_themes_once(spark, monkeypatch):
    assert _theme_tables(spark, monkeypatch, "satisfaction_text") == (1, [True])
