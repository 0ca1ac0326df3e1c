"""Steps between scans and results: even splits, tables computed once, the folder they lie in."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.operators import inventory, threads
from plumbline.sources import steps


def test_scan_of_one_file_is_dealt_out(spark, tmp_path):
    spark.range(1000).select("id", F.lit("x").alias("t"), F.lit("y").alias("u")).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = steps.evenly(spark.read.parquet(str(tmp_path / "one")))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 500
    assert sorted(r[0] for r in df.select("id").collect()) == list(range(1000))
    plan = df.where("t = 'x'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,t:string>" in plan and "EqualTo(t,x)" in plan


def test_scan_of_many_splits_stays(spark, tmp_path):
    spark.range(100).repartition(6).write.parquet(str(tmp_path / "six"))
    df = spark.read.option("parallelPartitionDiscovery.parallelism", 1).parquet(str(tmp_path / "six"))
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        assert steps.evenly(df) is df


def test_once_computes_once(spark):
    n = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        n.add(1)
        return x

    df = steps.once(spark.range(50).select(counted("id").alias("id")))
    assert df.count() == 50 and df.agg(F.sum("id")).first()[0] == 1225 and df.schema["id"].dataType.simpleString() == "bigint"
    assert n.value == 50


def test_once_of_an_empty_table(spark):
    df = steps.once(spark.createDataFrame([], "a string, b array<int>"))
    assert df.collect() == [] and df.dtypes == [("a", "string"), ("b", "array<int>")]


def test_folders_differ_and_lie_in_the_shared_one(spark):
    a, b = steps.shared_folder(spark), steps.shared_folder(spark)
    assert a != b and all(x.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.isdir(x) for x in (a, b))


def test_local_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        steps.shared_folder(Session())


def test_classify_is_direct_classify(spark):
    said = ["好看但是卡顿", "回复 小明：回复 小红：闪退", " 回复 小明：好看 ", "哪个版本", "😍", "", None, "什么时候适配歌单", "x" * 5000 + "闪退"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, text string")
    new = threads.classify(df, "text").select("i", "direct").collect()
    assert sorted(new) == sorted(df.select("i", R.direct_classify(F.col("text")).alias("direct")).collect())


def test_hierarchy_of_levels_or_path(spark):
    rows = [(0, "a", "", None, "x > y"), (1, "", " ", "", "x>y / z→ "), (2, None, "", "c", None), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_idx int, `一级功能` string, `二级功能` string, `三级功能` string, `功能路径` string").withColumns({"模块": F.lit("M 1"), "状态": F.lit("存在")})
    got = {r["row_idx"]: (r["path"], r["key"]) for r in inventory.keyed(df).collect()}
    assert got == {0: ("a", "a"), 1: ("x > y > z", "xyz"), 2: ("c", "c"), 3: ("", "m1")}
    assert sorted(inventory.keyed_once(df).collect()) == sorted(inventory.keyed(df).collect())
    only_path = inventory.keyed(df.drop("一级功能", "二级功能", "三级功能")).orderBy("row_idx").collect()
    assert [r["path"] for r in only_path] == ["x > y", "x > y > z", "", ""]
