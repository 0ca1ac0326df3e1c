"""Votes, first-seen lists, row numbers, nesting and streams, against plain Python."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import inventory, issues, ordered, releases, reviews, threads
from plumbline.sources import readers, sinks
from plumbline.streaming import incremental

SIGHT = "app string, idx long, post_info string, stars string, text string"


def compatible(a, b):
    """Whether two sightings (post_info, stars, text) can be of one review."""
    if not a[0] or a[0] != b[0] or (a[1] and b[1] and a[1] != b[1]):
        return False
    if a[2] and b[2]:
        return a[2].startswith(b[2]) or b[2].startswith(a[2])
    return bool(a[1] and b[1])


def vote(saved, page):
    """(offset, votes, pairs) of lists of (idx, post_info, stars, text), pair by pair."""
    counts, first = Counter(), {}
    for x in page:
        for y in saved:
            if compatible(x[1:], y[1:]):
                counts[y[0] - x[0]] += 1
                first[y[0] - x[0]] = min(first.get(y[0] - x[0], (x[0], y[0])), (x[0], y[0]))
    if not counts:
        return None
    best = max(counts, key=lambda o: (counts[o], -first[o][0], -first[o][1]))
    return best, counts[best], sum(counts.values())


def sightings(r, n, shift=0):
    return [(r.randint(0, 40) + shift, r.choice(["d1", "d1", "d2", ""]), r.choice(["", "4", "5"]), r.choice(["", "a", "ab", "abc", "b", None])) for _ in range(n)]


@pytest.mark.parametrize("block", [4, 8192])
def test_votes_equal_pairs(spark, block):
    r = random.Random(block)
    pages = {a: (sightings(r, 60, 3), sightings(r, 12)) for a in "pqrst"} | {"u": ([], sightings(r, 3)), "v": (sightings(r, 4), [])}
    frames = [spark.createDataFrame([(a, *row) for a, both in pages.items() for row in both[k]], SIGHT) for k in (0, 1)]
    got = {x["app"]: tuple(x)[1:] for x in reviews.index_offset(*frames, by=["app"], block=block).collect()}
    plain = lambda rows: [(i, p, s, t or "") for i, p, s, t in rows]
    want = {a: v for a, (s, c) in pages.items() if (v := vote(plain(s), plain(c)))}
    assert got == want


def test_votes_of_one_hot_post_info(spark):
    """A thousand pages' worth of sightings that all look alike: no row for each pair."""
    n = 60_000
    side = lambda k: spark.range(n).select((F.col("id") * 2 + k).alias("idx"), F.lit("same").alias("post_info"), F.lit("5").alias("stars"), F.lit("text").alias("text"))
    plan = reviews.index_offset(side(7), side(0))
    assert tuple(plan.first()) == (7, n, n * n)


def test_correlated():
    r = np.random.default_rng(3)
    for size in (5, 700):
        y, x = (np.unique(r.integers(0, 2000, size)) for _ in range(2))
        m, n = r.integers(1, 4, len(y)), r.integers(1, 4, len(x))
        votes, first = Counter(), {}
        for a, b in zip(x.tolist(), n.tolist(), strict=True):
            for c, d in zip(y.tolist(), m.tolist(), strict=True):
                votes[c - a] += b * d
                first.setdefault(c - a, a)
        got = reviews.correlated((y, m), (x, n))
        assert {o: (v, f) for o, v, f in zip(*(g.tolist() for g in got), strict=True)} == {o: (v, first[o]) for o, v in votes.items()}


def test_first_seen_of_a_large_key(spark):
    rows = spark.range(1_000_000).select(F.col("id").alias("row_idx"), F.lit("k").alias("key"), F.concat(F.lit("e"), (999_999 - F.col("id")) % 5).alias("evidence"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("n"), F.col("id") % 4)).alias("notes"))
    rows = rows.withColumns({"feature_id": F.lit("k"), "module": F.lit("m"), "path": F.lit("p"), "status": F.lit("已验证存在")})
    got = inventory.merge(rows).first()
    assert (got["evidence"], got["notes"]) == ("e4；e3；e2；e1；e0", "n1；n3")
    assert inventory.merge(rows.withColumn("evidence", F.lit(""))).first()["evidence"] == ""


def test_row_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 1), ("c", 700)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"f": name, "k": i, "pad": "x" * (i % 50)}) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.json_lines(spark, str(tmp_path), "f string, k long, pad string")
        assert rows.rdd.getNumPartitions() > 50
        assert rows.where("row_idx <> k").count() == 0 and rows.count() == 5701
        across = ordered.file_rows(spark.read.schema("f string, k long").json(str(tmp_path)), across=True)
        start = {"a": 0, "b": 5000, "c": 5001}
        assert all(r["row_idx"] == start[r["f"]] + r["k"] for r in across.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_and_running_values_in_stretches(spark):
    r = random.Random(2)
    at = r.sample(range(-300, 900), 400)
    df = spark.createDataFrame([(p % 3, p, p if p % 7 == 0 else None) for p in at], "g int, p long, v long")
    for row in ordered.numbered(df, "n", "p", ["g"], stretch=16).collect():
        assert row["n"] == sum(1 for x in at if x % 3 == row["g"] and x <= row["p"])
    for row in ordered.last_before(df, "last", F.col("v"), "p", ["g"], stretch=16).collect():
        seen = [x for x in at if x % 3 == row["g"] and x <= row["p"] and x % 7 == 0]
        assert row["last"] == (max(seen) if seen else None)


def test_nesting_keeps_pages_apart(spark):
    rows = [("p", "r1", 1, True, "x"), ("q", "c1", 2, False, "y"), ("p", "c2", 3, False, "z"), ("q", "r2", 4, True, "w"), ("q", "c1", 5, False, "late"), ("p", "r1", 6, True, "last")]
    df = spark.createDataFrame(rows, "page string, key string, n int, root boolean, text string")
    got = {(r["page"], r["key"]): (r["parent"], r["kind"], r["text"], r["seen"]) for r in threads.dom_comments(df, "key", "n", ["text"], "root", by=["page"]).collect()}
    assert got == {("p", "r1"): (None, "root", "last", 2), ("p", "c2"): ("r1", "reply", "z", 1), ("q", "c1"): (None, "reply", "late", 2), ("q", "r2"): (None, "root", "w", 1)}


def test_rebase_is_kept_over_restarts(spark, tmp_path):
    schema = "screen string, idx int, seq int, Username string, Stars string, StarMessage string, Text string, PostInfo string"
    row = lambda screen, at, k: (screen, at, 1, "u", "5", "", f"text {k}", f"day {k}")
    target, source = str(tmp_path / "t"), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    batches = [[row("s0", k, k) for k in range(5)], [row("s1", k + 4, k) for k in range(3, 8)] + [row("s2", k + 4, k) for k in range(-2, 0)], [row("s3", k + 9, k) for k in range(6, 11)] + [row("s1", k + 4, k) for k in (3, 12)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        incremental.collect_screens(stream(), target, str(tmp_path / "cp")).awaitTermination()
    shifts = {"s0": 0, "s1": -4, "s2": -4, "s3": -9}
    assert {r["screen"]: r["shift"] for r in incremental.offsets(spark, target).collect()} == shifts
    assert {r["idx"]: r["Text"] for r in incremental.current(spark, target).collect()} == {k: f"text {k}" for k in (*range(-2, 11), 12)}
    before = sorted(map(str, incremental.progress(spark, target).collect()))
    incremental.merge_batch(spark.createDataFrame(batches[1], schema), 1, target)  # the same epoch again
    assert sorted(map(str, incremental.progress(spark, target).collect())) == before
    # the raw screens with the noted shifts give the same records
    raw = spark.createDataFrame([x for b in batches for x in b], schema).join(incremental.offsets(spark, target), "screen")
    assert {r["k"] for r in raw.select((F.col("idx") + F.col("shift")).alias("k")).collect()} == {r["idx"] for r in incremental.current(spark, target).collect()}
    with pytest.raises(ValueError, match="overlaps nothing"):
        incremental.merge_batch(spark.createDataFrame([row("s9", 1, 99)], schema), 3, target)
    assert incremental.offsets(spark, target).where("screen = 's9'").isEmpty()


def test_signature_is_free_of_order(spark):
    rows = [(k, f"i{k}", None if k % 3 == 0 else "t") for k in range(50)]
    sign = lambda x: spark.createDataFrame(x, "idx int, PostInfo string, Text string").repartition(3).agg(incremental.signature().alias("s")).first()["s"]
    assert sign(rows) == sign(rows[::-1]) != sign(rows[1:])
    assert sign(rows) != sign([*rows[:-1], (49, "i49", "u")])


def test_normal_forms_without_python(spark):
    cells = ["状态", "ｆｕｌｌ，①", "é", "é", " plain ", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [tuple(r) for r in df.select(X.nfkc(F.col("c")), X.nfc_key(F.col("c"))).collect()]
    assert got == [("状态", "状态"), ("full,1", "ｆｕｌｌ，①"), ("é", "é"), ("é", "é"), ("plain", "plain"), ("", ""), ("", "")]
    plan = df.select(X.source_record_id(F.lit(None), F.col("c"), F.col("c")).alias("i"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_normalize_exit_code(spark, tmp_path):
    rows = [(0, "app", "正式", "1.0", "2026-01-02", "page"), (1, "app", "正式", "1.0", "2026-01-02", "page"), (2, "app", "正式", "2.0", "2026-02-02", "page, \"x\"\ny")]
    df = spark.createDataFrame(rows, "row_idx long, `应用` string, `渠道` string, `版本号` string, `时间` string, `来源` string")
    good, found = releases.normalize(df)
    assert [(r["row_no"], r["version"]) for r in good.orderBy("row_no").collect()] == [(2, "2.0"), (3, "1.0")]
    assert sinks.release_files(good, found, str(tmp_path / "good")) == 0
    bad, found = releases.normalize(df.withColumn("来源", F.lit("")))
    assert sinks.release_files(bad, found, str(tmp_path / "bad")) == 1
    for name in ("good.csv", "good.json", "good.md", "bad.csv", "bad-findings.csv"):
        assert (tmp_path / name).exists()
    assert (tmp_path / "good.csv").read_bytes().startswith(b"\xef\xbb\xbfapp_name,")
    told = json.loads((tmp_path / "good.json").read_text())
    assert [u["version"] for u in told["updates"]] == ["2.0", "1.0"] and told["updates"][0]["source"] == 'page, "x" y'
    back = readers.update_records(spark, str(tmp_path / "good.csv")).orderBy("row_idx").collect()
    assert [(r["version"], r["source"]) for r in back] == [("2.0", 'page, "x" y'), ("1.0", "page")]


def test_judged(spark):
    checks = issues.quality_checks(spark, {"a": spark.range(2)})
    got = {r["check"]: (r["passed"], r["detail"]) for r in issues.judged(checks, {"b": True, "c": False}).collect()}
    assert got == {"a": (False, "2"), "b": (True, "judged by a person"), "c": (False, "judged by a person")}


def test_empty_files(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, b array<string>")
    sinks.csv_file(empty, str(tmp_path / "e.csv"), ["a"])
    sinks.json_file(empty, str(tmp_path / "e.json"), "rows", ["a"])
    assert (tmp_path / "e.csv").read_bytes() == b"\xef\xbb\xbfa,b\r\n" and json.loads((tmp_path / "e.json").read_text()) == {"rows": []}
    df = spark.createDataFrame([(1, ["x", "y"]), (2, None)], "a int, b array<string>")
    sinks.csv_file(df, str(tmp_path / "f.csv"), ["a"])
    assert readers.csv_table(spark, str(tmp_path / "f.csv")).orderBy("row_idx").select("a", "b").collect() == [("1", "x,y"), ("2", "")]
