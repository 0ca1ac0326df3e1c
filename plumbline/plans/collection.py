"""Queries over collection: streams that are shifted and restarted, gap filling, page nesting, files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import inventory, reviews, threads
from plumbline.plans import proxies as P
from plumbline.plans.catalogue import _folder, query
from plumbline.sources import readers, sinks
from plumbline.streaming import incremental

# A list of customers that grows at its head between three sittings: by 7, then by 5 more. The first shows the first half with
# texts cut short, the second the rest from 20 before the half on and what is new at the head, the third each fifth row.
_SITTINGS = """select 'a' as screen, 0 as pushed, 0 as epoch, c_custkey as idx, c_name as info, c_mktsegment as stars, 't' as body from customer where c_custkey <= (select max(c_custkey) from customer) / 2 + 20
 union all select 'b', 7, 1, c_custkey, c_name, c_mktsegment, 't' || c_nationkey from customer where c_custkey > (select max(c_custkey) from customer) / 2 - 20
 union all select 'c', 7, 1, n_nationkey - 7, n_name, 'new', n_name from nation where n_nationkey < 7
 union all select 'd', 12, 2, c_custkey, c_name, c_mktsegment, 't' || c_nationkey from customer where c_custkey % 5 = 0"""
_SQL = f"with s as ({_SITTINGS.replace('/ 2', '// 2')}) "


def _sittings(spark, sf) -> DataFrame:
    rows = P.view(spark, sf, _SITTINGS.replace("/ 2", "div 2"))
    return rows.select("epoch", "screen", (F.col("idx") + F.col("pushed")).cast("int").alias("idx"), F.lit(1).alias("seq"), F.lit("u").alias("Username"), F.col("stars").alias("Stars"), F.lit("").alias("StarMessage"), F.col("body").alias("Text"), F.col("info").alias("PostInfo"))


def _collected(spark, sf) -> str:
    """The three sittings through a stream that is started anew for each; the log's folder."""
    folder = _folder(spark)
    rows = _sittings(spark, sf)
    for epoch in range(3):
        rows.where(F.col("epoch") == epoch).drop("epoch").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.drop("epoch").schema).parquet(f"{folder}/in")
        incremental.collect_screens(stream, f"{folder}/target", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/target"


@query(_SQL + "select idx::int as idx, arg_max(stars, epoch) as Stars, arg_max(body, (length(body), epoch)) as Text, any_value(info) as PostInfo from s group by idx")
def stream_rebased(spark, sf):
    return incremental.current(spark, _collected(spark, sf)).select("idx", "Stars", "Text", "PostInfo")


@query(_SQL + "select screen, -any_value(pushed)::bigint as shift from s group by 1")
def stream_offsets(spark, sf):
    return incremental.offsets(spark, _collected(spark, sf))


@query(_SQL + "select epoch::bigint as screen, count(*) as records, -any_value(pushed)::bigint as shift, count(*) || ':' || sum(('0x' || substr(md5(idx || '|' || info || '|' || body), 1, 12))::bigint)::varchar as signature from s group by epoch")
def stream_progress(spark, sf):
    return incremental.progress(spark, _collected(spark, sf)).drop("newest_date")


@query(_SQL + "select idx::int as idx, arg_max(stars, epoch) as Stars, arg_max(body, (length(body), epoch)) as Text from s where screen <> 'd' group by idx")
def stream_replayed(spark, sf):
    """Raw files, a broken one among them, read again with the offsets that the stream noted."""
    target = _collected(spark, sf)
    raw = _sittings(spark, sf).where("screen <> 'd'")
    node = lambda field: F.struct(F.struct(F.concat(F.lit(f"CommentDetail{field}"), F.col("idx").cast("string")).alias("key"), F.col(field).alias("text")).alias("attributes"))
    # a file holds a block of a screen's records, as a real one shows a few
    blocks = raw.groupBy("screen", F.floor(F.col("idx") / 5000).alias("part")).agg(F.to_json(F.struct(F.flatten(F.collect_list(F.array(node("Stars"), node("Text")))).alias("children"))).alias("value"))
    folder = _folder(spark)
    blocks.select("value", F.concat_ws("_", F.lit("screen"), "screen", F.col("part").cast("string")).alias("name")).write.partitionBy("name").text(f"{folder}/raw")
    spark.range(1).select(F.lit('{"children": [').alias("value"), F.lit("screen_x_0").alias("name")).write.mode("append").partitionBy("name").text(f"{folder}/raw")
    named = spark.read.text(f"{folder}/raw", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"name=([^/]+)/", 1).alias("screen"), F.try_parse_json("value").alias("tree"))
    fields = readers.review_fields(readers.ui_nodes(named.where("tree is not null")))
    shifts = incremental.offsets(spark, target).withColumnRenamed("screen", "from")
    moved = fields.withColumn("from", F.split("screen", "_")[1]).join(shifts, "from").select((F.col("idx") + F.col("shift")).cast("int").alias("idx"), "Stars", "Text", "from")
    newest = F.struct(F.col("from") != "a", F.lit(1))
    return moved.groupBy("idx").agg(F.max_by("Stars", newest).alias("Stars"), F.max_by("Text", F.struct(F.length("Text"), newest)).alias("Text"))


_GAPPED = "select c_custkey as idx, c_name as info, c_mktsegment as stars from customer where c_custkey % 4 <> 0"
_MISSING = "m as (select unnest(range((select min(idx) from {t}), (select max(idx) from {t}) + 1)) as p), g as (select '{n}' as phase, p from m where p not in (select idx from {t}))"


@query(
    f"with b as ({_GAPPED}), a as (select idx from b union select c_custkey from customer where c_custkey % 12 = 0), x as (select 'before' as phase, unnest(range((select min(idx) from b), (select max(idx) from b) + 1)) as p), y as (select 'after' as phase, unnest(range((select min(idx) from a), (select max(idx) from a) + 1)) as p), g as (select * from x where p not in (select idx from b) union all select * from y where p not in (select idx from a)) select phase, count(*)::bigint as gap_count, array_to_string(list_sort(list(p))[1:30], ',') as first_gaps from g group by 1"
)
def gap_fill(spark, sf):
    """A list with each fourth position missing, then a backward pass, shifted by 3, that brings a third of them."""
    target = _folder(spark)
    shown = lambda sql, k: P.view(spark, sf, sql).select((F.col("idx") + k).cast("int").alias("idx"), (-F.col("idx")).cast("int").alias("seq"), F.lit("u").alias("Username"), F.col("stars").alias("Stars"), F.lit("").alias("StarMessage"), F.lit("t").alias("Text"), F.col("info").alias("PostInfo"))
    incremental.merge_batch(shown(_GAPPED, 0), 0, target)
    extra = shown(_GAPPED.replace("% 4 <> 0", "% 12 in (0, 1)"), 3)
    before, after = incremental.fill_gaps(spark, target, extra, 1)
    both = before.withColumn("phase", F.lit("before")).unionByName(after.withColumn("phase", F.lit("after")))
    return both.select("phase", "gap_count", F.array_join("first_gaps", ",").alias("first_gaps"))


_SEEN = "select conv_id % 10 as page, conv_id * 10 + turn % 5 as comment, conv_id * 10 + turn as place, role = 'user' as is_root, length(text) as size from conversations"


@query(
    f"with s as ({_SEEN}), k as (select page, comment, min(place) as position, arg_max(size, place) as size, count(*) as seen, arg_min(is_root, place) as r from s group by 1, 2) select page, comment, position, size, seen, case when not r then last_value(case when r then comment end ignore nulls) over (partition by page order by position rows unbounded preceding) end as parent, case when r then 'root' else 'reply' end as kind from k"
)
def page_nesting(spark, sf):
    return threads.dom_comments(P.view(spark, sf, _SEEN), "comment", "place", ["size"], "is_root", by=["page"])


# Files ---------------------------------------------------------------------------------------------------------------------


@query("select (row_number() over (order by c_custkey) - 1)::bigint as row_idx, c_custkey::varchar as c_custkey, c_name || ', \"x\"' || chr(10) || 'y' as c_name from customer")
def csv_file(spark, sf):
    """A table of any size as one CSV in order, written by the executors."""
    path = f"{_folder(spark)}/customer.csv"
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(F.col("c_name"), F.lit(', "x"\ny')).alias("c_name"))
    sinks.csv_file(c, path, ["c_custkey"])
    return readers.csv_table(spark, path)


@query("select (row_number() over (order by c_custkey) - 1)::bigint as row_idx, c_custkey as id, c_name as name, case when c_nationkey > 9 then c_mktsegment end as segment from customer")
def json_file(spark, sf):
    """A table of any size as one JSON object with its rows in order."""
    path = f"{_folder(spark)}/customer.json"
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment")).alias("segment"))
    sinks.json_file(c, path, "rows", ["id"])
    rows = readers.json_records(spark, path, ("rows",))
    get = lambda k, t: F.try_variant_get("record", f"$.{k}", t).alias(k)
    return rows.select("row_idx", get("id", "long"), get("name", "string"), get("segment", "string"))


@query("select conv_id::varchar as post_id, 't' || conv_id as title, count(*) as comments, max(turn) as last from conversations group by conv_id")
def social_posts(spark, sf):
    """Posts in a JSON file under items, read back as posts."""
    path = f"{_folder(spark)}/posts.json"
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("comments"))  # a conversation's few turns
    sinks.json_file(one.select(F.col("conv_id").cast("string").alias("note_id"), F.concat(F.lit("t"), F.col("conv_id")).alias("title"), "comments"), path, "items", ["note_id"])
    posts = threads.read_posts(spark, path)
    get = lambda p, t: F.try_variant_get("post", p, t)
    turns = get("$.comments", "array<struct<turn: long, role: string>>")
    return posts.select(get("$.note_id", "string").alias("post_id"), get("$.title", "string").alias("title"), F.size(turns).cast("long").alias("comments"), F.array_max(turns["turn"]).alias("last"))


_OLD = "select p_partkey as k, p_type as module, case when p_size % 4 = 0 then '已验证存在' when p_size % 4 = 1 then '部分可用' else '明确缺失' end as status, p_brand as brand, p_size % 3 as blanks, p_size % 5 = 0 as long from part"


@query(
    f"select (row_number() over (order by k) - 1)::bigint as row_idx, module as \"模块\", brand as \"一级功能\", case when long then 'b' when blanks = 0 then 'two' else '' end as \"二级功能\", case when long then 'f / g' else '' end as \"六级功能\", status as \"验证状态\", 'e' || k as \"证据文件\", case when blanks = 2 then 'n1；n2' else '' end as \"备注\" from ({_OLD})"
)
def old_inventory(spark, sf):
    """An inventory file by position whose rows have moved statuses: short of levels, or with one level too many."""
    path = f"{_folder(spark)}/old.csv"
    levels = F.when(F.col("long"), F.array(F.col("brand"), *map(F.lit, "bcdefg"))).when(F.col("blanks") == 0, F.array(F.col("brand"), F.lit("two"))).otherwise(F.array("brand"))
    tail = F.when(F.col("blanks") == 2, F.array(F.lit("n1"), F.lit(""), F.lit("n2"))).otherwise(F.array().cast("array<string>"))
    cells = F.concat(F.array("module"), levels, F.array(F.col("status"), F.concat(F.lit("e"), F.col("k"))), tail)
    header = ["模块", *readers.LEVELS, "验证状态", "证据文件", "备注"]
    rows = P.view(spark, sf, _OLD).select("k", F.array_join(cells, ",").alias("line"))
    sinks.lines_file(rows, path, ["k"], head=",".join(header) + "\n")
    got = readers.inventory(spark, path)
    assert inventory.header_issues(got.columns) == []
    return got.select("row_idx", "模块", "一级功能", "二级功能", "六级功能", "验证状态", "证据文件", "备注")


@query("select c_custkey::varchar as id, c_name || ' x y' as name from customer")
def cleaned_csv(spark, sf):
    """A CSV whose cells are cleaned of white space as they are read."""
    path = f"{_folder(spark)}/customer.csv"
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" 　x\n\ty ")).alias("name"))
    sinks.csv_file(c, path, ["id"])
    return readers.csv_table(spark, path, cleaned=True).select("id", "name")


@query("with r as (" + P.REVIEWS + ") select '匿名用户' as user, rating, count(*) as n, max(id) as last from r where year(d) = 1997 and month(d) = 6 group by 2")
def anonymous_reviewers(spark, sf):
    """A month's rows name nobody: whoever wrote them, the label is one."""
    r = P.view(spark, sf, P.REVIEWS)
    shown = F.concat(F.date_format("d", "yyyy/M/d"), F.lit(" | "), F.col("region"), F.lit(" | phone"))
    fields = r.select(F.col("id").alias("idx"), F.concat(F.lit("someone "), F.col("id")).alias("Username"), F.col("rating").cast("string").alias("Stars"), F.lit("").alias("StarMessage"), F.lit("t").alias("Text"), shown.alias("PostInfo"))
    rows = reviews.assemble(fields, F.lit("2001-12-31").cast("date"), (1997, 6))
    return rows.groupBy("user", "rating").agg(F.count("*").alias("n"), F.max("list_pos").alias("last"))


# Rules over data in which each of their branches occurs ------------------------------------------------------------------------

_WIDE = "".join(chr(0xFF41 + i) for i in range(26))


@query("select p_partkey, p_name || ' 1 %' as name from part")
def nfkc_forms(spark, sf):
    """Names in full-width letters with a circled figure and a small percent sign, in their plain form again."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", _WIDE)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.nfkc(F.concat(F.lit("　"), wide, F.lit(" ① ﹪ "))).alias("name"))


_STATES = "select p_type as module, case p_size % 6 when 0 then '未检查' when 1 then '受阻' when 2 then '未收录' when 3 then '明确缺失' when 4 then '已验证存在' else '部分可用' end as status from part"


@query(f"select module, count(*) as rows, count(*) filter (status = '未检查') as unchecked, count(*) filter (status = '受阻') as blocked, count(*) filter (status = '未收录') as unlisted, count(*) filter (status = '明确缺失') as absent from ({_STATES}) group by 1")
def coverage_counts(spark, sf):
    return inventory.coverage_note(P.view(spark, sf, _STATES))


_ROWS = "select p_partkey as row_idx, p_type as `模块`, case when p_partkey % 2 = 0 then p_brand else p_brand || p_type end as `一级功能`, case when p_partkey % 2 = 0 then p_type else '' end as `二级功能`, case p_size % 4 when 0 then '已验证存在' when 1 then '部分可用' when 2 then '明确缺失' else '何' end as `验证状态`, case when p_partkey % 3 = 0 then '' else 'e' end as `证据ID` from part"


@query(
    "with r as ("
    + _ROWS.replace("`", '"')
    + "), k as (select *, regexp_replace(lower(\"一级功能\" || \"二级功能\"), '[^a-z0-9]', '', 'g') as key, \"一级功能\" || case when \"二级功能\" <> '' then ' > ' || \"二级功能\" else '' end as path from r), g as (select min(row_idx) + 2 as row_no, count(distinct \"验证状态\") as s, count(distinct path) as p from k group by key having count(*) > 1) "
    "select row_idx + 2 as row_no, 'error' as severity, 'status' as code from k where \"验证状态\" = '何' union all select row_idx + 2, 'warning', 'no_evidence' from k where \"验证状态\" in ('已验证存在', '部分可用') and \"证据ID\" = '' union all select row_no, 'warning', case when s > 1 then 'conflict' else 'duplicate' end from g union all select row_no, 'warning', 'key_collision' from g where p > 1"
)
def inventory_findings(spark, sf):
    """Findings of an inventory in which paths meet under one key, with all their kinds."""
    return inventory.validate_table(P.view(spark, sf, _ROWS)).select("row_no", "severity", "code")


@query(
    "with e as (select *, row_number() over (partition by event_type order by event_id desc) as back from events) select event_type, arg_max(cast(ts as date), event_id) < date '2024-01-30' or count(distinct case when back <= 4 then user_id % 2 end) = 1 and count(*) >= 4 as stop from e group by 1"
)
def stop_by_type(spark, sf):
    """Whether a collection of each type's events may end: the newest is old enough, or the last four look alike."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("event_id").alias("screen"), F.col("ts").cast("date").alias("newest_date"), (F.col("user_id") % 2).cast("string").alias("signature"))
    kinds = [r["event_type"] for r in e.select("event_type").distinct().collect()]  # five
    told = [(k, incremental.should_stop(e.where(F.col("event_type") == k), F.lit("2024-01-30").cast("date"), 10**9)) for k in kinds]
    return spark.createDataFrame(told, "event_type string, stop boolean")
