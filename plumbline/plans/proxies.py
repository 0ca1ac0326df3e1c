"""Views over the driver's tables that stand in for app feedback; the same SQL serves Spark and the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.steps import dealt, evenly

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")

#: Reviews: an order is a review, its priority the rating.
REVIEWS = """select o_orderkey as id, o_orderkey as row_idx, cast(substr(o_orderpriority, 1, 1) as int) as rating, cast(o_orderdate as date) as d,
 n_name as region, o_orderstatus as channel, c_mktsegment as platform
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""
#: A review's themes are the types of its parts, its device the least name of its parts.
THEMES = "select distinct l_orderkey as id, p_type as theme from lineitem join part on l_partkey = p_partkey"
DEVICES = "select l_orderkey as id, min(p_name) as device from lineitem join part on l_partkey = p_partkey group by l_orderkey"
REVIEW_THEMES = f"select r.id, r.rating, r.d, r.region, t.theme from ({REVIEWS}) r left join ({THEMES}) t on r.id = t.id"
#: What reviews and what themes and devices are joined by.
REVIEW_KEYS, PART_KEYS = {"orders": "o_custkey"}, {"lineitem": "l_partkey"}
#: Four literal releases.
RELEASES = """select * from (values ('1.0', date '1995-06-05'), ('2.0', date '1997-03-03'), ('3.0', date '1999-01-11'), ('4.0', date '2001-02-05')) as v(version, release_date)"""
#: List positions with repeats and gaps.
POSITIONS = "select l_orderkey as review, cast(l_linenumber as bigint) as pos, cast(l_shipdate as date) as d, l_returnflag as body, case when l_quantity >= 10 then cast(l_quantity as int) % 5 + 1 end as rating from lineitem"
#: Partial sightings of a record.
SCREENS = "select event_id % 97 as idx, event_id as seq, case when event_id % 3 = 0 then '' else event_type end as stars, case when event_id % 5 = 0 then '' else props end as body from events"
#: Threads: a user's turn is a root, other turns are replies.
THREADS = """select conv_id as post_id, turn as ord, conv_id * 100 + turn as comment_id, role = 'user' as is_root, text,
 case when length(text) % 4 = 0 then 'pos' when length(text) % 4 = 1 then 'neg' when length(text) % 7 = 2 then 'mix' else 'neutral' end as label, cast(length(text) % 50 as bigint) as n_likes
 from conversations"""
#: Two inventories of features: every line is a row of its line status' side. A feature's status follows from its part's
#: size, differently on each side; one line in some hundred tells another, which is a conflict. Every tenth size has a
#: feature of its own on side O, so that each side lacks some.
INVENTORY = """select l_orderkey * 10 + l_linenumber as row_idx, l_linestatus as side, lower(p_brand) || '|' || lower(p_type) || '|' || cast(p_size as varchar(10)) || case when l_linestatus = 'O' and p_size % 10 = 0 then '|o' else '' end as feature,
 p_type as module, case case when l_quantity >= 50 and l_discount >= 0.1 then (p_size + 1) % 3 when l_linestatus = 'F' then p_size % 3 else p_size % 4 end when 0 then '明确缺失' when 1 then '已验证存在' else '部分可用' end as status,
 case when l_quantity >= 50 then 'e' || cast(l_suppkey as varchar(10)) else '' end as evidence
 from lineitem join part on l_partkey = p_partkey"""


def view(spark: SparkSession, sf_dir: str, sql: str, spread: tuple[str, ...] = (), keyed: dict[str, str] | None = None) -> DataFrame:
    """The SQL over the tables that it names; no other table's schema is looked up. spread: tables whose rows take much work
    each and so are dealt out to all cores. keyed: tables with the column that they are joined by, dealt out by it where the
    other side is too large to broadcast: such a join has as many tasks as the files' bytes ask for, so what a task sorts
    stays the same."""

    def over(keys: dict[str, str]) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b(?:from|join)\s+{t}\b", sql):
                table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                table = evenly(table) if t in spread else table
                (dealt(table, keys[t]) if t in keys else table).createOrReplaceTempView(t)
        return spark.sql(sql.replace("varchar(10)", "string"))

    found = over({})
    shuffled = keyed and re.search("SortMergeJoin|ShuffledHashJoin", found._jdf.queryExecution().sparkPlan().toString())
    return over(keyed) if shuffled else found
