"""Registered queries: each runs an operator over stand-in views, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.operators import inventory, issues, metrics, releases, reviews, tagging, threads
from plumbline.plans import proxies as P
from plumbline.sources import readers, sinks
from plumbline.sources.steps import dealt, evenly
from plumbline.sources.steps import shared_folder as _folder
from plumbline.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


CORE = "count(*) as n, avg(rating) as mean, count(*) filter (rating <= 2) / count(*) as bad, count(*) filter (rating = 3) / count(*) as mid, count(*) filter (rating >= 4) / count(*) as good, (count(*) filter (rating >= 4) - count(*) filter (rating <= 2)) / count(*) as nps_like"
WITH_R = f"with r as ({P.REVIEWS}) "
WITH_T = f"with t as ({P.REVIEW_THEMES}) "


def reviews_of(spark, sf):
    return metrics.rated(P.view(spark, sf, P.REVIEWS, keyed=P.REVIEW_KEYS))


def reviews_by_id(spark, sf):
    """All reviews, rated or not, dealt out by id, as what is joined to them is."""
    return dealt(P.view(spark, sf, P.REVIEWS, keyed=P.REVIEW_KEYS), "id")


def themes_by_id(spark, sf):
    return dealt(P.view(spark, sf, P.THEMES.replace("distinct ", ""), keyed=P.PART_KEYS), "id").distinct()


def themed(spark, sf):
    rows = reviews_by_id(spark, sf).join(themes_by_id(spark, sf), "id", "left")
    return rows.select("id", "rating", "d", "region", "theme")


# Metrics ---------------------------------------------------------------------------------------------------------------


@query(WITH_R + f", w as (select cast(date_trunc('week', d) as date) as week, {CORE} from r where rating between 1 and 5 group by 1) select *, mean - lag(mean) over (order by week) as delta_mean, n < 20 as small_sample from w")
def weekly_metrics(spark, sf):
    return metrics.weekly(reviews_of(spark, sf))


@query(WITH_R + f", w as (select greatest(cast(date_trunc('week', d) as date), date '1996-01-03') as week, cast(date_trunc('week', d) as date) as m, {CORE} from r where d between date '1996-01-03' and date '1996-12-29' group by 1, 2) select * exclude (m), mean - lag(mean) over (order by week) as delta_mean, n < 20 as small_sample, m < date '1996-01-03' or m + 6 > date '1996-12-29' as is_partial from w")
def weekly_metrics_clipped(spark, sf):
    return metrics.weekly(reviews_of(spark, sf), F.lit("1996-01-03").cast("date"), F.lit("1996-12-29").cast("date"))


@query(WITH_R + f"select d, {CORE}, count(*) < 20 as small_sample from r group by d")
def daily_metrics(spark, sf):
    return metrics.by_key(reviews_of(spark, sf), "d")


@query(WITH_R + "select rating, count(*) as n, count(*) / sum(count(*)) over () as share from r group by rating")
def rating_distribution(spark, sf):
    return metrics.distribution(reviews_of(spark, sf))


@query(WITH_R + ", s as (select count(*) filter (rating = 1) / count(*) a, count(*) filter (rating = 2) / count(*) b, count(*) filter (rating = 3) / count(*) c, count(*) filter (rating = 4) / count(*) e, count(*) filter (rating = 5) / count(*) f from r) select case when a >= 0.25 and f >= 0.25 and c < 0.2 then 'U' when e + f >= 0.6 then 'high' when a + b >= 0.6 then 'low' when b + c + e >= 0.6 then 'normal' else 'long_tail' end as shape, 'shape_v1' as rule_version from s")
def rating_shape(spark, sf):
    return metrics.shape(reviews_of(spark, sf))


@query(WITH_R + "select case when grouping(channel) = 0 then 'channel' when grouping(platform) = 0 then 'platform' when grouping(region) = 0 then 'region' else 'overall' end as dimension, coalesce(channel, platform, region, '') as value, count(*) as n, avg(rating) as mean, count(*) filter (rating <= 2) / count(*) as bad, count(*) filter (rating = 3) / count(*) as mid, count(*) filter (rating >= 4) / count(*) as good from r group by grouping sets ((), (channel), (platform), (region))")
def metrics_summary_grouping_sets(spark, sf):
    return metrics.grouping_sets(reviews_of(spark, sf), "channel", "platform", "region")


_SIDE = "count(*) filter (d {op} release_date) as n_{s}, avg(rating) filter (d {op} release_date) as mean_{s}, count(*) filter (d {op} release_date and rating <= 2) / nullif(count(*) filter (d {op} release_date), 0) as bad_{s}, count(*) filter (d {op} release_date and rating >= 4) / nullif(count(*) filter (d {op} release_date), 0) as good_{s}"


@query(WITH_R + f", v as ({P.RELEASES}), a as (select version, release_date, {_SIDE.format(op='<', s='before')}, {_SIDE.format(op='>=', s='after')} from r join v on d >= release_date - 28 and d < release_date + 28 group by 1, 2) select *, mean_after - mean_before as delta_mean, bad_after - bad_before as delta_bad, good_before - bad_before as nps_before, good_after - bad_after as nps_after, good_after - good_before as delta_good, (good_after - bad_after) - (good_before - bad_before) as delta_nps from a")
def release_before_after(spark, sf):
    return metrics.around_releases(reviews_of(spark, sf), P.view(spark, sf, P.RELEASES), 28)


@query(WITH_R + f", v as ({P.RELEASES}) select version, cast(d - release_date as int) as day, count(*) as n, count(*) filter (rating <= 2) as n_bad, avg(rating) as mean from r join v on d >= release_date and d < release_date + 3 group by 1, 2")
def release_flood_window(spark, sf):
    return metrics.flood(reviews_of(spark, sf), P.view(spark, sf, P.RELEASES))


_THEME = "select theme, count(distinct id) as mentions, avg(rating) as mean, count(*) filter (rating <= 2) / count(*) as bad, count(distinct id) / (select count(distinct id) from t) as share from t where theme is not null group by theme"


@query(WITH_T + f", a as ({_THEME}) select *, row_number() over (order by mentions desc, mean, theme) as rank from a qualify rank <= 10")
def theme_rank_top10(spark, sf):
    return metrics.themes(themed(spark, sf), 10)


_FEATURE = "select * from (values ('ECONOMY', date '1996-05-06'), ('PROMO', date '1998-02-02'), ('SMALL', date '2000-07-03')) as v(theme, release_date)"


@query(WITH_T + f", v as ({_FEATURE}) select theme, avg(rating) filter (d < release_date) as mean_before, avg(rating) filter (d >= release_date) as mean_after, count(*) filter (d < release_date) as n_before, count(*) filter (d >= release_date) as n_after, (select avg(rating) from (select distinct id, rating from t)) as mean_all from t join v using (theme) group by theme")
def theme_reversal(spark, sf):
    return metrics.reversal(themed(spark, sf), P.view(spark, sf, _FEATURE))


_RULES = R.RuleSet(name="proxy", devices=(("red|blue", "colour"), ("gear|rod", "drive"), ("new|old", "age"), ("bolt", "fastener")))
_SERIES = "case when device ~ 'red|blue' then 'colour' when device ~ 'gear|rod' then 'drive' when device ~ 'new|old' then 'age' when device ~ 'bolt' then 'fastener' else '其他' end"
WITH_D = f"with d0 as (select r.*, d.device from ({P.REVIEWS}) r join ({P.DEVICES}) d on r.id = d.id), r as (select *, {_SERIES} as series from d0) "


#: The rows that P.DEVICES takes the least of.
_DEVICE_NAMES = "select l_orderkey as id, p_name as device from lineitem join part on l_partkey = p_partkey"


def with_device(spark, sf):
    d = dealt(P.view(spark, sf, _DEVICE_NAMES, keyed=P.PART_KEYS), "id").groupBy("id").agg(F.min("device").alias("device"))
    return reviews_by_id(spark, sf).join(d, "id").withColumn("series", R.device_series(F.col("device"), _RULES)["series"])


@query(WITH_D + f"select series, {CORE}, count(*) < 20 as small_sample from r group by series")
def device_metrics(spark, sf):
    return metrics.by_key(with_device(spark, sf), "series")


@query(WITH_D + "select device, series, coalesce(nullif(regexp_extract(device, '(red|blue)', 1), ''), nullif(regexp_extract(device, '(gear|rod)', 1), ''), nullif(regexp_extract(device, '(new|old)', 1), ''), nullif(regexp_extract(device, '(bolt)', 1), ''), '') as keyword, series = '其他' as low_confidence, count(*) as n from r group by all")
def device_cascade(spark, sf):
    d = with_device(spark, sf).withColumn("m", R.device_series(F.col("device"), _RULES))
    return d.groupBy("device", "series", F.col("m.keyword").alias("keyword"), F.col("m.low_confidence").alias("low_confidence")).agg(F.count("*").alias("n"))


@query(WITH_D + f"select series, cast(date_trunc('week', d) as date) as week, {CORE}, count(*) < 20 as small_sample from r group by 1, 2")
def device_week_trend(spark, sf):
    return metrics.by_key(with_device(spark, sf).withColumn("week", F.date_trunc("week", F.col("d")).cast("date")), "series", "week")


_DT = WITH_D + f", p as (select r.id, series as device, theme, rating from r left join ({P.THEMES}) t on r.id = t.id), c as (select device, theme, count(*) as n from p where theme is not null group by 1, 2), a as (select device, count(distinct id) t from p group by 1), b as (select theme, avg(rating) m from p where theme is not null group by 1) select device, theme, n, n / t as share, round(n * (1 - m / 5), 8) as weighted from c join a using (device) join b using (theme)"


@query(_DT)
def device_theme_intensity(spark, sf):
    d = with_device(spark, sf).select("id", F.col("series").alias("device"), "rating")
    return metrics.device_themes(d.join(themes_by_id(spark, sf), "id", "left")).withColumn("weighted", F.round("weighted", 8))


@query(WITH_D + f", p as (select series as device, theme from r join ({P.THEMES}) t on r.id = t.id) select device, count(*) filter (theme = 'ECONOMY') as ECONOMY, count(*) filter (theme = 'PROMO') as PROMO, count(*) filter (theme = 'SMALL') as SMALL from p group by device")
def device_theme_matrix(spark, sf):
    d = with_device(spark, sf).select("id", F.col("series").alias("device"), "rating")
    long = metrics.device_themes(d.join(themes_by_id(spark, sf), "id", "left"))
    return metrics.matrix(long, "device", "theme", "n", ["ECONOMY", "PROMO", "SMALL"])


@query(WITH_R + f", a as (select region, {CORE} from r group by region), t as (select avg(rating) m, count(*) filter (rating <= 2) / count(*) b from r) select region, n, mean, bad, mid, good, nps_like, n < 20 as small_sample, n >= 20 and (abs(mean - m) >= 0.30 or abs(bad - b) >= 0.10) as noteworthy, row_number() over (order by n desc, mean, region) as rank from a, t")
def region_noteworthy(spark, sf):
    return metrics.regions(reviews_of(spark, sf))


_FACTS = "select * from (values ('ECONOMY', 'absent', 'core', '2w', false), ('PROMO', 'partial', 'cross', 'quarter', false), ('SMALL', 'entry', 'edge', 'later', true), ('LARGE', null, 'single', null, false), ('MEDIUM', 'absent', null, 'next', false)) as f(theme, gap_status, audience_class, feasibility, risk_override)"


def priorities_of(spark, sf, themes):
    return metrics.priority(themes.drop("rank").join(F.broadcast(P.view(spark, sf, _FACTS)), "theme", "left"))


@query(WITH_T + f", a as ({_THEME}), f as ({_FACTS}), j as (select a.*, gap_status, audience_class, feasibility, risk_override from a left join f using (theme)), c as (select *, 100.0 * mentions / max(mentions) over () v, greatest(0, least(100, 50 * bad + 50 * (5 - mean) / 4)) dd, coalesce(case gap_status when 'absent' then 100 when 'partial' then 70 when 'entry' then 30 end, 0)::double g, coalesce(case audience_class when 'cross' then 100 when 'core' then 75 when 'single' then 50 when 'edge' then 25 end, 0)::double u, coalesce(case feasibility when '2w' then 100 when 'quarter' then 75 when 'next' then 50 when 'later' then 25 end, 0)::double f from j), s as (select *, 0.30::double * v + 0.30::double * dd + 0.15::double * g + 0.15::double * u + 0.10::double * f sc from c) select theme, mentions, round(v, 2) as V, round(dd, 2) as D, round(g, 2) as G, round(u, 2) as U, round(f, 2) as F, round(sc, 2) as score, case when coalesce(risk_override, false) or sc >= 75 then 'P0' when sc >= 50 then 'P1' else 'P2' end as grade, row_number() over (order by sc desc, dd desc, mentions desc, theme) as rank, concat_ws(',', case when gap_status is null then 'G' end, case when audience_class is null then 'U' end, case when feasibility is null then 'F' end) as missing_components, 'priority_v1' as rule_version from s")
def priority_v1(spark, sf):
    return priorities_of(spark, sf, metrics.themes(themed(spark, sf)))


@query(WITH_T + ", b as (select *, cast(date_trunc('week', d) as date) as week from t), w as (select week, count(distinct id) n, avg(rating) mean from (select distinct week, id, rating from b) group by 1), k as (select week, theme, count(distinct id) k from b where theme is not null group by 1, 2), j as (select theme, k / n share, mean from k join w using (week)) select theme, count(*) as weeks, round(corr(share, mean), 6) as correlation, round(regr_slope(mean, share), 6) as slope, round(regr_r2(mean, share), 6) as r2 from j group by theme")
def theme_weekly_corr(spark, sf):
    out = metrics.theme_correlation(themed(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("correlation", "slope", "r2")})


@query(WITH_D + "select series, count(*) filter (rating >= 4) as n_high, count(*) filter (rating >= 4 and channel = 'P') as n_wish, count(*) filter (rating >= 4 and channel = 'P') / nullif(count(*) filter (rating >= 4), 0) as wish_share from r group by series")
def wish_share(spark, sf):
    return metrics.wish_share(with_device(spark, sf), F.col("channel") == "P", "series")


@query(WITH_D + ", k as (select series as segment, count(*) as n, avg(rating) as mean from r group by 1 having count(*) >= 10), q as (select series as segment, id, row_number() over (partition by series order by length(device), id) nth from r qualify nth <= 2) select k.*, string_agg(q.id::varchar, ',' order by q.id::varchar) as quote_ids from k left join q using (segment) group by all")
def persona_evidence(spark, sf):
    return metrics.personas(with_device(spark, sf).select(F.col("series").alias("segment"), F.col("id").cast("string").alias("id"), "rating", F.col("device").alias("text")).withColumn("id", F.col("id").cast("long"))).withColumn("quote_ids", F.array_join(F.array_sort(F.split("quote_ids", ",")), ","))


@query(WITH_R + "select platform, region, count(*) as n, avg(rating) as mean from r group by 1, 2 having count(*) >= 25")
def k_anonymous_regions(spark, sf):
    return metrics.generalize(reviews_of(spark, sf), ["platform", "region"], 25)


@query(WITH_T + f", a as ({_THEME}) select *, row_number() over (order by mentions desc, mean, theme) as rank, 'v1' as rule_version from a union all select theme || '*', mentions, mean, bad, share, row_number() over (order by mentions desc, mean, theme || '*'), 'v2' from a")
def rule_versions_compared(spark, sf):
    t = themed(spark, sf)
    return metrics.compare_versions(metrics.themes(t), metrics.themes(t.withColumn("theme", F.concat("theme", F.lit("*")))), "v1", "v2").select("theme", "mentions", "mean", "bad", "share", "rank", "rule_version")


@query(WITH_R + "select case when m < 2.2 then 'red' when m < 2.6 then 'orange' when m < 3.0 then 'blue' else 'green' end as colour, count(*) as n from (select d, avg(rating) m from r group by d) group by 1")
def colour_bands(spark, sf):
    return reviews_of(spark, sf).groupBy("d").agg(F.avg("rating").alias("m")).groupBy(R.colour(F.col("m")).alias("colour")).agg(F.count("*").alias("n"))


# Reviews ---------------------------------------------------------------------------------------------------------------

_LINES = "select l_orderkey * 8 + l_linenumber as row_idx, cast(l_linenumber as {s}) as list_pos, cast(cast(l_shipdate as date) as {s}) as published_at, l_returnflag as rating, l_linestatus as text, cast(l_suppkey as {s}) as region, '' as device from lineitem where l_quantity {q}"


@query(f"with u as (select 0 as f, * from ({_LINES.format(s='varchar', q='>= 25')}) union all select 1, * from ({_LINES.format(s='varchar', q='<= 26')})), k as (select * from u qualify row_number() over (partition by published_at, rating, text, region, device order by f, row_idx, list_pos) = 1) select published_at, rating, text, region, substr(published_at, 1, 7) as month, count(*) as n, min(list_pos) as list_pos from k group by all")
def combine_dedup(spark, sf):
    a, b = (P.view(spark, sf, _LINES.format(s="string", q=q)) for q in (">= 25", "<= 26"))
    lowest = F.min(F.struct(F.col("row_idx"), F.col("list_pos")))
    keys = ["published_at", "rating", "text", "region", "device"]
    one = lambda f: dealt(f, *keys).groupBy(*keys).agg(lowest.alias("m")).select("m.row_idx", "m.list_pos", *keys)  # noqa: E731  rows that share a number: the least position first
    out = reviews.combine(one(a), one(b))
    shown = ["published_at", "rating", "text", "region", "month"]
    return dealt(out, *shown).groupBy(*shown).agg(F.count("*").alias("n"), F.min("list_pos").alias("list_pos"))


@query(WITH_R + "select substr(cast(d as varchar), 1, 7) as month, row_number() over (partition by substr(cast(d as varchar), 1, 7) order by d desc, id desc) as seq, id from r")
def combine_order(spark, sf):
    r = P.view(spark, sf, P.REVIEWS).select("row_idx", F.col("id").cast("string").alias("list_pos"), F.col("d").cast("string").alias("published_at"), "id")
    return reviews.combine(r, identity=("id",)).select("month", "seq", F.col("id").cast("long").alias("id"))


@query(f"with p as ({P.POSITIONS}) select review, count(*) as rows, min(d) as date_min, max(d) as date_max, count(*) - count(distinct (pos, body, coalesce(rating::varchar, ''))) as duplicate_rows, max(pos) - min(pos) + 1 - count(distinct pos) as gap_count, count(*) filter (body = '') as missing_content, count(*) filter (rating is null) as missing_rating from p group by review")
def review_audit(spark, sf):
    return reviews.audit(P.view(spark, sf, P.POSITIONS), ["review"], ["pos", "body", "rating"], "d", "pos", "body", "rating")


@query(f"with p as (select distinct review, pos from ({P.POSITIONS})), s as (select review, min(pos) a, max(pos) b from p group by 1), m as (select review, unnest(range(a, b + 1)) pos from s), g as (select * from m anti join p using (review, pos)) select review, count(*)::hugeint::bigint as gap_count, string_agg(pos::varchar, ',' order by pos) as first_gaps from g group by review")
def position_gaps(spark, sf):
    out = reviews.position_gaps(P.view(spark, sf, P.POSITIONS), ["review"], "pos")
    return out.withColumn("first_gaps", F.array_join("first_gaps", ","))


@query(f"with s as ({P.SCREENS}) select idx, coalesce(arg_max(stars, seq) filter (stars <> ''), '') as stars, coalesce(arg_max(body, (length(body), seq)) filter (body <> ''), '') as body from s group by idx")
def keyed_upsert_longest(spark, sf):
    return reviews.upsert(P.view(spark, sf, P.SCREENS), "idx", "seq", ["stars"], "body")


@query("select doc_id, case when row_number() over (partition by text order by doc_id) > 1 then first_value(doc_id) over (partition by text order by doc_id) end as duplicate_of from documents")
def duplicate_of(spark, sf):
    d = evenly(spark.read.parquet(f"{sf}/documents.parquet")).select(F.col("doc_id").alias("row_idx"), "doc_id", "text")
    return reviews.duplicate_of(d, ["text"], "doc_id").select("doc_id", "duplicate_of")


@query("select c_custkey, substr(sha256(concat_ws('|', c_name, c_mktsegment)), 1, 16) as stable_id, '用户-' || substr(sha256('salt|' || c_name), 1, 8) as alias, 'sha256:' || sha256(concat_ws('|', c_name, c_mktsegment, c_nationkey::varchar)) as record_id from customer")
def stable_ids(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", X.stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("stable_id"), X.pseudonym("salt", F.lit(""), F.col("c_name")).alias("alias"), X.source_record_id(F.lit(None), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("record_id"))


_SIGHT = "select user_id as app, event_id % 500 + {k} as idx, cast(value as {s}) as post_info, event_type as stars, props as text from events"


@query(f"with s as ({_SIGHT.format(k=7, s='varchar')}), c as ({_SIGHT.format(k=0, s='varchar')}), p as (select c.app, s.idx - c.idx as o, c.idx x, s.idx y from s join c on s.app = c.app and s.post_info = c.post_info and s.stars = c.stars and (starts_with(s.text, c.text) or starts_with(c.text, s.text))), v as (select app, o, count(*) n, min((x, y)) f from p group by 1, 2) select app, o as \"offset\", n as votes, sum(n) over (partition by app)::bigint as pairs from v qualify row_number() over (partition by app order by n desc, f) = 1")
def index_offset_vote(spark, sf):
    s, c = (P.view(spark, sf, _SIGHT.format(k=k, s="string")) for k in (7, 0))
    return reviews.index_offset(s, c, ["app"])


@query("with a as (select user_id, event_id, event_type, case when lag(event_type) over w = event_type then 0 else 1 end c from events window w as (partition by user_id order by event_id)), b as (select *, sum(c) over (partition by user_id order by event_id) g from a) select user_id, event_type, min(event_id) as run_start, max(event_id) as run_end, count(*) as run_length from b group by user_id, event_type, g having count(*) >= 3")
def plateau_runs(spark, sf):
    return reviews.plateaus(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_id", "event_type", 3)


@query("select o_custkey as c, o_orderkey as k, min(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderkey) as lowest_date from orders")
def lowest_date(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    return reviews.lowest_date(o, ["c"], "k", "d").select("c", "k", "lowest_date")


@query("select o_custkey, max(cast(o_orderdate as date)) as newest from orders group by 1 having max(cast(o_orderdate as date)) < date '1999-01-01'")
def boundary_stop(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("d", F.col("o_orderdate").cast("date"))
    return reviews.before_boundary(o, ["o_custkey"], "d", F.lit("1999-01-01").cast("date"))


@query(WITH_R + "select cast(rating as varchar) as stars, count(*) as n from r where year(d) = 1997 and month(d) = 5 group by 1")
def month_histogram(spark, sf):
    return reviews.star_histogram(P.view(spark, sf, P.REVIEWS).where("year(d) = 1997 and month(d) = 5"))


# Inventories -----------------------------------------------------------------------------------------------------------

_KEY = "regexp_replace(feature, '[^a-z0-9]', '', 'g')"
_RANK = "case status when '明确缺失' then 5 when '部分可用' then 4 when '已验证存在' then 3 end"
_MERGED = f"select {_KEY} as key, arg_max(module, ({_RANK}, -row_idx)) as module, case when count(distinct status) > 1 then '状态冲突' else min(status) end as status from i where side = '{{side}}' group by 1"
WITH_I = f"with i as ({P.INVENTORY}) "


def _inventory(spark, sf, side=None, keyed=inventory.keyed):
    rows = P.view(spark, sf, P.INVENTORY, spread=("lineitem",))
    rows = rows if side is None else rows.where(F.col("side") == side)
    return keyed(rows.select("row_idx", F.col("module").alias("模块"), F.replace("feature", F.lit("|"), F.lit(" > ")).alias("功能路径"), F.col("status").alias("验证状态"), F.col("evidence").alias("证据文件")))


@query(WITH_I + ", " + "m as (" + _MERGED.format(side="F") + "), e as (select key, string_agg(evidence, '；' order by f) as evidence from (select " + _KEY + " as key, evidence, min((row_idx, evidence)) f from i where side = 'F' and evidence <> '' group by 1, 2) group by 1) select m.*, coalesce(e.evidence, '') as evidence from m left join e using (key)")
def inventory_merge(spark, sf):
    return inventory.merge(_inventory(spark, sf, "F", inventory.keyed_once)).select("key", "module", "status", "evidence")


_PARITY = WITH_I + ", l as (" + _MERGED.format(side="F") + "), r as (" + _MERGED.format(side="O") + "), j as (select coalesce(l.key, r.key) as key, coalesce(l.status, '未收录') as left_status, coalesce(r.status, '未收录') as right_status from l full join r on l.key = r.key), p as (select *, case when left_status in ('未收录', '状态冲突') or right_status in ('未收录', '状态冲突') then '待核验' when left_status = '明确缺失' and right_status = '明确缺失' then '双方均明确缺失' when left_status = '明确缺失' then 'A明确缺失' when right_status = '明确缺失' then 'B明确缺失' when left_status = '已验证存在' and right_status = '已验证存在' then '能力对齐' else '完整度差异' end as diff from j) "


def _matrix(spark, sf):
    return inventory.compare(inventory.merge(_inventory(spark, sf, "F", inventory.keyed_once)), inventory.merge(_inventory(spark, sf, "O", inventory.keyed_once)), "A", "B")


@query(_PARITY + "select * from p")
def inventory_parity(spark, sf):
    return _matrix(spark, sf).select("key", "left_status", "right_status", "diff")


@query(_PARITY + "select diff, count(*) as n from p group by diff")
def parity_counts(spark, sf):
    return inventory.diff_counts(_matrix(spark, sf))


@query(WITH_I + f", k as (select *, {_KEY} as key from i), g as (select key, count(*) n, count(distinct status) s, min(row_idx) f from k group by 1 having count(*) > 1) select row_idx + 2 as row_no, 'warning' as severity, 'no_evidence' as code from k where status in ('已验证存在', '部分可用') and evidence = '' union all select f + 2, 'warning', case when s > 1 then 'conflict' else 'duplicate' end from g")
def inventory_issues(spark, sf):
    return inventory.validate(_inventory(spark, sf, keyed=inventory.keyed_once)).where("code <> 'key_collision'").select("row_no", "severity", "code")


@query(WITH_I + ", l as (" + _MERGED.format(side="F") + "), c as (select 'PROMO' as module) select key, module, status, module = 'PROMO' as module_changed from l where status in ('部分可用', '明确缺失') or module = 'PROMO'")
def retest_list(spark, sf):
    return inventory.retest(inventory.merge(_inventory(spark, sf, "F", inventory.keyed_once)), spark.sql("select 'PROMO' as module"))


@query(WITH_I + "select module, count(*) as rows, 0::bigint as unchecked, 0::bigint as blocked, 0::bigint as unlisted, count(*) filter (status = '明确缺失') as absent from i group by module")
def coverage_note(spark, sf):
    return inventory.coverage_note(_inventory(spark, sf))


@query(WITH_I + f"select {_KEY} as key, row_idx, evidence from i where status in ('已验证存在', '部分可用') and evidence not in (select 'e' || s_suppkey::varchar from supplier where s_suppkey % 2 = 0)")
def evidence_missing(spark, sf):
    manifest = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 2 = 0").select(F.concat(F.lit("e"), F.col("s_suppkey")).alias("evidence"))
    return inventory.missing_evidence(_inventory(spark, sf), manifest).select("key", "row_idx", "evidence")


# Threads ---------------------------------------------------------------------------------------------------------------

WITH_C = f"with c as ({P.THREADS}), r as (select *, last_value(case when is_root then comment_id end ignore nulls) over (partition by post_id order by ord rows unbounded preceding) as root_id from c) "


def _threads(spark, sf):
    return threads.nearest_roots(P.view(spark, sf, P.THREADS), "post_id", "ord", "is_root", "comment_id")


@query(WITH_C + "select post_id, ord, comment_id, root_id from r")
def thread_roots(spark, sf):
    return _threads(spark, sf).select("post_id", "ord", "comment_id", "root_id")


@query(WITH_C + "select c.post_id, c.ord, coalesce(p.label, '') as root_label, coalesce(length(p.text), 0) as root_length from r c left join r p on p.comment_id = c.root_id")
def root_context(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("post_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(F.when(F.col("is_root"), c), ignorenulls=True).over(w)
    return _threads(spark, sf).select("post_id", "ord", F.coalesce(carried(F.col("label")), F.lit("")).alias("root_label"), F.coalesce(carried(F.length("text")), F.lit(0)).alias("root_length"))


_COUNTS = "count(*) filter (label = 'pos') p, count(*) filter (label = 'neg') n, count(*) filter (label = 'mix') m"


@query(WITH_C + f", k as (select post_id, root_id, count(*) as comments, {_COUNTS} from r group by 1, 2) select post_id, root_id, comments, case when p + n + m = 0 then '中性/未判定' when n = 0 and m = 0 then '正向' when p = 0 and m = 0 then '负向' when p >= greatest(2, 2 * n + m) then '正向为主' when n >= greatest(2, 2 * p + m) then '负向为主' else '正负并存' end as thread_label from k")
def thread_labels(spark, sf):
    return threads.thread_labels(_threads(spark, sf), ["post_id", "root_id"], "label", ("pos", "neg", "mix"))


@query(WITH_C + f", k as (select count(*) as comments, count(distinct post_id) as posts, count(distinct (post_id, root_id)) filter (root_id is not null) as threads, {_COUNTS}, sum(n_likes) filter (label = 'pos') lp, sum(n_likes) filter (label = 'neg') ln, sum(n_likes) filter (label = 'mix') lm from r) select comments, posts, threads, p + n + m as directional, p as positive, coalesce(lp, 0)::bigint as likes_positive, round(p / (p + n + m), 4) as share_positive, n as negative, coalesce(ln, 0)::bigint as likes_negative, round(n / (p + n + m), 4) as share_negative, m as mixed, coalesce(lm, 0)::bigint as likes_mixed, round(m / (p + n + m), 4) as share_mixed, round(p / n, 4) as ratio from k")
def sentiment_summary(spark, sf):
    return threads.sentiment_summary(_threads(spark, sf).withColumnRenamed("root_id", "thread_id"), ("pos", "neg", "mix"))


_TOPICS = (("space", "ea|sh"), ("time", "tion"), ("law", "geb|heit"), ("sea", "eau"))
_TOPIC_SQL = "list_filter([" + ", ".join(f"case when regexp_matches(text, '(?i){p}') then '{n}' end" for n, p in _TOPICS) + "], lambda x: x is not null)"


@query(WITH_C + f", t as (select unnest(case when len({_TOPIC_SQL}) > 0 then {_TOPIC_SQL} else ['其他/未归类'] end) as topic, label, n_likes from r) select topic, count(*) as comments, sum(n_likes)::bigint as likes, count(*) filter (label = 'pos') as n_0, count(*) filter (label = 'neg') as n_1, count(*) filter (label = 'mix') as n_2 from t group by topic")
def topic_stats(spark, sf):
    rules = R.DEFAULT.with_topics(dict(_TOPICS))
    return threads.topic_stats(_threads(spark, sf).withColumn("topics", R.topics_for(F.col("text"), rules)), ("pos", "neg", "mix"))


@query(WITH_C + "select post_id, count(*) as comments, sum(n_likes)::bigint as likes from r group by 1 order by 2 desc, 3 desc, 1 limit 15")
def top_posts(spark, sf):
    return threads.top_posts(_threads(spark, sf))


@query(WITH_C + ", f as (select post_id, arg_min(ord + 3, ord) e, arg_min(n_likes, ord) c from r group by 1) select sum(e)::bigint as expected_comments, sum(c)::bigint as collected_comments, count(*) as posts from f")
def post_coverage(spark, sf):
    return threads.coverage(_threads(spark, sf).select("post_id", F.col("ord").alias("row_idx"), (F.col("ord") + 3).alias("expected_comments"), F.col("n_likes").alias("collected_comments")))


_WORDS = R.RuleSet(name="words", positive="thea|enat|eron", negative="idiot|scum|ndst", feature_word="tion|ing", absence="none|ored", ad_free="free", feature_gap="when|wish", info_question="where|which", solution="reset|shansh")


@query("with t as (select doc_id, regexp_matches(text, '(?i)thea|enat|eron') p, regexp_matches(text, '(?i)tion|ing') w, regexp_matches(text, '(?i)idiot|scum|ndst') or (regexp_matches(text, '(?i)none|ored') and regexp_matches(text, '(?i)tion|ing') and not regexp_matches(text, '(?i)free')) n, regexp_matches(text, '(?i)when|wish') g, regexp_matches(text, '(?i)where|which') q, regexp_matches(text, '(?i)reset|shansh') s from documents) select doc_id, case when p and n then '混合' when p then '正向' when n then '负向' when g and w then '负向' when q or s then '中性' else '待语境' end as sentiment, case when p or n then '高' when g and w then '中' when q or s then '高' else '低' end as confidence from t")
def rule_classify(spark, sf):
    d = evenly(spark.read.parquet(f"{sf}/documents.parquet"))
    return threads.classify(d.select("doc_id", "text"), "text", _WORDS).select("doc_id", "direct.sentiment", "direct.confidence")


@query("select conv_id as post_id, string_agg(distinct role, '；' order by role) as queries, min(turn) as row_idx, arg_min(text, turn) as post_title from conversations group by 1")
def post_query_dedup(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return threads.merge_queries(c.select(F.col("conv_id").alias("post_id"), F.col("turn").alias("row_idx"), F.col("role").alias("query"), F.col("text").alias("post_title")))


@query("select conv_id as post_id, turn as ord, conv_id::varchar || '-' || turn::varchar as comment_id, case when turn > 0 then conv_id::varchar || '-0' else '' end as parent_id, conv_id::varchar || '-0' as thread_id, case when turn > 0 then 1 else 0 end as level from conversations where conv_id in (select conv_id from conversations where turn = 0)")
def nested_flatten(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    reply = F.struct(F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.col("text"), F.col("turn"))
    tree = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", reply.alias("r"))))).alias("rs"), F.max(F.when(F.col("turn") == 0, F.struct(F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.col("text")))).alias("root")).where("root is not null")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("root.comment_id").alias("comment_id"), F.col("root.text").alias("text"), F.transform("rs", lambda x: x["r"]).alias("replies"))).alias("comments")))
    flat = threads.flatten(tree.select(F.col("conv_id").alias("row_idx"), F.parse_json(doc).alias("post")))
    turn = F.substring_index("comment_id", "-", -1).cast("long")
    return flat.select(F.col("row_idx").alias("post_id"), turn.alias("ord"), "comment_id", "parent_id", "thread_id", F.col("level").cast("int").alias("level"))


# Text, releases, tagging -----------------------------------------------------------------------------------------------


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as cleaned from documents")
def text_clean(spark, sf):
    return evenly(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.md5(X.clean(F.col("text"))).alias("cleaned"))


@query("select event_id, case event_id % 4 when 0 then floor(value)::bigint when 1 then trunc(value * 10000)::bigint when 2 then trunc(value * 1000)::bigint else 0 end as n from events")
def parse_count(spark, sf):
    v = F.col("value").cast("decimal(12,2)").cast("string")
    k = F.col("event_id") % 4
    shown = F.when(k == 0, v).when(k == 1, F.concat(v, F.lit("万"))).when(k == 2, F.concat(v, F.lit(" k"))).otherwise("none")
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", X.parse_count(shown).alias("n"))


@query("with o as (select o_orderkey, cast(o_orderdate as date) d from orders) select o_orderkey, case o_orderkey % 5 when 0 then d when 1 then date '1998-06-15' - 1 when 2 then date '1998-06-15' when 3 then make_date(case when month(d) > 6 then 1997 else 1998 end, month(d), least(day(d), 28)) else null end as shown_date, case when o_orderkey % 5 = 1 then '08:30' else '' end as shown_time from o")
def displayed_date(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey") % 5
    month_day = F.concat(F.month("d").cast("string"), F.lit("月"), F.least(F.dayofmonth("d"), F.lit(28)).cast("string"), F.lit("日 | somewhere"))
    shown = F.when(k == 0, F.date_format("d", "yyyy/M/d")).when(k == 1, "昨天 08:30 | x | y").when(k == 2, "3 小时前").when(k == 3, month_day).otherwise("2月30日")
    date, time = X.displayed_date(shown, F.lit("1998-06-15").cast("date"))
    return o.select("o_orderkey", date.alias("shown_date"), time.alias("shown_time"))


_RELEASE = "select o_orderkey as row_idx, 'app' || cast(o_custkey % 50 as {s}) as `应用`, case when o_orderstatus = 'F' then '正式' when o_orderstatus = 'O' then '测试' else '' end as `渠道`, case when o_orderkey % 3 = 0 then '' else substr(o_orderpriority, 1, 1) end as `版本号`, case when o_orderkey % 4 = 0 then substr(cast(o_orderdate as {s}), 1, 10) || ' ~ 2001-12-31' else substr(cast(o_orderdate as {s}), 1, 10) end as `时间`, case when o_orderkey % 7 = 0 then '' else 'page' end as `来源`, case when o_orderkey % 5 = 0 then '已验证' else '' end as `验证状态` from orders"
_CANON = _RELEASE.format(s="varchar").replace("`", '"')
WITH_V = f"""with a as ({_CANON}), v as (select row_idx, "应用" as app_name, case "渠道" when '正式' then '正式版' when '测试' then '测试计划' else '未知' end as release_channel, "版本号" as version, case when length("时间") = 10 and "渠道" = '正式' then "时间" else '' end as published_at, case when length("时间") > 10 then substr("时间", 1, 10) when "渠道" <> '正式' then "时间" else '' end as test_start, case when length("时间") > 10 then '2001-12-31' else '' end as test_end, "来源" as source, case when "验证状态" = '' then '待核验' else "验证状态" end as verification_status, 'HarmonyOS' as platform from a) """


def _releases(spark, sf):
    return releases.canonical(P.view(spark, sf, _RELEASE.format(s="string")))


@query(WITH_V + "select * from v")
def release_canonical(spark, sf):
    return _releases(spark, sf).select("row_idx", "app_name", "release_channel", "version", "published_at", "test_start", "test_end", "source", "verification_status", "platform")


@query(WITH_V + ", i as (select row_idx + 2 as row_no, unnest([case when version = '' and test_start = '' and test_end = '' then 'required:version|update_text|test' end, case when source = '' then 'required:source|evidence_file' end, case when verification_status = '已验证' then 'verified_without:update_text' end, case when verification_status = '已验证' and version = '' and release_channel <> '测试计划' then 'verified_without:version' end, case when row_number() over (partition by app_name, release_channel, version, published_at, test_start, test_end order by row_idx) > 1 then 'duplicate:row ' || (first_value(row_idx) over (partition by app_name, release_channel, version, published_at, test_start, test_end order by row_idx) + 2)::varchar end]) as issue from v) select row_no, issue from i where issue is not null")
def release_issues(spark, sf):
    return releases.validate(_releases(spark, sf)).select("row_no", F.concat_ws(":", "code", "field").alias("issue"))


@query(WITH_V + ", s as (select *, coalesce(nullif(published_at, ''), nullif(test_start, ''), test_end) as sort_date from v), u as (select * from s qualify row_number() over (partition by app_name, release_channel, version, published_at, test_start, test_end order by sort_date desc, version desc, release_channel desc, row_idx) = 1) select app_name, row_idx, sort_date, row_number() over (partition by app_name order by sort_date desc, version desc, release_channel desc, row_idx) as nth from u")
def release_timeline(spark, sf):
    return releases.timeline(_releases(spark, sf)).select("app_name", "row_idx", "sort_date", "nth")


_TAG = "select d.doc_id as row_idx, source as channel, 'app' as app_id, lang as province, case when quality is null then null else quality * 4 + 1 end as rating, text from documents d left join labels l on d.doc_id = l.doc_id"


@query(f"with r as ({_TAG}), n as (select *, row_number() over (partition by channel, province, rating, text order by row_idx) nth, first_value(row_idx) over (partition by channel, province, rating, text order by row_idx) f from r) select row_idx, rating is not null and nth = 1 as is_valid, case when rating is null then '缺少评分' when nth > 1 then '重复评论' end as invalid_reason, case when nth > 1 then f end as first_row from n")
def tag_validity(spark, sf):
    r = P.view(spark, sf, _TAG, spread=("documents",)).withColumns({"date": F.lit(""), "device": F.lit(""), "rating_text": F.lit(""), "source_record_id": F.lit("")})
    t = tagging.tag(r)
    first = t.where("duplicate_of is null").select(F.col("source_record_id").alias("duplicate_of"), F.col("row_idx").alias("first_row"))
    return t.join(first, "duplicate_of", "left").select("row_idx", "is_valid", "invalid_reason", "first_row")


@query(f"with r as ({_TAG}), n as (select *, row_number() over (partition by channel, province, rating, text order by row_idx) nth from r) select channel, count(*) as raw, count(*) filter (nth > 1) as duplicates, count(*) filter (nth = 1 and rating is null) as invalid, count(*) filter (nth = 1 and rating is not null) as valid from n group by 1")
def funnel_counts(spark, sf):
    r = P.view(spark, sf, _TAG, spread=("documents",)).withColumns({"date": F.lit(""), "device": F.lit(""), "rating_text": F.lit(""), "source_record_id": F.lit("")})
    return metrics.funnel(tagging.tag(r), ["channel"])


@query("select doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]') as email, regexp_matches(text, '/home/|/Users/|[A-Z]:\\\\Users\\\\') as path, regexp_matches(text, '(?i)(?:password|passwd|secret|token|api[_-]?key)\\s*[:=]') as secret from documents")
def pii_flags(spark, sf):
    f = tagging.pii_flags(F.col("text"))
    return evenly(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", f["email"].alias("email"), f["path"].alias("path"), f["secret"].alias("secret"))


@query("select page_id, unnest(range(len(a)))::int as nth, unnest(list_transform(a, lambda x: regexp_extract(x, 'href=\"([^\"]*)\"', 1))) as href, unnest(list_transform(a, lambda x: regexp_extract(x, '>([^<]*)<', 1))) as label from (select page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') a from pages)")
def page_links(spark, sf):
    return readers.links(spark.read.parquet(f"{sf}/pages.parquet"))


@query("select user_id as screen, (event_id % 6)::int as idx, coalesce(arg_max(event_type, event_id), '') as Stars, coalesce(arg_max(props, event_id), '') as Text from events group by 1, 2")
def ui_tree_fields(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("idx", F.col("event_id") % 6)
    node = lambda field, value: F.struct(F.struct(F.concat(F.lit(f"CommentDetail{field}"), F.col("idx").cast("string")).alias("key"), value.alias("text")).alias("attributes"))
    nodes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.array(node("Stars", F.col("event_type")), node("Text", F.col("props"))).alias("n")))), lambda x: x["n"]))
    trees = e.groupBy(F.col("user_id").alias("screen")).agg(nodes.alias("children")).select("screen", F.parse_json(F.to_json(F.struct("children"))).alias("tree"))
    return readers.review_fields(readers.ui_nodes(trees)).select("screen", "idx", "Stars", "Text")


# Gates, reports and captures --------------------------------------------------------------------------------------------


@query(WITH_R + ", g as (select region, platform, count(*) filter (rating = 1) / count(*) > 0.2 as passed from r group by 1, 2) select region, platform, count(*) as n, avg(rating) as mean from r semi join (select * from g where passed) using (region, platform) group by 1, 2")
def admitted_modules(spark, sf):
    r = reviews_of(spark, sf)
    gate = r.groupBy("region", "platform").agg((F.count_if(F.col("rating") == 1) / F.count("*") > 0.2).alias("passed"))
    return metrics.admit(r, gate, ["region", "platform"]).groupBy("region", "platform").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"))


@query(WITH_R + "select region, d, count(distinct channel) as channels from r group by 1, 2 having count(distinct channel) > 1")
def mixed_channels(spark, sf):
    return metrics.one_channel(reviews_of(spark, sf), ["region", "d"])


_CLAIMS = "select * from (values ('most trade', 'Overview', 'EUROPE'), ('least', 'Trend', 'ASIA'), ('nowhere', 'Trend', 'ATLANTIS')) as c(claim, section, metric)"


@query(f"with c as ({_CLAIMS}), a as (select r_name as metric, count(*) as value from nation join region on n_regionkey = r_regionkey group by 1) select metric, claim, section, value, case when value is not null then 'nation' end as source, value is not null as resolved from c left join a using (metric)")
def evidence_matrix(spark, sf):
    a = P.view(spark, sf, "select r_name as metric, count(*) as value, 'nation' as source from nation join region on n_regionkey = r_regionkey group by 1")
    return sinks.evidence_matrix(spark.sql(_CLAIMS), a)


@query("with t as (select doc_id, text, lang from documents) select 'text present' as \"check\", count(*) filter (text = '') = 0 as passed, (count(*) filter (text = ''))::varchar as detail from t union all select 'language known', count(*) filter (lang not in ('en', 'de')) = 0, (count(*) filter (lang not in ('en', 'de')))::varchar from t union all select 'quotes have ids', count(*) filter (doc_id is null) = 0, (count(*) filter (doc_id is null))::varchar from t")
def quality_gates(spark, sf):
    d = evenly(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text", "lang")
    return issues.quality_checks(spark, {"text present": d.where("text = ''"), "language known": d.where("lang not in ('en', 'de')"), "quotes have ids": d.where("doc_id is null")})


@query("select user_id, min(event_id) as position, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, count(*) as seen from events group by user_id")
def dom_comments(spark, sf):
    return threads.dom_comments(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_id", ["event_type", "value"])


@query("select conv_id as post_id, count(*) + conv_id % 2 as expected, count(*) as collected, case when conv_id % 2 > 0 then '部分' else '完整' end as collection_status from conversations group by 1")
def collection_status(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").groupBy(F.col("conv_id").alias("post_id")).agg(F.count("*").alias("collected"))
    return threads.completeness(c.select("post_id", (F.col("collected") + F.col("post_id") % 2).alias("expected"), "collected"))


@query("select user_id as screen, event_type as key, props as text, count(*) as n from (select distinct user_id, event_type, props, value % 2 > 1 as b from events) group by all")
def visible_text(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    attributes = F.struct(F.col("event_type").alias("key"), F.lit("").alias("text"), F.col("props").alias("originalText"), (F.col("value") % 2 > 1).cast("string").alias("bounds"), F.lit("t").alias("type"))
    trees = e.groupBy(F.col("user_id").alias("screen")).agg(F.to_json(F.struct(F.collect_list(F.struct(attributes.alias("attributes"))).alias("children"))).alias("j"))
    nodes = readers.ui_nodes(trees.select("screen", F.parse_json("j").alias("tree")))
    return readers.visible_text(nodes).groupBy("screen", "key", "text").agg(F.count("*").alias("n"))


@query("select o_orderpriority as device, o_orderstatus as level, case o_orderstatus when 'F' then 5 when 'O' then 3 else 1 end as rating, count(*) as n from orders group by 1, 2")
def rating_words(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    words = R.lookup(F.col("o_orderstatus"), {"F": "非常棒", "O": "还可以", "P": "非常差"})
    return o.select(F.col("o_orderpriority").alias("device"), F.col("o_orderstatus").alias("level"), tagging.rating(F.lit(None), words).alias("rating")).groupBy("device", "level", "rating").agg(F.count("*").alias("n"))


@query("select doc_id from documents where ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 100 < 10")
def qa_sample(spark, sf):
    return tagging.qa_sample(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), "doc_id", 10)


@query("with s as (select doc_id, lang, source from documents where ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 100 < 10), b as (select 'lang' as field, lang <> coalesce(nullif(lang, 'fr'), 'de') bad from s union all select 'source', false from s) select field, count(*) as checked, count(*) filter (bad) as wrong, count(*) filter (bad) / count(*) as error_rate, count(*) filter (bad) / count(*) > 0.1 as redo from b group by 1")
def qa_result(spark, sf):
    s = tagging.qa_sample(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source"), "doc_id", 10)
    checked = s.withColumn("lang", F.when(F.col("lang") == "fr", "de").otherwise(F.col("lang")))
    return tagging.qa_result(s, checked, "doc_id", ["lang", "source"])


@query("select doc_id, md5(trim(nfc_normalize(text), e' \\t\\n\\r')) as k from documents")
def nfkc_keys(spark, sf):
    return evenly(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.md5(X.nfkc(F.col("text"))).alias("k"))


@query("select doc_id, md5(trim(replace(text, chr(13) || chr(10), chr(10)), e' \\t\\n\\r')) as k from documents")
def mojibake(spark, sf):
    """Texts that are spoilt on purpose, UTF-8 read as GBK, come back as they were."""

    @F.arrow_udf("string")
    def spoil(texts: pa.Array) -> pa.Array:
        def one(t):
            try:
                return t and t.encode().decode("gbk")
            except UnicodeDecodeError:
                return t  # no reading as GBK: such a text is never spoilt

        return pa.array((one(x.as_py()) for x in texts), pa.string())

    d = evenly(spark.read.parquet(f"{sf}/documents.parquet"))
    return d.select("doc_id", F.md5(X.repair_mojibake(spoil("text"))).alias("k"))


#: Whole texts with a phrase of the vocabularies behind each, as the driver's prose has none.
_PHRASES = ("闪退了", "没有歌词功能", "太难用", "发热耗电", "开屏广告", "鸿蒙适配很棒", "好看 谢谢", "建议增加倍速", "还行吧", "Spotify 比这个好", "什么时候上车机？", "垃圾 退款", "网易云音乐有")
_TAG_ZH = _TAG.replace("rating, text from", "rating, text || ' ' || case d.doc_id % 13 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PHRASES)) + " end as text from")


def _sql_has(p: str, of: str = "t") -> str:
    return f"regexp_matches({of}, '(?i){p}')"


def _sql_first(table, other: str) -> str:
    return "case " + " ".join(f"when {_sql_has(p)} then '{n}'" for p, n in table) + f" else {other} end"


_HEATED, _GOOD = _sql_has(R.HEATED), _sql_has(R.POSITIVE)
_LABELS = (
    f"with r as ({_TAG_ZH}), c as (select *, regexp_replace(text, '\\s+', ' ', 'g') t from r) select row_idx, {_sql_first([(p, n) for n, p in R.ISSUE_TYPES], chr(39) + '吐槽抱怨' + chr(39))} as issue_type, "
    f"case when {_sql_has(R.URGENT)} then '高' when rating <= 2 then '中' else '低' end as urgency, "
    f"case when {_HEATED} then -2 when {_GOOD} and not rating <= 2 then case when rating = 5 then 2 else 1 end when rating <= 2 then -1 else 0 end as emotion, "
    f"case when {_sql_has(R.QUESTION)} then '求助提问' when {_sql_has('希望|建议|什么时候')} then '功能许愿' when {_sql_has('比|不如')} then '对比抱怨' when {_HEATED} then '情绪宣泄' when {_sql_has('哈哈|笑死')} then '调侃玩梗' else '理性评价' end as expression, "
    f"coalesce(nullif(concat_ws(',', {', '.join(f'case when {_sql_has(p)} then {chr(39)}{n}{chr(39)} end' for n, p in R.MODULES.items())}), ''), '其他') as modules, {_sql_first(R.COMPETITORS, 'null')} as competitor, 'compat-v1' as taxonomy_version from c"
)


@query(_LABELS)
def tag_labels(spark, sf):
    r = P.view(spark, sf, _TAG_ZH, spread=("documents",)).withColumns({"date": F.lit(""), "device": F.lit(""), "rating_text": F.lit(""), "source_record_id": F.lit("")})
    return tagging.tag(r).select("row_idx", "issue_type", "urgency", "emotion", "expression", F.array_join("modules", ",").alias("modules"), "competitor", "taxonomy_version")


@query("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def stream_daily(spark, sf):
    folder = _folder(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).format("parquet").load(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch, epoch):  # the whole result so far replaces the one before
        batch.write.mode("overwrite").parquet(f"{folder}/days")

    daily = incremental.daily(stream, "ts")
    daily.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/days").select(F.col("day").cast("date").alias("day"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


# Threads from JSON to summary ---------------------------------------------------------------------------------------------

#: What the comments of a conversation say: one phrase for each turn, chosen by conversation, turn and length of its text.
_SAID = ("闪退", "好看", "好看但是卡顿", "什么时候适配", "哪个版本", "可以在设置里关闭", "😍", "。。。", "确实", "不是", "谢谢", "回复 小明：同感", "", "嗯嗯啊", "没有歌单", "🙄", "音质好听 会员太贵")
_COMMENTS = "select conv_id, turn, role = 'user' as is_root, case (conv_id * 7 + turn * 3 + length(text)) % 17 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(_SAID)) + " end as said, length(text) % 50 as likes, case conv_id % 3 when 0 then '正向' when 1 then '负向' else '' end as stance from conversations"
_ROLE = {"p": R.POSITIVE, "neg": R.NEGATIVE, "ab": R.ABSENCE, "w": R.FEATURE_WORD, "free": R.AD_FREE, "gap": R.FEATURE_GAP, "ask": R.INFO_QUESTION, "sol": R.SOLUTION, "up": R.POS_EMOJI, "down": R.NEG_EMOJI, "rel": R.RELIEF, "dis": R.DISAGREE}
_BY_ITSELF = (
    ("p and n", "混合", "褒贬并陈", "高", "mixed"),
    ("p", "正向", "赞美/认可", "高", "positive"),
    ("n and w", "负向", "功能缺口/投诉", "高", "negative"),
    ("n", "负向", "批评/不满", "高", "negative"),
    ("gap and w", "负向", "功能需求/期待改进", "中", "gap"),
    ("ask", "中性", "求助/版本询问", "高", "question"),
    ("sol", "中性", "解释/解决方案", "高", "solution"),
    ("up and not down", "正向", "情绪表达", "中", "up"),
    ("down and not up", "负向", "情绪表达", "中", "down"),
)
_SIDES = "('正向', '负向', '混合')"
_PACK = "struct_pack(s := {0}, i := '{1}', c := '{2}', r := {3})"
_DIRECT = "case " + " ".join(f"when {c} then " + _PACK.format(f"'{s_}'", i, k, f"'{R.REASONS[x]}'") for c, s_, i, k, x in _BY_ITSELF) + " else " + _PACK.format("'待语境'", "待语境", "低", f"'{R.REASONS['open']}'") + " end"


def _about(key: str, label: str) -> str:
    return f"replace('{R.REASONS[key]}', '%s', {label})"


_AS_ROOT = f"case when d.s <> '待语境' then d when agr and stance in {_SIDES} then {_PACK.format('stance', '回应帖子/赞同', '中', _about('agrees_post', 'stance'))} when sig and stance in {_SIDES} then {_PACK.format('stance', '回应帖子/情绪表达', '低', _about('signs_post', 'stance'))} else d end"
_AS_REPLY = " ".join(
    [
        "case when d.s <> '待语境' then d",
        f"when agr and rs in {_SIDES} then {_PACK.format('rs', '赞同上级评论', '高', _about('agrees_root', 'rs'))}",
        f"when agr and rs = '中性' then {_PACK.format(repr('中性'), '赞同中性信息', '中', repr(R.REASONS['agrees_neutral']))}",
        f"when dis and rs = '负向' then {_PACK.format(repr('正向'), '反驳负面评价', '中', repr(R.REASONS['against_negative']))}",
        f"when dis and rs = '正向' then {_PACK.format(repr('负向'), '反驳正面评价', '中', repr(R.REASONS['against_positive']))}",
        f"when rel and rs = '负向' then {_PACK.format(repr('正向'), '问题缓解', '中', repr(R.REASONS['relief']))}",
        f"when sol then {_PACK.format(repr('中性'), '解释/解决方案', '高', repr(R.REASONS['solution_reply']))}",
        f"when sig and rs in {_SIDES} then {_PACK.format('rs', '回应上级评论/情绪表达', '低', _about('signs_root', 'rs'))}",
        "else d end",
    ]
)
WITH_P = (
    f"with c as ({_COMMENTS}), x as (select *, trim(regexp_replace(said, '^回复\\s+[^:：]+\\s*[:：]\\s*', '')) v, last_value(case when is_root then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) rt from c), "
    f"y as (select *, {', '.join(f'{_sql_has(p, chr(118))} {k}' for k, p in _ROLE.items())}, {_sql_has(R.AGREE, 'v')} or {_sql_has(R.AGREE_PREFIX, 'v')} agr, regexp_matches(v, '^[^\\p{{L}}]+$') sig from x where said <> ''), "
    f"z as (select * exclude (n0), {_DIRECT} d from (select *, (neg or (ab and w and not free)) n, 0 n0 from y)), "
    f"q as (select *, {_AS_ROOT} a from z), "
    "k as (select q.*, coalesce(t.said, '') root_text, coalesce(t.a.s, '') rs from q left join q t on t.conv_id = q.conv_id and t.turn = q.rt and t.is_root), "
    f"m as (select *, case when is_root then a else {_AS_REPLY} end f from k), "
    "o as (select conv_id::varchar as post_id, conv_id::varchar || '-' || turn::varchar as comment_id, conv_id::varchar || '-' || coalesce(rt, turn)::varchar as thread_id, case when is_root then '一级评论' else '回复1级' end as level, root_text, said as text, likes, d.s as rule_sentiment, f.s as context_sentiment, "
    f"case when f.s = '待语境' then '' else f.s end as final_sentiment, f.i as intent, coalesce(nullif(concat_ws('；', {', '.join(f'case when {_sql_has(p, chr(115) + chr(97) + chr(105) + chr(100))} then {chr(39)}{n}{chr(39)} end' for n, p in R.TOPICS.items())}), ''), '{R.OTHER_TOPIC}') as topics, f.r as reason, f.c as confidence, "
    "case when f.s = '待语境' or f.c = '低' or root_text = '' then 'yes' else 'no' end as needs_review, turn from m) "
)


def _prepared(spark, sf):
    c = P.view(spark, sf, _COMMENTS)
    comment = F.struct("turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("said").alias("text"), "likes", (~F.col("is_root")).alias("is_reply"))
    posts = c.groupBy("conv_id", "stance").agg(F.array_sort(F.collect_list(comment)).alias("comments"), F.count("*").alias("collected_comments"))
    body = F.struct(F.col("conv_id").alias("id"), "stance", F.lit(9).alias("expected_comments"), "collected_comments", "comments")
    return threads.prepare(posts.select(F.col("conv_id").alias("row_idx"), F.parse_json(F.to_json(body)).alias("post")))


@query(WITH_P + "select * exclude (turn, likes) from o")
def thread_prepare(spark, sf):
    return _prepared(spark, sf).select("post_id", "comment_id", "thread_id", "level", "root_text", "text", "rule_sentiment", "context_sentiment", "final_sentiment", "intent", "topics", "reason", "confidence", "needs_review")


_LABEL = "case when final_sentiment <> '' then final_sentiment when context_sentiment in ('', '待语境') then '未判定' else context_sentiment end"
_NAMES = {"positive": "正向", "negative": "负向", "mixed": "混合", "neutral": "中性", "undecided": "未判定"}


@query(
    WITH_P
    + f", l as (select *, {_LABEL} as label from o), g as (select count(distinct post_id) as posts, count(distinct (post_id, thread_id)) as threads, count(*) as comments, count(*) filter (label in {_SIDES}) as directional, "
    + ", ".join(f"count(*) filter (label = '{n}') as {k}, coalesce(sum(likes) filter (label = '{n}'), 0)::bigint as likes_{k}" for k, n in _NAMES.items())
    + ", count(*) filter (needs_review = 'yes') as needs_review, count(*) filter (label = '未判定') as unresolved from l), n as (select sum(k)::bigint as collected_comments from (select conv_id, count(*) k from c group by 1 having count(*) filter (said <> '') > 0))"
    + " select g.*, round(positive / directional, 4) as share_positive, round(negative / directional, 4) as share_negative, round(mixed / directional, 4) as share_mixed, round(positive / nullif(negative, 0), 4) as ratio, 9 * posts as expected_comments, collected_comments from g, n"
)
def thread_totals(spark, sf):
    return threads.summarize(_prepared(spark, sf).withColumn("row_idx", F.col("row_idx") * 100 + F.col("ord")))["totals"]


@query(WITH_P + f", l as (select *, {_LABEL} as label from o), t as (select unnest(string_split(topics, '；')) as topic, label, likes from l) select topic, count(*) as comments, sum(likes)::bigint as likes, " + ", ".join(f"count(*) filter (label = '{n}') as n_{i}" for i, n in enumerate(_NAMES.values())) + " from t group by 1")
def thread_topics(spark, sf):
    return threads.summarize(_prepared(spark, sf).withColumn("row_idx", F.col("row_idx") * 100 + F.col("ord")))["topics"]


@query(
    WITH_P
    + ", b as (select case when turn % 5 = 0 then '' else thread_id end th, case when turn % 7 = 0 then '?' else final_sentiment end fs, case when turn = 3 then '' else root_text end rx, level, needs_review from o), i as (select unnest([case when th = '' then 'error:missing:thread_id' end, case when fs not in ('', '正向', '负向', '混合', '中性', '未判定') then 'error:vocabulary:final_sentiment' end, case when needs_review = 'yes' and fs = '' then 'warning:unresolved:' end, case when level <> '一级评论' and rx = '' then 'warning:no_root:' end]) as issue from b) select issue, count(*) as n from i where issue is not null group by 1"
)
def thread_issues(spark, sf):
    turn = F.substring_index("comment_id", "-", -1).cast("int")
    rows = _prepared(spark, sf).withColumns({"thread_id": F.when(turn % 5 == 0, "").otherwise(F.col("thread_id")), "final_sentiment": F.when(turn % 7 == 0, "?").otherwise(F.col("final_sentiment")), "root_text": F.when(turn == 3, "").otherwise(F.col("root_text"))})
    return threads.validate(rows).groupBy(F.concat_ws(":", "severity", "code", "field").alias("issue")).agg(F.count("*").alias("n"))


# Files written and read back --------------------------------------------------------------------------------------------


@query("select (row_number() over (order by n_nationkey) - 1)::bigint as row_idx, n_nationkey::varchar as n_nationkey, n_name || ', \"x\"' || chr(10) || 'y' as n_name from nation")
def csv_round_trip(spark, sf):
    folder = _folder(spark)
    n = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", F.concat(F.col("n_name"), F.lit(', "x"\ny')).alias("n_name"))
    sinks.write_files(spark, folder, {"nation.csv": sinks.csv_text(n)})
    return readers.csv_table(spark, f"{folder}/nation.csv")


@query("select (row_number() over (order by n_nationkey) - 1)::bigint as row_idx, n_name as app_name, case when n_regionkey = 1 then '正式版' when n_regionkey = 2 then '测试计划' else '未知' end as release_channel, case when n_regionkey = 1 then '1996-01-' || lpad((n_nationkey + 1)::varchar, 2, '0') else '' end as published_at, case when n_regionkey <> 1 then '1996-01-' || lpad((n_nationkey + 1)::varchar, 2, '0') else '' end as test_start, 'page' as source from nation")
def json_updates(spark, sf):
    folder = _folder(spark)
    day = F.concat(F.lit("1996-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))
    channel = F.when(F.col("n_regionkey") == 1, "正式").when(F.col("n_regionkey") == 2, "测试").otherwise("")
    n = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").select(F.col("n_name").alias("应用名称"), channel.alias("渠道"), day.alias("时间"))
    sinks.write_files(spark, folder, {"updates.json": sinks.json_text(n, "updates")})
    rows = readers.update_records(spark, f"{folder}/updates.json", source="page")
    return rows.select("row_idx", "app_name", "release_channel", "published_at", "test_start", "source")


@query("with e as (select user_id % 97 as u, event_id % 6 as i, arg_max(event_type, event_id) as s, arg_max(props, event_id) as t from events group by 1, 2) select 'screen_' || lpad(u::varchar, 4, '0') || '.json' as screen, (i + u % 3 - 1)::int as idx, s as Stars, t as Text from e where i + u % 3 - 1 >= 0")
def screen_files(spark, sf):
    folder = _folder(spark)
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("user_id") % 97).alias("u"), (F.col("event_id") % 6).alias("i")).agg(F.max_by("event_type", "event_id").alias("s"), F.max_by("props", "event_id").alias("t"))
    node = lambda field, value: F.struct(F.struct(F.concat(F.lit(f"CommentDetail{field}"), F.col("i").cast("string")).alias("key"), F.col(value).alias("text")).alias("attributes"))
    trees = e.groupBy("u").agg(F.to_json(F.struct(F.flatten(F.collect_list(F.array(node("Stars", "s"), node("Text", "t")))).alias("children"))).alias("j"))
    name = F.concat(F.lit("screen_"), F.lpad(F.col("u").cast("string"), 4, "0"), F.lit(".json"))
    screens = trees.select(name.alias("n"), "j").collect()  # 97 files
    sinks.write_files(spark, folder, {r["n"]: r["j"] for r in screens} | {"screen_broken.json": "{"})
    offsets = trees.select(name.alias("screen"), (F.col("u") % 3 - 1).cast("int").alias("shift"))
    return readers.screens(spark, folder, offsets)[0].select("screen", "idx", "Stars", "Text")


@query("with e as (select *, case when rating <= 2 then 'low' else 'high' end as c from (" + P.REVIEWS + ")) select c as channel, count(*) as n, sum(rating)::bigint as stars, min(region) as first_region from e group by 1")
def tagged_files(spark, sf):
    folder = _folder(spark)
    r = reviews_of(spark, sf).withColumn("channel", F.when(F.col("rating") <= 2, "low").otherwise("high"))
    sinks.tagged(r.select("channel", "rating", F.array("region", "platform").alias("regions")), folder)
    back = readers.json_lines(spark, f"{folder}/jsonl", "channel string, rating int, regions array<string>")
    return back.groupBy("channel").agg(F.count("*").alias("n"), F.sum("rating").alias("stars"), F.min(F.col("regions")[0]).alias("first_region"))


@query(WITH_R + "select row_number() over (order by id) as seq, id as list_pos, cast(d as varchar) || ' 08:30' as published_at, rating, region from r where year(d) = 1997 and month(d) = 5")
def month_rows(spark, sf):
    r = reviews_of(spark, sf)
    shown = F.concat(F.date_format("d", "yyyy/M/d"), F.lit(" 08:30 | "), F.col("region"), F.lit(" | phone"))
    fields = r.select(F.col("id").alias("idx"), F.lit("someone").alias("Username"), F.col("rating").cast("string").alias("Stars"), F.lit("").alias("StarMessage"), F.lit("t").alias("Text"), shown.alias("PostInfo"))
    return reviews.assemble(fields, F.lit("2001-12-31").cast("date"), (1997, 5)).select(F.col("seq").cast("long").alias("seq"), "list_pos", "published_at", "rating", "region")


@query("select (event_id % 997)::int as idx, arg_max(event_type, event_id) as Stars, arg_max(props, (length(props), event_id)) as Text from events group by 1")
def stream_collected(spark, sf):
    folder = _folder(spark)
    e = spark.read.parquet(f"{sf}/events.parquet")
    partial = e.select((F.col("event_id") % 997).cast("int").alias("idx"), F.col("event_id").cast("int").alias("seq"), F.lit("u").alias("Username"), F.col("event_type").alias("Stars"), F.lit("").alias("StarMessage"), F.col("props").alias("Text"), F.lit("today").alias("PostInfo"))
    partial.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(partial.schema).parquet(f"{folder}/in")
    incremental.collect_screens(stream, f"{folder}/target", f"{folder}/checkpoint", align=False).awaitTermination()
    return incremental.current(spark, f"{folder}/target").select("idx", "Stars", "Text")


@query(WITH_V + "select app_name, count(*) as n from v where verification_status = '已验证' group by 1")
def releases_verified(spark, sf):
    return releases.verified(_releases(spark, sf)).groupBy("app_name").agg(F.count("*").alias("n"))


# Themes, segments and gaps ------------------------------------------------------------------------------------------------


@query(WITH_T + ", q as (select theme, 'r' || cast(id % 1000 as varchar) as text, id from t where theme is not null), u as (select theme, text, min(id) as id from q group by 1, 2), n as (select *, row_number() over (partition by theme order by length(text), id) as nth from u) select theme, nth, id, text from n where nth <= 2")
def theme_quotes(spark, sf):
    t = themed(spark, sf).where("theme is not null").withColumn("text", F.concat(F.lit("r"), (F.col("id") % 1000).cast("string")))
    return metrics.quotes(t, "theme")


@query(
    WITH_T
    + ", w as (select *, cast(date_trunc('week', d) as date) as week from t), n as (select week, count(distinct id) as n from w group by 1), s as (select w.week, theme, count(distinct id) / min(n.n) as share from w join n using (week) where theme is not null group by 1, 2), p as (select theme, week as peak_week, share as peak_share from s qualify row_number() over (partition by theme order by share desc, week) = 1) select theme, peak_week, peak_share, min(week) as first_week, max(week) as last_week, count(*) filter (week <= peak_week) as weeks_rising, count(*) filter (week > peak_week) as weeks_falling, count(*) filter (share >= peak_share / 2) as weeks_high from s join p using (theme) group by 1, 2, 3"
)
def theme_lifecycle(spark, sf):
    return metrics.lifecycle(themed(spark, sf))


@query(WITH_T + ", k as (select theme from t where theme is not null group by 1 order by count(distinct id) desc, avg(rating), theme limit 5) select cast(date_trunc('week', d) as date) as week, theme, count(distinct id) as mentions, avg(rating) as mean from t where theme in (select theme from k) group by 1, 2")
def theme_trend(spark, sf):
    return metrics.theme_trend(themed(spark, sf), 5)


@query(WITH_R + "select case region when 'FRANCE' then 'west' when 'GERMANY' then 'west' when 'JAPAN' then 'east' when 'CHINA' then 'east' else '其他' end as region, platform as device_series, cast(date_trunc('week', d) as date) as week, count(*) as n, avg(rating) as mean from r group by 1, 2, 3 having count(*) >= 5")
def shareable_weeks(spark, sf):
    r = reviews_of(spark, sf).withColumn("device_series", F.col("platform"))
    return metrics.shareable(r, {"FRANCE": "west", "GERMANY": "west", "JAPAN": "east", "CHINA": "east"}, 5)


@query(WITH_R + ", c as (select region, platform, count(*) n, row_number() over (partition by region order by count(*) desc, platform) k from r group by 1, 2), a as (select region, channel, row_number() over (partition by region order by count(*) desc, channel) k from r group by 1, 2) select r.region as segment, count(*) as n, avg(rating) as mean, count(*) filter (rating = 1) as n_risk, count(*) filter (rating = 1) >= 0.1 * count(*) as high_risk, min(c.platform) as top_device, min(a.channel) as top_ask from r join c on c.region = r.region and c.k = 1 join a on a.region = r.region and a.k = 1 group by 1 having count(*) >= 10")
def persona_devices(spark, sf):
    r = reviews_of(spark, sf).select(F.col("region").alias("segment"), "id", "rating", F.lit("t").alias("text"), F.col("platform").alias("device"), F.col("channel").alias("ask"))
    return metrics.personas(r, risk=F.col("rating") == 1).drop("quote_ids")


@query(_PARITY + ", f as (select key, left_status l, right_status r from p), g as (select key as feature_id, case when l = '明确缺失' and r in ('已验证存在', '部分可用') then 'absent' when l = '部分可用' and r = '已验证存在' then 'partial' when l in ('已验证存在', '部分可用') and r = '明确缺失' then 'ahead' end as gap_status from f) select feature_id, gap_status from g where gap_status is not null")
def gap_status(spark, sf):
    return inventory.gap_status(_matrix(spark, sf))


@query(WITH_I + "select status, count(*) as n from i group by 1")
def status_histogram(spark, sf):
    return inventory.status_histogram(_inventory(spark, sf))


@query(WITH_T + f", m as (select theme, count(distinct id) n, avg(rating) mean, count(*) filter (rating <= 2) / count(*) bad from t where theme is not null group by 1), k as (select *, row_number() over (order by n desc, mean, theme) rank from m) select theme, case when rank = 2 then '{R.NATURES[4]}' when rank = 1 then '{R.NATURES[0]}' when mean < 2.2 then '{R.NATURES[1]}' when mean >= 4 then '{R.NATURES[5]}' else '{R.NATURES[3]}' end as nature from k")
def theme_nature(spark, sf):
    t = metrics.themes(themed(spark, sf))
    gap = F.when(F.col("rank") == 1, "absent")
    return t.select("theme", R.theme_nature(F.col("theme"), F.col("rank"), F.col("mean"), F.col("bad"), gap, F.col("rank") == 2).alias("nature"))


@query("select (event_id % 500)::bigint as idx from events where event_id % 2 = 0 group by 1 having count(*) > 0 intersect select (event_id % 300)::bigint from events")
def page_overlap(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return reviews.overlap(e.select((F.col("event_id") % 300).alias("idx")), e.where("event_id % 2 = 0").select((F.col("event_id") % 500).alias("idx")))


@query(WITH_R + "select count(*) as rows, min(cast(d as varchar)) as date_min, max(cast(d as varchar)) as date_max, count(*) - count(distinct (d, rating, region, platform)) as duplicate_rows, max(id) - min(id) + 1 - count(distinct id) as gap_count, 0::bigint as missing_content, 0::bigint as missing_rating, '1:' || count(*) filter (rating = 1) || ',2:' || count(*) filter (rating = 2) || ',3:' || count(*) filter (rating = 3) || ',4:' || count(*) filter (rating = 4) || ',5:' || count(*) filter (rating = 5) as stars from r")
def file_audit(spark, sf):
    text = lambda c: F.col(c).cast("string")
    r = reviews_of(spark, sf).select("row_idx", text("id").alias("list_pos"), text("d").alias("published_at"), text("rating").alias("rating"), F.lit("t").alias("text"), "region", F.col("platform").alias("device"))
    out = reviews.audit_file(r)
    return out.withColumn("stars", F.array_join(F.transform(F.map_entries("stars"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")).drop("first_gaps")


@query(WITH_T + ", m as (select theme, count(distinct id) n, avg(rating) mean, count(*) filter (rating <= 2) / count(*) bad from t where theme is not null group by 1) select theme, case when mean < 2.2 then 'red' when mean < 2.6 then 'orange' when mean < 3 then 'blue' else 'green' end as colour, printf('%d · %.2f · %.1f%%', n, mean, 100 * bad) as label from m")
def chart_themes(spark, sf):
    r = reviews_of(spark, sf)
    t = metrics.themes(themed(spark, sf))
    devices = metrics.by_key(r.withColumn("device", F.col("platform")), "device")
    heat = spark.createDataFrame([], "theme string, a double")
    frames = sinks.chart_frames(metrics.weekly(r), P.view(spark, sf, P.RELEASES), t, metrics.reversal(themed(spark, sf), P.view(spark, sf, _FEATURE)), devices, metrics.distribution(r), heat)
    return frames["figure_2"].select("theme", "colour", "label")


# Report lines, inventory fields and small rules -----------------------------------------------------------------------------


def _lines(spark, text: str):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "nth long, line string")


_NATION_RELEASES = "select n_name as app_name, '' as package_name, 'HarmonyOS' as platform, case n_regionkey when 0 then '正式版' when 1 then '内测版' when 2 then '公测版' when 3 then '未知' else '怪' end as release_channel, cast(n_nationkey as {s}) as version, '' as version_code, '1996-01-' || lpad(cast(n_nationkey + 1 as {s}), 2, '0') as published_at, case when n_regionkey = 1 then '1996-01-01' else '' end as test_start, '' as test_end, 'note ' || n_name as update_text, '' as source_type, 'page' as source, '' as collected_at, '' as evidence_file, '已验证' as verification_status, '' as notes, n_nationkey as row_idx from nation"


@query(
    "with v as (" + _NATION_RELEASES.format(s="varchar") + "), h as (select unnest(['正式版', '尝鲜版', '内测版', '公测版', '测试计划', '未知', '怪']) c, unnest(range(7)) k), r as (select k, published_at, '- ' || published_at || ' ' || version || ': ' || update_text || case when test_start <> '' then chr(10) || '  - window ' || test_start || ' to ' else '' end || chr(10) || '  - evidence page' as t from v join h on c = release_channel), "
    "s as (select k, chr(10) || '## ' || case when k = 6 then 'Unsupported channel' else any_value(c) end || chr(10) as head, string_agg(t, chr(10) order by published_at desc) body from r join h using (k) group by k), o as (select '# Release timeline' || chr(10) || string_agg(head || chr(10) || body, chr(10) order by k) || chr(10) as doc from s) select unnest(range(len(string_split(doc, chr(10)))))::bigint as nth, unnest(string_split(doc, chr(10))) as line from o"
)
def release_report(spark, sf):
    rows = releases.timeline(P.view(spark, sf, _NATION_RELEASES.format(s="string")).withColumn("app_name", F.lit("one")))
    return _lines(spark, sinks.release_timeline(rows))


@query("with t as (select '# Parity' || chr(10) || chr(10) || '| diff | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || diff || ' | ' || n || ' |' || chr(10), '' order by diff) as doc from (" + _PARITY + "select diff, count(*) as n from p group by diff)) select unnest(range(len(string_split(doc, chr(10)))))::bigint as nth, unnest(string_split(doc, chr(10))) as line from t")
def parity_markdown(spark, sf):
    matrix = _matrix(spark, sf)
    return _lines(spark, sinks.parity_report(matrix.limit(0), inventory.diff_counts(matrix))["md"])


@query("with c as (select rating, count(*) n from (" + P.REVIEWS + ") where year(d) = 1997 and month(d) = 5 group by 1), l as (select k, '- ' || k || ': ' || coalesce(n, 0) as line from range(1, 6) x(k) left join c on rating = k) select k::bigint + 1 as nth, line from l")
def month_stars(spark, sf):
    r = reviews_of(spark, sf).where("year(d) = 1997 and month(d) = 5")
    files = sinks.month_report(spark.createDataFrame([], "a string"), reviews.star_histogram(r))
    return _lines(spark, files["md"]).where("line like '- _: %'")


_FIELDS = "select l_orderkey * 10 + l_linenumber as row_idx, case when p_size % 5 = 0 then ' F' || cast(p_partkey as {s}) else '' end as `标准功能ID`, p_type as `模块`, case when p_size % 3 = 0 then p_brand else '' end as `一级功能`, case when p_size % 3 = 0 then 'Ｘ' || p_type else '' end as `二级功能`, case when p_size % 3 = 1 then p_brand || ' / ' || p_type else '' end as `功能路径`, case p_size % 4 when 0 then '存在' when 1 then '入口已验证' when 2 then '' else '明确缺失' end as `验证状态`, case when p_size % 4 = 2 then '缺失' else '' end as `状态`, '' as `证据文件`, 'e' || cast(l_linenumber as {s}) as `证据ID`, '' as `备注` from lineitem join part on l_partkey = p_partkey"


@query("with f as (" + _FIELDS.format(s="varchar").replace("`", '"') + ") select row_idx, case when \"标准功能ID\" <> '' then lower(trim(\"标准功能ID\")) else regexp_replace(lower(case when \"一级功能\" <> '' then \"一级功能\" || '|x' || substr(\"二级功能\", 2) when \"功能路径\" <> '' then replace(\"功能路径\", ' / ', '|') else \"模块\" end), '[^a-z0-9]', '', 'g') end as key, case when \"一级功能\" <> '' then \"一级功能\" || ' > X' || substr(\"二级功能\", 2) when \"功能路径\" <> '' then replace(\"功能路径\", ' / ', ' > ') else '' end as path, case coalesce(nullif(\"验证状态\", ''), \"状态\") when '存在' then '已验证存在' when '入口已验证' then '仅入口存在' else '明确缺失' end as status, \"证据ID\" as evidence from f")
def inventory_fields(spark, sf):
    return inventory.keyed(P.view(spark, sf, _FIELDS.format(s="string"), spread=("lineitem",))).select("row_idx", "key", "path", "status", "evidence")


@query("with c as (select conv_id, turn, conv_id::varchar || '-' || turn::varchar as id, case when turn % 3 = 0 then '' else '文字' end as said, turn % 2 as images from conversations) select conv_id::varchar as post_id, id as comment_id, case when said = '' then '[图片评论]' else said end as text, case when said = '' then '账号与社交' else '其他/未归类' end as topics from c where said <> '' or images > 0")
def image_comments(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    images = F.when(F.col("turn") % 2 == 1, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))
    comment = F.struct("turn", F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 3 == 0, "").otherwise("文字").alias("content"), images.alias("image_urls"))
    posts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(comment)).alias("comments"))
    rows = threads.prepare(posts.select(F.col("conv_id").alias("row_idx"), F.parse_json(F.to_json(F.struct(F.col("conv_id").alias("note_id"), "comments"))).alias("post")))
    return rows.select("post_id", "comment_id", "text", "topics")


@query("select conv_id as post_id from conversations group by 1 having count(*) % 2 = 0")
def posts_to_resume(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").groupBy(F.col("conv_id").alias("post_id")).agg(F.count("*").alias("n"))
    return threads.resume(c, c.where("n % 2 = 1")).select("post_id")


@query("with p as (select user_id, max(cast(ts as date)) as newest, count(*) as screens from events group by 1) select unnest(['past', 'plateau', 'most', 'none']) as rule, unnest([(select arg_max(newest, user_id) from p) < date '2030-01-01', true, true, false]) as stop")
def stop_rules(spark, sf):
    p = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("screen")).agg(F.max(F.col("ts").cast("date")).alias("newest_date"), F.count("*").cast("string").alias("signature"))
    p = p.withColumn("signature", F.concat("signature", F.lit("-"), F.col("screen").cast("string")))
    early, late = F.lit("1990-01-01").cast("date"), F.lit("2030-01-01").cast("date")
    n = p.count()
    told = {"past": (p, late, n + 1), "plateau": (p.withColumn("signature", F.lit("same")), early, n + 1), "most": (p, early, n), "none": (p, early, n + 1)}
    return spark.createDataFrame([(k, incremental.should_stop(*v)) for k, v in told.items()], "rule string, stop boolean")


@query("select doc_id, case when regexp_matches(text, '(?i)tion') and regexp_matches(text, '(?i)heit') then 'a,b' when regexp_matches(text, '(?i)tion') then 'a' when regexp_matches(text, '(?i)heit') then 'b' else '其他/未归类' end as topics from documents")
def own_topics(spark, sf):
    folder = _folder(spark)
    sinks.write_files(spark, folder, {"topics.json": '{"a": "tion", "b": "heit"}'})
    config = readers.topic_config(spark.read.text(f"{folder}/topics.json", wholetext=True).first()[0])
    rules = R.DEFAULT.with_topics(config)
    return evenly(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.array_join(R.topics_for(F.col("text"), rules), ",").alias("topics"))


@query("select n_nationkey, coalesce(nullif(case when n_regionkey = 0 then '' else n_name end, ''), 'none') as picked, replace(replace(n_name || '|x' || chr(10) || 'y', '|', '\\|'), chr(10), '<br>') as cell, strlen(n_name) > 6 as long_name from nation")
def picked_cells(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    first = X.pick(F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_name")), F.lit(None).cast("string"), F.lit("none"))
    return n.select("n_nationkey", first.alias("picked"), X.markdown_cell(F.concat(F.col("n_name"), F.lit("|x\ny"))).alias("cell"), (F.length("n_name") > 6).alias("long_name"))


@query(
    f"with r as ({P.REVIEWS}), g as (select case when count(*) filter (rating is null) = 0 then true end a, count(*) n from r) select unnest(['an_has_weekly', 'an_has_themes', 'an_only_valid', 'an_priority_version', 'an_ranks_differ', 'an_shares', 'an_small_samples_marked']) as \"check\", unnest([n > 0, true, true, true, true, true, true]) as passed from g"
)
def analysis_gates(spark, sf):
    r, t = reviews_of(spark, sf).withColumn("is_valid", F.lit(True)), themed(spark, sf)
    facts = metrics.themes(t).withColumns({"gap_status": F.lit("absent"), "audience_class": F.lit("core"), "feasibility": F.lit("2w"), "risk_override": F.lit(False)})
    tables = {"rating_distribution": metrics.distribution(r), "weekly": metrics.weekly(r), "before_after": metrics.around_releases(r, P.view(spark, sf, P.RELEASES), 28), "themes": metrics.themes(t), "devices": metrics.by_key(r, "platform"), "regions": metrics.regions(r), "priorities": metrics.priority(facts)}
    tables["personas"] = metrics.personas(r.select(F.col("region").alias("segment"), "id", "rating", F.lit("t").alias("text")))
    checks = issues.quality_checks(spark, issues.analysis_gates(tables, r, metrics.quotes(t.withColumn("text", F.lit("q")), "theme")))
    shown = ["an_has_weekly", "an_has_themes", "an_only_valid", "an_priority_version", "an_ranks_differ", "an_shares", "an_small_samples_marked"]
    return checks.where(F.col("check").isin(shown)).select("check", "passed")


@query(f"with r as ({_TAG}), n as (select *, row_number() over (partition by channel, province, rating, text order by row_idx) nth from r) select unnest(['tag_rating_1_to_5', 'tag_invalid_has_reason', 'tag_one_first', 'tag_duplicate_known', 'tag_scales', 'tag_issue_type', 'tag_modules']) as \"check\", unnest([count(*) filter (nth = 1 and rating not between 1 and 5) = 0, true, true, true, true, true, true]) as passed, '0' as detail from n")
def tagging_gates(spark, sf):
    r = P.view(spark, sf, _TAG, spread=("documents",)).withColumns({"date": F.lit(""), "device": F.lit(""), "rating_text": F.lit(""), "source_record_id": F.lit("")})
    shown = ["tag_rating_1_to_5", "tag_invalid_has_reason", "tag_one_first", "tag_duplicate_known", "tag_scales", "tag_issue_type", "tag_modules"]
    return issues.tagging_gates(tagging.tag(r), R.DEFAULT).where(F.col("check").isin(shown))


@query("with r as (" + P.REVIEWS + "), q as (select id, '2001-02-03' as date, region, '' as device, case rating when 1 then '非常差' when 2 then '不太好' when 3 then '还可以' when 4 then '很不错' else '非常棒' end w, rating from r) select id as list_pos, '未知' as channel, region as province, date, rating from q")
def standard_fields(spark, sf):
    words = {1: "非常差", 2: "不太好", 3: "还可以", 4: "很不错", 5: "非常棒"}
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    r = reviews_of(spark, sf).select("row_idx", F.col("id").alias("list_pos"), F.lit("2001-02-03 10:11").alias("发布时间"), F.col("region").alias("地区"), F.lit("").alias("设备"), F.element_at(table, F.col("rating")).alias("评分描述"), F.lit("someone").alias("用户"), F.lit("").alias("评分"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("评论内容"))
    return tagging.tag(tagging.standard_fields(r)).select("list_pos", "channel", "province", "date", "rating")


# Queries of their own modules, registered as they are imported.
from plumbline.plans import collection, reports  # noqa: E402, F401
