"""Queries over reports: heat map, releases as files, gates of all three kinds counted one by one, report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.operators import issues, metrics, releases, tagging, threads
from plumbline.plans import proxies as P
from plumbline.plans.catalogue import _FACTS, _RELEASE, _TAG, _THEME, WITH_D, WITH_P, WITH_R, WITH_T, WITH_V, _folder, _prepared, _releases, priorities_of, query, reviews_of, themed, themes_by_id, with_device
from plumbline.sources import readers, sinks
from plumbline.sources.steps import once

_SERIES4 = ("colour", "drive", "age", "fastener")


@query(
    WITH_D
    + f", p as (select r.id, series as device, theme, rating from r left join ({P.THEMES}) t on r.id = t.id), k as (select theme from p where theme is not null group by 1 order by count(distinct id) desc, avg(rating), theme limit 3), c as (select device, theme, count(distinct id) as n from p where theme is not null group by 1, 2), a as (select device, count(distinct id) as t from p group by 1) select theme, "
    + ", ".join(f"coalesce(max(n / t) filter (device = '{s}'), 0) as {s}" for s in _SERIES4)
    + " from c join a using (device) where theme in (select theme from k) group by theme"
)
def heat_map(spark, sf):
    d = with_device(spark, sf).select("id", F.col("series").alias("device"), "rating")
    return metrics.heat_map(d.join(themes_by_id(spark, sf), "id", "left"), list(_SERIES4), k=3)


# Releases as files ----------------------------------------------------------------------------------------------------------

_UNIQUE = "u as (select * from (select *, coalesce(nullif(published_at, ''), nullif(test_start, ''), test_end) as sort_date from v) s qualify row_number() over (partition by app_name, release_channel, version, published_at, test_start, test_end order by sort_date desc, version desc, release_channel desc, row_idx) = 1)"


@query(
    WITH_V
    + f", {_UNIQUE}, n as (select *, row_number() over (order by sort_date desc, version desc, release_channel desc, row_idx) + 1 as row_no from u) select row_no, app_name, version, release_channel, len(list_filter([version = '' and test_start = '' and test_end = '', source = ''], lambda x: x))::bigint as errors, len(list_filter([verification_status = '已验证', verification_status = '已验证' and version = '' and release_channel <> '测试计划'], lambda x: x))::bigint as warnings from n"
)
def release_normalize(spark, sf):
    """Unique releases in the order of the file, each with its findings by severity."""
    rows, found = releases.normalize(P.view(spark, sf, _RELEASE.format(s="string")))
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    per = found.groupBy("row_no").agg(count("error"), count("warning"))
    return rows.select("row_no", "app_name", "version", "release_channel").join(per, "row_no", "left").na.fill(0, ["errors", "warnings"])


@query(
    WITH_V
    + f", {_UNIQUE}, n as (select *, row_number() over (order by sort_date desc, version desc, release_channel desc, row_idx) - 1 as row_idx2 from u), e as (select count(*) filter (source = '' or (version = '' and test_start = '' and test_end = '')) > 0 as bad from u) select row_idx2 as row_idx, app_name, release_channel, version, published_at, test_start, test_end, (select bad::int from e) as code from n"
)
def release_files(spark, sf):
    """The files that normalize writes, of any number of releases; rows come from the CSV, code is the run's exit code."""
    rows, found = releases.normalize(P.view(spark, sf, _RELEASE.format(s="string")))
    prefix = f"{_folder(spark)}/releases"
    code = sinks.release_files(rows, found, prefix)
    back = readers.update_records(spark, f"{prefix}.csv")
    return back.select("row_idx", "app_name", "release_channel", "version", "published_at", "test_start", "test_end", F.lit(code).alias("code"))


@query(
    WITH_V
    + f", {_UNIQUE}, h as (select unnest(['正式版', '尝鲜版', '内测版', '公测版', '测试计划', '未知']) as c, unnest(range(1, 7)) as k), l as (select k, app_name, row_number() over (partition by app_name order by sort_date desc, version desc, release_channel desc, row_idx) as nth, '- ' || coalesce(nullif(sort_date, ''), '?') || ' ' || version || ': ' || case when test_start <> '' or test_end <> '' then chr(10) || '  - window ' || test_start || ' to ' || test_end else '' end || case when source <> '' then chr(10) || '  - evidence page' else '' end as t from u join h on c = release_channel), "
    "d as (select '# Release timeline' || chr(10) || string_agg(x, '' order by k) as doc from (select l.k, chr(10) || '## ' || any_value(c) || chr(10) || chr(10) || string_agg(t || chr(10), '' order by app_name, nth) as x from l join h using (k) group by l.k)) select (i - 1)::bigint as nth, string_split(doc, chr(10))[i] as line from (select doc, unnest(range(1, len(string_split(doc, chr(10))))) as i from d)"
)
def release_timeline_file(spark, sf):
    path = f"{_folder(spark)}/timeline.md"
    sinks.timeline_file(releases.timeline(_releases(spark, sf)), path)
    from plumbline.operators.ordered import file_rows

    rows = file_rows(spark.read.text(path), "nth")
    return rows.select("nth", F.col("value").alias("line"))


# Gates ----------------------------------------------------------------------------------------------------------------------

# Claims of regions and months, some of a metric that no table has; a roadmap and targets with odd rows.
_CLAIM_ROWS = """select 'c' || n_nationkey as claim, case n_regionkey when 0 then 'Overview' when 1 then 'Trend' when 2 then 'Releases' when 3 then 'Themes' else 'Priorities' end as section, case when n_nationkey % 6 = 5 then 'nothing' else n_name end as metric from nation"""
_ROADMAP = "select case n_regionkey when 0 then 'immediate' when 1 then 'this quarter' when 2 then 'next quarter' when 3 then 'some day' else 'later' end as stage, n_name as goal from nation"
_TARGETS = "select n_name as metric, n_nationkey as now, case when n_nationkey % 7 = 0 then 'soon' else '4.' || n_regionkey end as target from nation"
_QUOTED = "select cast(o_orderkey + case when o_orderkey % 50 = 0 then 100000000 else 0 end as varchar(20)) as source_record_id from orders"
_LATE = "select * from (values ('1.0', date '1995-06-05'), ('2.0', date '1997-03-03'), ('9.0', date '2019-01-11')) as v(version, release_date)"


@query(
    WITH_T
    + f", c as ({_CLAIM_ROWS}), a as (select n_name as metric, count(*) as value from customer join nation on c_nationkey = n_nationkey group by 1), m as (select c.*, value is not null as ok from c left join a using (metric)), g as ({_FACTS}), q as ({_QUOTED}), w as ({_ROADMAP}), x as ({_TARGETS}), v as ({_LATE}), th as (select theme, avg(rating) mean from (select distinct id, theme, rating from t where theme is not null) group by 1), e as (select distinct version from v join t on t.d between release_date - 28 and release_date + 28), "
    "k as (select unnest(['rp_proposition', 'rp_summary', 'rp_sections', 'rp_figures', 'rp_releases_attributed', 'rp_levels', 'rp_priority_parts', 'rp_satisfied', 'rp_roadmap', 'rp_targets', 'rp_appendix', 'rp_claims_resolved', 'rp_quotes_traceable']) as \"check\", unnest([(select (count(*) = 0)::int from m where section = 'Overview' and ok), (select count(*) from m where section = 'Overview' and not ok), (select count(*) from (select unnest(['Overview', 'Trend', 'Releases', 'Themes', 'Devices and regions', 'Priorities', 'Roadmap']) s) where s not in (select section from m)), 1, (select count(*) from v where version not in (select version from e)), 0, 0, (select (count(*) = 0)::int from th where mean >= 3), (select count(*) from (select unnest(['immediate', 'this quarter', 'next quarter', 'long term']) s) where s not in (select stage from w)) + (select count(*) from w where stage not in ('immediate', 'this quarter', 'next quarter', 'long term')), (select count(*) from x where try_cast(target as double) is null), 1, (select count(*) from m where not ok), (select count(*) from q where source_record_id not in (select o_orderkey::varchar from orders))]) as n) select \"check\", n = 0 as passed, n::varchar as detail from k"
)
def report_gates(spark, sf):
    r = reviews_of(spark, sf)
    themes = once(metrics.themes(themed(spark, sf)))  # a few rows of a pass over all lines, which several gates read
    aggregates = P.view(spark, sf, "select n_name as metric, count(*) as value, 'customers' as source from customer join nation on c_nationkey = n_nationkey group by 1")
    matrix = sinks.evidence_matrix(P.view(spark, sf, _CLAIM_ROWS), aggregates)
    late = P.view(spark, sf, _LATE)
    weekly = metrics.weekly(r)
    figures = {1: weekly, 2: themes, 4: weekly.limit(0)}  # 4 is empty, 5 there
    figures[5] = metrics.distribution(r)
    method = spark.createDataFrame([(" ",)], "note string")
    quoted, records = P.view(spark, sf, _QUOTED.replace("varchar(20)", "string")), P.view(spark, sf, "select cast(o_orderkey as string) as source_record_id from orders")
    effects = metrics.around_releases(r, late, 28).where("n_before > 0 or n_after > 0")
    gates = issues.report_gates(matrix, priorities_of(spark, sf, themes), quoted, records, late, effects, themes, figures, P.view(spark, sf, _ROADMAP), P.view(spark, sf, _TARGETS), method, sinks.SECTIONS, sinks.STAGES)
    return issues.quality_checks(spark, gates)


_FAULTS = WITH_R + "select id, case when id % 11 = 0 then 6 else rating end as rating, d, region, platform, id % 13 <> 0 as is_valid from r"


@query(
    f"with f as ({_FAULTS}), s as (select case when rating = 6 then null else rating end as rating, count(*) as n from f group by 1), w as (select date_trunc('week', d) as week, count(*) as n from f group by 1), v as ({P.RELEASES}), th as (select theme, count(distinct id) as m from ({P.REVIEW_THEMES}) where theme is not null group by 1), "
    "k as (select unnest(['an_only_valid', 'an_has_rating_distribution', 'an_has_weekly', 'an_has_before_after', 'an_has_themes', 'an_has_devices', 'an_has_regions', 'an_has_personas', 'an_small_samples_marked', 'an_priority_version', 'an_shares', 'an_ranks_differ', 'an_quotes_traceable']) as \"check\", unnest([(select count(*) from f where not is_valid or rating not between 1 and 5), 0, (select (count(*) = 0)::int from w), (select (count(*) = 0)::int from v), (select (count(*) = 0)::int from th), (select (count(*) = 0)::int from f), 1, (select (count(*) = 0)::int from (select region from f group by 1 having count(*) >= 10)), (select count(*) from w where n < 20), (select count(*) from th), (select count(*) from (select theme, m, case when theme like 'S%' then -1 else 1 end as share from th) where share < 0), (select (count(*) > 1)::int from th), (select count(*) from f where id % 17 = 0)]) as n) select \"check\", n = 0 as passed, n::varchar as detail from k"
)
def analysis_gate_counts(spark, sf):
    """All gates of an analysis over tables with faults put in: ratings of 6, unmarked small weeks, no regions, priorities of
    another version and of one rank, negative shares, quotes without ids."""
    f = P.view(spark, sf, _FAULTS)
    t = themed(spark, sf)
    themes = metrics.themes(t).withColumn("share", F.when(F.col("theme").startswith("S"), -1.0).otherwise(F.col("share")))
    priorities = themes.select("theme", F.lit(1).alias("rank"), F.lit("priority_v0").alias("rule_version"))
    tables = {
        "rating_distribution": themes.select(F.col("theme").alias("rating"), "share"), "weekly": metrics.weekly(f).withColumn("small_sample", F.lit(False)),
        "before_after": metrics.around_releases(reviews_of(spark, sf), P.view(spark, sf, P.RELEASES), 28), "themes": themes, "devices": metrics.by_key(f, "platform"), "regions": metrics.regions(f).limit(0),
        "personas": metrics.personas(f.select(F.col("region").alias("segment"), "id", "rating", F.lit("t").alias("text"))), "priorities": priorities,
    }
    quotes = f.select(F.when(F.col("id") % 17 != 0, F.col("id")).alias("id"))
    return issues.quality_checks(spark, issues.analysis_gates(tables, f, quotes))


_TAGGED = f"with r as ({_TAG}), n as (select *, row_number() over (partition by channel, province, rating, text order by row_idx) as nth, first_value(row_idx) over (partition by channel, province, rating, text order by row_idx) as first_idx from r)"


@query(
    _TAGGED
    + ", g as (select row_idx, row_idx % 5 = 0 as a, row_idx % 7 = 0 as b, row_idx % 11 = 0 as c, row_idx % 19 = 0 as e, row_idx % 23 = 0 as h, row_idx % 29 = 0 as i, row_idx // 2 as record, case when row_idx % 3 = 0 then row_idx // 2 when row_idx % 3 = 1 then -1 end as dup from n), s as (select record, count(*) filter (dup is null) as firsts, count(*) filter (dup is not null and dup <> record) as astray from g group by 1) "
    "select \"check\", n = 0 as passed, n::varchar as detail from (select unnest(['tag_valid_is_told', 'tag_invalid_has_reason', 'tag_valid_has_no_reason', 'tag_rating_1_to_5', 'tag_date', 'tag_device_series', 'tag_modules', 'tag_record_id', 'tag_taxonomy', 'tag_issue_type', 'tag_scales', 'tag_one_first', 'tag_duplicate_known']) as \"check\", "
    "unnest([(select count(*) from g where e), (select count(*) from g where not e and a and not b), (select count(*) from g where not e and not a and b), (select count(*) from g where not e and not a and c), (select count(*) from g where not e and not a and h), (select count(*) from g where i), (select count(*) from g where not e and not a and i), 0, (select count(*) from g where c), (select count(*) from g where h), (select count(*) from g where b), (select count(*) from s where firsts <> 1), (select count(*) from s where astray > 0 or firsts < 1)]) as n)"
)
def tagging_gate_counts(spark, sf):
    """All gates of a tagged table with faults put in by row number."""
    r = P.view(spark, sf, _TAG, spread=("documents",)).withColumns({"date": F.lit(""), "device": F.lit(""), "rating_text": F.lit(""), "source_record_id": F.lit("")})
    n = F.col("row_idx")
    t = tagging.tag(r)
    valid = F.when(n % 19 == 0, None).otherwise(n % 5 != 0)
    record = F.floor(n / 2)
    broken = {
        "is_valid": valid, "invalid_reason": F.when(n % 7 == 0, "why").otherwise(""), "rating": F.when(n % 11 == 0, 6).otherwise(3), "date": F.when(n % 23 == 0, "2001-02-30").otherwise("2001-02-28"),
        "device_series": F.when(n % 29 == 0, "").otherwise("s"), "modules": F.when(n % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m"))), "source_record_id": record.cast("string"),
        "taxonomy_version": F.when(n % 11 == 0, "old").otherwise(f"{R.DEFAULT.name}-{R.DEFAULT.version}"), "issue_type": F.when(n % 23 == 0, "?").otherwise("吐槽抱怨"), "emotion": F.when(n % 7 == 0, 3).otherwise(0), "urgency": F.lit("中"),
        "duplicate_of": F.when(n % 3 == 0, record.cast("string")).when(n % 3 == 1, "-1"),
    }
    return issues.tagging_gates(t.withColumns(broken), R.DEFAULT)


# Texts ------------------------------------------------------------------------------------------------------------------------


@query(
    WITH_P
    + ", l as (select *, case when final_sentiment <> '' then final_sentiment when context_sentiment in ('', '待语境') then '未判定' else context_sentiment end as label from o), cc as (select count(*) as n, count(distinct post_id) as posts, count(distinct (post_id, thread_id)) as threads, count(*) filter (needs_review = 'yes') as review, count(*) filter (label = '未判定') as undecided, count(*) filter (label = '正向') as a, count(*) filter (label = '负向') as b, count(*) filter (label = '混合') as m, count(*) filter (label = '中性') as z from l), "
    "xx as (select topic, count(*) as n from (select unnest(string_split(topics, '；')) as topic from l) group by 1 order by 2 desc, 1 limit 15), "
    "ss as (select '- posts: ' || posts || '; threads: ' || threads || '; comments: ' || n as line from cc union all select '- to be reviewed: ' || review || '; undecided: ' || undecided from cc union all select '- positive: ' || a || '; negative: ' || b || '; mixed: ' || m || '; neutral: ' || z || '; undecided: ' || undecided from cc union all select printf('- of comments with a direction: positive %.1f%%, negative %.1f%%, mixed %.1f%%', 100 * round(a / (a + b + m), 4), 100 * round(b / (a + b + m), 4), 100 * round(m / (a + b + m), 4)) from cc) select line from ss union all select '| ' || topic || ' | ' || n from xx"
)
def sentiment_text(spark, sf):
    """The sentiment report: its figures, and the topics with their comments, as printed."""
    rows = _prepared(spark, sf).withColumn("row_idx", F.col("row_idx") * 100 + F.col("ord"))
    text = sinks.sentiment_report(threads.summarize(rows))
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "line string")  # a report's few lines
    wanted = F.col("line").rlike(r"^- (posts|to be reviewed|positive: |of comments)")
    topic = F.col("line").rlike(r"^\| .* \| \d")
    return lines.where(wanted | topic).select(F.when(topic, F.concat_ws(" | ", F.concat(F.lit("| "), F.trim(F.split("line", r"\|")[1])), F.trim(F.split("line", r"\|")[2]))).otherwise(F.col("line")).alias("line"))


@query(
    WITH_T
    + f", a as ({_THEME}), k as (select theme, mentions, row_number() over (order by mentions desc, mean, theme) as rank from a) select rank::varchar as rank, theme, mentions::varchar as mentions, (select count(*) from k)::bigint as rows from k"
)
def analysis_files(spark, sf):
    """An analysis' folder, written whole; the theme table read back from its CSV."""
    r, t = reviews_of(spark, sf).withColumn("is_valid", F.lit(True)), themed(spark, sf)
    themes = once(metrics.themes(t))  # each table is a few rows of a pass over all reviews, read by gates and files
    tables = {"rating_distribution": metrics.distribution(r), "weekly": metrics.weekly(r), "before_after": metrics.around_releases(r, P.view(spark, sf, P.RELEASES), 28), "devices": metrics.by_key(r, "platform"), "regions": metrics.regions(r), "priorities": priorities_of(spark, sf, themes)}
    d = with_device(spark, sf).select("id", F.col("series").alias("device"), "rating")
    tables["device_themes"] = metrics.device_themes(d.join(themes_by_id(spark, sf), "id", "left"))
    tables["personas"] = metrics.personas(r.select(F.col("region").alias("segment"), "id", "rating", F.lit("t").alias("text")))
    tables = {name: once(table) for name, table in tables.items()} | {"themes": themes}
    checks = once(issues.quality_checks(spark, issues.analysis_gates(tables, r, metrics.quotes(t.withColumn("text", F.lit("q")), "theme"))))
    folder = _folder(spark)
    sinks.analysis_folder(spark, folder, tables, tables["rating_distribution"], ["a finding"], checks)
    back = readers.csv_table(spark, f"{folder}/aggregation_tables/themes.csv")
    n = readers.csv_table(spark, f"{folder}/aggregation_tables/themes.csv").agg(F.count("*").alias("rows"))
    return back.select("rank", "theme", "mentions").crossJoin(F.broadcast(n))  # one row


@query(
    WITH_T
    + f", a as ({_THEME}), f as ({_FACTS}), c as (select n_name as metric, count(*) as value from customer join nation on c_nationkey = n_nationkey where n_regionkey < 2 group by 1), s as (select unnest(['Overview', 'Trend', 'Releases', 'Themes', 'Devices and regions', 'Priorities', 'Roadmap']) as name, unnest(range(1, 8)) as i) select '## ' || i || ' ' || name as line from s union all select '## Appendix: data and method' union all select '- ' || metric || ': ' || value || ' (customers)' from c union all select 'Figure ' || unnest(range(1, 7)) union all select 'Table ' || unnest([1, 3, 4, 5])"
)
def satisfaction_text(spark, sf):
    """The satisfaction report: its sections, claims, figures and tables, as printed."""
    claims = P.view(spark, sf, "select n_name as claim, case n_regionkey when 0 then 'Overview' else 'Trend' end as section, n_name as metric from nation where n_regionkey < 2")
    aggregates = P.view(spark, sf, "select n_name as metric, count(*) as value, 'customers' as source from customer join nation on c_nationkey = n_nationkey group by 1")
    roadmap = P.view(spark, sf, "select case r_regionkey when 0 then 'immediate' when 1 then 'this quarter' when 2 then 'next quarter' else 'long term' end as stage, r_name as goal, 'do' as action, 'better' as expected from region")
    roadmap = roadmap.select(*(F.col(c).cast("string").alias(c) for c in roadmap.columns))
    text = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    themes = once(metrics.themes(themed(spark, sf)))  # a few rows of a pass over all lines, read by two tables and a check
    tables = {1: text(metrics.weekly(reviews_of(spark, sf))), 3: text(themes.orderBy("rank"))}
    report = sinks.satisfaction_report(sinks.evidence_matrix(claims, aggregates), priorities_of(spark, sf, themes), roadmap, tables=tables)
    lines = spark.createDataFrame([(x,) for x in report.split("\n")], "line string")  # a report's few lines
    numbered = F.regexp_extract("line", r"^((?:Figure|Table) \d+):", 1)
    kept = lines.where((numbered != "") | F.col("line").startswith("## ") | F.col("line").endswith("(customers)"))
    return kept.select(F.when(numbered != "", numbered).otherwise(F.col("line")).alias("line"))
