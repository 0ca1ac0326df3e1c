"""Validation as data: one row (row_no, severity, code, field) for each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue(condition: Column, severity: str, code: str, field: str | Column = "") -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field")))


def report(df: DataFrame, row_no: Column, checks: list[Column]) -> DataFrame:
    """The findings of all checks; every row is looked at once. A null condition is no finding."""
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select(row_no.cast("long").alias("row_no"), F.explode(found).alias("i")).select("row_no", "i.severity", "i.code", "i.field")


def passed(issues: DataFrame) -> bool:
    """Whether no finding is an error."""
    return issues.where("severity = 'error'").isEmpty()


def quality_checks(spark, checks: dict[str, DataFrame]) -> DataFrame:
    """(check, passed, detail) from frames of offending rows: a check passes where its frame is empty; detail counts them."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "check string, passed boolean, detail string")


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """As quality_checks, for conditions that offending rows of one frame meet: one pass over it counts them all."""
    counts = df.agg(*(F.count_if(c).alias(name) for name, c in checks.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks)))
    return counts.select(each.alias("x")).select("x.check", (F.col("x.n") == 0).alias("passed"), F.col("x.n").cast("string").alias("detail"))


def tagging_gates(df: DataFrame, rules) -> DataFrame:
    """(check, passed, detail) for each gate of a tagged table that data can decide: one pass for rows, one for ids."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    valid = F.col("is_valid")
    rows = {
        "tag_valid_is_told": valid.isNull(),
        "tag_invalid_has_reason": ~valid & blank("invalid_reason"),
        "tag_valid_has_no_reason": valid & ~blank("invalid_reason"),
        "tag_rating_1_to_5": valid & ~F.col("rating").between(1, 5),
        "tag_date": valid & ~blank("date") & F.col("date").cast("string").try_cast("date").isNull(),
        "tag_device_series": blank("device_series"),
        "tag_modules": valid & (F.coalesce(F.size("modules"), F.lit(0)) < 1),
        "tag_record_id": blank("source_record_id"),
        "tag_taxonomy": F.col("taxonomy_version").isNull() | (F.col("taxonomy_version") != f"{rules.name}-{rules.version}"),
        "tag_issue_type": ~F.col("issue_type").isin(*(n for n, _ in rules.issue_types), "吐槽抱怨"),
        "tag_scales": ~F.col("emotion").between(-2, 2) | ~F.col("urgency").isin("高", "中", "低"),
    }
    repeat = F.col("duplicate_of").isNotNull()
    ids = df.groupBy("source_record_id").agg(F.count_if(~repeat).alias("firsts"), F.count_if(repeat & ~F.col("duplicate_of").eqNullSafe(F.col("source_record_id"))).alias("astray"))
    groups = {"tag_one_first": F.col("firsts") != 1, "tag_duplicate_known": (F.col("astray") > 0) | (F.col("firsts") < 1)}
    return row_checks(df, rows).unionByName(row_checks(ids, groups))


def analysis_gates(tables: dict[str, DataFrame], valid: DataFrame, quotes: DataFrame) -> dict[str, DataFrame]:
    """The offending rows of each gate of an analysis: its tables, by the names that sinks.TABLES has, and the rows that the
    metrics count."""
    empty = lambda name: valid.sparkSession.range(1).join(tables[name].limit(1), F.lit(True), "left_anti")  # noqa: E731  one row where the table has none
    return {
        "an_only_valid": valid.where("not is_valid or rating not between 1 and 5"),
        **{f"an_has_{name}": empty(name) for name in ("rating_distribution", "weekly", "before_after", "themes", "devices", "regions", "personas")},
        "an_small_samples_marked": tables["weekly"].where("n < 20 and not small_sample"),
        "an_priority_version": tables["priorities"].where("rule_version is null or rule_version <> 'priority_v1'"),
        "an_shares": tables["rating_distribution"].where("share < 0 or share > 1"),
        "an_ranks_differ": tables["priorities"].groupBy("rank").count().where("count > 1"),
        "an_quotes_traceable": quotes.where("id is null"),
    }


def report_gates(matrix: DataFrame, priorities: DataFrame, quotes: DataFrame, records: DataFrame, releases: DataFrame, effects: DataFrame, themes: DataFrame, figures: dict[int, DataFrame], roadmap: DataFrame, targets: DataFrame, method: DataFrame, sections: tuple[str, ...], stages: tuple[str, ...]) -> dict[str, DataFrame]:
    """The offending rows of the thirteen gates of a report, each decided by the tables that the report is made from.

    matrix(claim, section, metric, value, resolved), priorities (of metrics.priority), quotes(source_record_id),
    records(source_record_id), releases(version), effects(version), themes(mean), figures by number, roadmap(stage),
    targets(metric, now, target), method(note).
    """
    spark = matrix.sparkSession
    one = lambda df: spark.range(1).join(df.limit(1), F.lit(True), "left_anti")  # noqa: E731  one row where df has none
    names = lambda c, values: spark.createDataFrame([(v,) for v in values], f"{c} string")  # noqa: E731  a report's fixed lists
    lead = matrix.where(F.col("section") == sections[0])
    absent = None
    for k in (1, 2, 4, 5):
        gone = one(figures[k]) if k in figures else spark.range(1)
        absent = gone if absent is None else absent.unionByName(gone)
    number = lambda c: F.col(c).cast("string").try_cast("double")
    return {
        "rp_proposition": one(lead.where("resolved")),
        "rp_summary": lead.where("not resolved"),
        "rp_sections": names("section", sections).join(matrix.select("section").distinct(), "section", "left_anti"),
        "rp_figures": absent,
        "rp_releases_attributed": releases.join(effects.select("version").distinct(), "version", "left_anti"),
        "rp_levels": priorities.where("grade is null or grade not in ('P0', 'P1', 'P2')").select("theme").unionByName(one(priorities).select(F.lit("").alias("theme"))),
        "rp_priority_parts": priorities.where("rule_version is null or rule_version <> 'priority_v1' or V is null or D is null or G is null or U is null or F is null or missing_components is null"),
        "rp_satisfied": one(themes.where("mean >= 3")),
        "rp_roadmap": names("stage", stages).join(roadmap.select("stage").distinct(), "stage", "left_anti").unionByName(roadmap.where(~F.col("stage").isin(*stages)).select("stage")),
        "rp_targets": targets.where(number("now").isNull() | number("target").isNull()).select("metric").unionByName(one(targets).select(F.lit("").alias("metric"))),
        "rp_appendix": one(method.where("trim(note) <> ''")),
        "rp_claims_resolved": matrix.where("not resolved"),
        "rp_quotes_traceable": quotes.join(records.select("source_record_id").distinct(), "source_record_id", "left_anti"),
    }


def judged(checks: DataFrame, notes: dict[str, bool]) -> DataFrame:
    """checks with the gates that only people can decide (name: passed), marked as such; one that nobody judged is not in
    notes and so is missing, not passed."""
    spark = checks.sparkSession
    return checks.unionByName(spark.createDataFrame([(k, v, "judged by a person") for k, v in notes.items()], "check string, passed boolean, detail string"))

