"""Sinks: CSV with a byte order mark, JSON documents, Markdown reports. Reports are small by nature and may be made as text on
the driver, bounded by `most` rows (more is an error); tables of any size are written by the executors, as one file in order
(csv_file, json_file, timeline_file) or as Parquet and JSON lines."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import colour
from plumbline.functions.text import markdown_cell
from plumbline.operators.issues import passed, quality_checks
from plumbline.operators.releases import CHANNELS, FIELDS
from plumbline.sources.steps import once


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return rows


def csv_text(df: DataFrame, columns: list[str] | None = None, most: int = 100_000) -> str:
    """CSV with a byte order mark and a fixed order of columns; arrays comma-joined, nulls empty."""
    columns = columns or df.columns
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(columns)
    for r in _bounded(df.select(*columns), most):
        writer.writerow(["" if v is None else ",".join(map(str, v)) if isinstance(v, list) else v for v in r])
    return "﻿" + out.getvalue()


def json_text(df: DataFrame, key: str | None = None, most: int = 100_000) -> str:
    """{key: [rows]}, or the single row of df; text as it is."""
    rows = [r.asDict(recursive=True) for r in _bounded(df, most)]
    return json.dumps({key: rows} if key else rows[0] if rows else {}, ensure_ascii=False, default=str, indent=2)


def lines_file(df: DataFrame, path: str, order: list[str], head: str = "", tail: str = "", separator: str = "\n", skip: int = 0) -> None:
    """One text file of any size: head, the column `line` of df in the given order, tail. Executors sort and write the lines;
    their parts are then put behind each other in a stream of small buffers, as one file has one writer. skip: so many bytes
    at the start of the first line are left out."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path
    beside = f"{path}.parts"
    df.orderBy(*order).select("line").write.mode("overwrite").option("lineSep", separator).text(beside)
    fs = to(path).getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.listStatus(to(beside)) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda p: p.getName())
    out = fs.create(to(path), True)
    try:
        out.write(bytearray(head.encode()))
        for i, part in enumerate(parts):
            source = fs.open(part)
            try:
                if i == 0:
                    source.seek(skip)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(to(beside), True)


def csv_file(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> None:
    """As csv_text(), of any size: one file, its rows in the given order."""
    columns = columns or [c for c in df.columns]

    def cell(c: str):
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "") if df.schema[c].dataType.typeName() == "array" else F.col(f"`{c}`").cast("string")
        text = F.coalesce(text, F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    def name(c: str) -> str:
        return '"' + c.replace('"', '""') + '"' if set(c) & set('",\r\n') else c

    lines = df.select(*order, F.concat_ws(",", *(cell(c) for c in columns)).alias("line"))
    lines_file(lines, path, order, head="\ufeff" + ",".join(map(name, columns)) + "\r\n", separator="\r\n")


def json_file(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """As json_text(), of any size: {key: [rows in the given order]}, a row a line."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    lines_file(df.select(*order, F.concat(F.lit(","), row).alias("line")), path, order, head="{" + json.dumps(key, ensure_ascii=False) + ": [\n", tail="]}\n", skip=1)


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    cells = df.select(*(markdown_cell(F.col(f"`{c}`")).alias(c) for c in df.columns))
    return head + "".join(f"| {' | '.join(r)} |\n" for r in _bounded(cells, most))


def release_timeline(df: DataFrame, most: int = 10_000) -> str:
    """Releases of timeline() by channel in fixed order, with date, test window and evidence; channels that are not in the
    vocabulary come last, so no row is lost."""
    rows = _bounded(df.orderBy("nth"), most)
    out = ["# Release timeline"]
    for channel in (*CHANNELS, None):
        mine = [r for r in rows if (r["release_channel"] == channel if channel else r["release_channel"] not in CHANNELS)]
        if mine:
            out.append(f"\n## {channel or 'Unsupported channel'}\n")
        for r in mine:
            out.append(f"- {r['sort_date'] or '?'} {r['version']}: {r['update_text']}")
            if r["test_start"] or r["test_end"]:
                out.append(f"  - window {r['test_start']} to {r['test_end']}")
            if r["source"] or r["evidence_file"]:
                out.append(f"  - evidence {r['source']} {r['evidence_file']}".rstrip())
    return "\n".join(out) + "\n"


def timeline_file(df: DataFrame, path: str) -> None:
    """As release_timeline(), of any size and of several apps: within a channel by app, then as timeline() numbers them."""
    nth = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("release_channel")).cast("int")
    k = F.when(nth > 0, nth).otherwise(len(CHANNELS) + 1).alias("k")
    main = F.concat(F.lit("- "), F.when(F.col("sort_date") != "", F.col("sort_date")).otherwise("?"), F.lit(" "), F.col("version"), F.lit(": "), F.col("update_text"))
    window = F.when((F.col("test_start") != "") | (F.col("test_end") != ""), F.concat(F.lit("  - window "), F.col("test_start"), F.lit(" to "), F.col("test_end")))
    evidence = F.when((F.col("source") != "") | (F.col("evidence_file") != ""), F.rtrim(F.concat(F.lit("  - evidence "), F.col("source"), F.lit(" "), F.col("evidence_file"))))
    rows = df.select(k, F.lit(1).alias("part"), "app_name", "package_name", "nth", F.concat_ws("\n", main, window, evidence).alias("line"))
    title = F.when(F.col("k") > len(CHANNELS), "Unsupported channel").otherwise(F.element_at(F.array(*map(F.lit, (*CHANNELS, ""))), F.col("k")))
    heads = rows.select("k").distinct().select("k", F.lit(0).alias("part"), F.lit("").alias("app_name"), F.lit("").alias("package_name"), F.lit(0).alias("nth"), F.concat(F.lit("\n## "), title, F.lit("\n")).alias("line"))
    lines_file(rows.unionByName(heads), path, ["k", "part", "app_name", "package_name", "nth"], head="# Release timeline\n")


def release_files(df: DataFrame, findings: DataFrame, prefix: str) -> int:
    """Writes normalize()'s releases as prefix.csv, .json and .md, and its findings as prefix-findings.csv, whatever they are;
    returns 1 if one is an error, else 0."""
    fields = [*FIELDS]
    findings = once(findings, "findings")  # sorting looks at them twice, the exit code once more
    shown = df.select("row_no", *fields)
    csv_file(shown, f"{prefix}.csv", ["row_no"], fields)
    json_file(shown, f"{prefix}.json", "updates", ["row_no"])
    timeline_file(df, f"{prefix}.md")
    csv_file(findings, f"{prefix}-findings.csv", ["row_no", "code", "field"])
    return 0 if passed(findings) else 1


def month_report(rows: DataFrame, histogram: DataFrame) -> dict[str, str]:
    """Markdown, JSON and CSV of one month's reviews; the histogram lists 1 to 5 whether they occur or not."""
    counts = {r["stars"]: r["n"] for r in histogram.collect()}
    stars = "".join(f"- {k}: {counts.get(str(k), 0)}\n" for k in range(1, 6))
    return {"md": f"# Reviews\n\n{stars}\n{markdown_table(rows)}", "json": json_text(rows, "reviews"), "csv": csv_text(rows)}


def sentiment_report(parts: dict[str, DataFrame]) -> str:
    """The report of threads.summarize(): coverage, all five labels, shares in percent, ratio, the 15 topics with most
    comments, and what the figures do not say."""
    t = parts["totals"].first()
    shares = ", ".join(f"{k} {t[f'share_{k}']:.1%}" for k in ("positive", "negative", "mixed"))
    counts = "; ".join(f"{k}: {t[k]}" for k in ("positive", "negative", "mixed", "neutral", "undecided"))
    likes = "; ".join(f"{k}: {t[f'likes_{k}']}" for k in ("positive", "negative", "mixed", "neutral", "undecided"))
    threads = "; ".join(f"{r['thread_label']}: {r['n']}" for r in _bounded(parts["threads"].orderBy("thread_label"), 100))
    lines = [
        "# Sentiment",
        "\n## Sample and coverage\n",
        f"- posts: {t['posts']}; threads: {t['threads']}; comments: {t['comments']}",
        f"- reported as collected: {t['collected_comments']}; expected: {t['expected_comments']}",
        f"- to be reviewed: {t['needs_review']}; undecided: {t['unresolved']}",
        "\n## Labels\n",
        f"- {counts}",
        f"- of comments with a direction: {shares}",
        f"- positive to negative: {'none is negative' if t['ratio'] is None else t['ratio']}",
        f"- likes ({likes}) are interaction, not weight of people",
        f"- threads ({threads})",
        "\n## Topics\n",
        markdown_table(parts["topics"].orderBy(F.desc("comments"), "topic").limit(15)),
        "## Limits\n",
        "- The sample depends on search words, time, ranking and login; it does not stand for all users.",
        "- Hot posts, deleted comments and replies that could not be opened shift it.",
        "- Rule labels only sort; the fields reviewed in context count.",
    ]
    return "\n".join(lines) + "\n"


def parity_report(matrix: DataFrame, counts: DataFrame) -> dict[str, str]:
    """The matrix as CSV in key order, and counts by difference as Markdown."""
    return {"csv": csv_text(matrix.orderBy("key")), "md": "# Parity\n\n" + markdown_table(counts.orderBy("diff"))}


def tagged(df: DataFrame, folder: str) -> None:
    """Tagged reviews as JSON lines and as CSV with a byte order mark in front of each file's header, arrays comma-joined; of
    any size, written by the executors."""
    df.write.mode("overwrite").json(f"{folder}/jsonl")
    flat = [F.array_join(c, ",").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string").alias(c) for c in df.columns]
    text = df.select(*flat)
    marked = text.select(*(F.col(c).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(text.columns)))
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/csv")


def tagging_summary(df: DataFrame, rules, identity: list[str] | tuple[str, ...], evidence: list[str]) -> str:
    """What a tagging run did: valid, repeated and other invalid rows by reason, period, mean rating, key of repeats, evidence
    columns, names, versions and digest of the rules."""
    n = df.agg(F.count("*").alias("rows"), F.count_if("is_valid").alias("valid"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg(F.when(F.col("is_valid"), F.col("rating"))).alias("mean")).first()
    reasons = _bounded(df.where("not is_valid").groupBy("invalid_reason").agg(F.count("*").alias("n")).orderBy("invalid_reason"), 100)
    lines = ["# Tagging", "", f"- rows: {n['rows']}; valid: {n['valid']}; invalid: {n['rows'] - n['valid']}", *(f"  - {r['invalid_reason']}: {r['n']}" for r in reasons)]
    lines += [f"- period: {n['first']} to {n['last']}", f"- mean rating of valid rows: {'-' if n['mean'] is None else round(n['mean'], 4)}", f"- repeats are equal in {', '.join(identity)}"]
    lines += [f"- evidence columns: {', '.join(c for c in evidence if c in df.columns) or 'none'}", f"- rules: {rules.name} {rules.version}, sha256 {rules.sha256}"]
    return "\n".join(lines) + "\n"


def write_files(spark, folder: str, files: dict[str, str]) -> None:
    """Report files (name: text, names may hold folders) through the file system of the folder, so that it may be any that
    Spark reaches."""
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name, text in files.items():
        at = path(f"{folder}/{name}")
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


#: The tables that an analysis delivers.
TABLES = ("rating_distribution", "weekly", "before_after", "themes", "devices", "device_themes", "regions", "personas", "priorities")


def analysis_folder(spark, folder: str, tables: dict[str, DataFrame], summary: DataFrame, findings: list[str], checks: DataFrame) -> list[str]:
    """Writes an analysis: findings, metrics_summary.csv, a CSV for each table, and the quality check; returns the names. A
    missing table of TABLES is an error; the check names failed gates and stops nothing."""
    if lacking := [t for t in TABLES if t not in tables]:
        raise ValueError(f"missing tables: {', '.join(lacking)}")
    files = {"analysis_findings.md": "# Findings\n\n" + "".join(f"- {x}\n" for x in findings), "metrics_summary.csv": csv_text(summary)}
    files |= {f"aggregation_tables/{name}.csv": csv_text(df) for name, df in sorted(tables.items())}
    files["analysis_quality_check.md"] = "# Quality check\n\n" + markdown_table(checks.orderBy("check").select("check", F.col("passed").cast("string").alias("passed"), "detail"))
    write_files(spark, folder, files)
    return list(files)


def chart_frames(weekly: DataFrame, releases: DataFrame, themes: DataFrame, reversal: DataFrame, devices: DataFrame, distribution: DataFrame, heat: DataFrame) -> dict[str, DataFrame]:
    """What the six charts draw, a frame each, with the colour band of each mean and the printed label: 1 weeks with the
    releases in them, 2 themes, 3 before and after a launch with the mean of all, 4 devices, 5 ratings, 6 the heat map in
    long form."""
    pct = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    num = lambda c: F.format_string("%.2f", F.col(c))
    marks = releases.groupBy(F.date_trunc("week", F.col("release_date")).cast("date").alias("week")).agg(F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("releases"))
    cells = [F.struct(F.lit(c).alias("device"), F.col(c).cast("double").alias("value")) for c in heat.columns if c != "theme"]
    return {
        "figure_1": weekly.select("week", "n", "mean", "bad", "small_sample").join(F.broadcast(marks), "week", "left"),
        "figure_2": themes.select("theme", "mentions", "mean", "bad", "rank", colour(F.col("mean")).alias("colour"), F.concat(F.col("mentions").cast("string"), F.lit(" · "), num("mean"), F.lit(" · "), pct("bad")).alias("label")),
        "figure_3": reversal.select("theme", "mean_before", "mean_after", "n_before", "n_after", "mean_all"),
        "figure_4": devices.select("device", "mean", "n", colour(F.col("mean")).alias("colour"), F.concat(num("mean"), F.lit(" (n="), F.col("n").cast("string"), F.lit(")")).alias("label")),
        "figure_5": distribution.select("rating", "n", "share", F.concat(F.col("n").cast("string"), F.lit(" / "), pct("share")).alias("label")),
        "figure_6": heat.select("theme", F.explode(F.array(*cells)).alias("c")).select("theme", "c.device", "c.value"),
    }


SECTIONS = ("Overview", "Trend", "Releases", "Themes", "Devices and regions", "Priorities", "Roadmap")
APPENDIX = "Appendix: data and method"
#: The numbers that figures and tables have in every report.
FIGURES = {1: "weekly trend with releases", 2: "themes by mentions and mean", 3: "call and launch", 4: "devices by mean", 5: "ratings", 6: "devices by theme"}
NUMBERED = {1: "weekly metrics", 2: "before and after releases", 3: "themes", 4: "priorities", 5: "roadmap"}
#: Where they stand.
PLACES = {"Overview": ([5], []), "Trend": ([1], [1]), "Releases": ([3], [2]), "Themes": ([2], [3]), "Devices and regions": ([4, 6], []), "Priorities": ([], [4]), "Roadmap": ([], [5])}
STAGES = ("immediate", "this quarter", "next quarter", "long term")


def evidence_matrix(claims: DataFrame, aggregates: DataFrame) -> DataFrame:
    """claims(claim, section, metric) with the value and source of aggregates(metric, value, source); resolved is false
    where there is none, which fails the report's gate."""
    return claims.join(aggregates, "metric", "left").withColumn("resolved", F.col("value").isNotNull())


def satisfaction_report(matrix: DataFrame, priorities: DataFrame, roadmap: DataFrame | None = None, *, tables: dict[int, DataFrame] | None = None, targets: DataFrame | None = None, method: list[str] | None = None) -> str:
    """The seven sections and the appendix in fixed order; figures and tables by their fixed numbers, tables that are not
    given left out. Priorities are copied, never computed anew; an unresolved claim, another rule version or a roadmap
    stage that is none of the four is an error. roadmap(stage, goal, action, expected) and targets(metric, now, target)
    come from people."""
    if not matrix.where("not resolved").isEmpty():
        raise ValueError("claims without evidence")
    if not priorities.where("rule_version <> 'priority_v1'").isEmpty():
        raise ValueError("priorities of another rule version")
    if roadmap is not None and "stage" in roadmap.columns and not roadmap.where(~F.col("stage").isin(*STAGES)).isEmpty():
        raise ValueError(f"stages are {', '.join(STAGES)}")
    claims = _bounded(matrix.orderBy("section", "claim"), 10_000)
    shown = dict(tables or {}) | {4: priorities.orderBy("rank").select("rank", "theme", "score", "grade", "missing_components")} | ({5: roadmap} if roadmap is not None else {})
    out = ["# Satisfaction report"]
    for i, name in enumerate(SECTIONS, 1):
        out.append(f"\n## {i} {name}\n")
        out += [f"- {r['claim']}: {r['value']} ({r['source']})" for r in claims if r["section"] == name]
        figures, numbers = PLACES[name]
        out += [f"\nFigure {k}: {FIGURES[k]}" for k in figures]
        for k in numbers:
            if k in shown:
                out.append(f"\nTable {k}: {NUMBERED[k]}\n\n" + markdown_table(shown[k]))
        if name == "Roadmap" and targets is not None:
            out += [f"- {r['metric']}: {r['now']} to {r['target']}" for r in _bounded(targets.orderBy("metric"), 1000)]
    out.append(f"\n## {APPENDIX}\n")
    out += [f"- {x}" for x in method or ["no note was given"]]
    return "\n".join(out) + "\n"


def report_checks(report: str, matrix: DataFrame, priorities: DataFrame, quotes: DataFrame) -> DataFrame:
    """(check, passed, detail) of a written report: all sections in order, the appendix, base figures 1, 2, 4 and 5, each
    numbered table once at most, claims with evidence, priorities with their rule version, quotes with record ids."""
    spark = matrix.sparkSession
    heads = [f"## {i} {name}" for i, name in enumerate(SECTIONS, 1)]
    at = [report.find(f"\n{h}\n") for h in heads]
    told = [
        ("sections", -1 not in at and at == sorted(at), f"{sum(x >= 0 for x in at)} of {len(heads)}"),
        ("appendix", f"## {APPENDIX}" in report, ""),
        ("base_figures", all(f"\nFigure {k}:" in report for k in (1, 2, 4, 5)), ""),
        ("tables_once", all(report.count(f"\nTable {k}:") <= 1 for k in NUMBERED), ""),
    ]
    rows = spark.createDataFrame(told, "check string, passed boolean, detail string")
    return rows.unionByName(quality_checks(spark, {"claims_resolved": matrix.where("not resolved"), "priority_version": priorities.where("rule_version is null or rule_version <> 'priority_v1'"), "quotes_traceable": quotes.where("source_record_id is null or source_record_id = ''")}))
