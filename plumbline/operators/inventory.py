"""Feature inventories: keys, validation, merging, full-outer comparison, retests, coverage, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import ALLOWED_STATUSES, PARTIAL, PRESENT, STATUS_ALIASES, STATUS_RANK, diff_type, lookup
from plumbline.functions.text import blank, casefold, nfkc
from plumbline.operators.issues import issue, passed, report
from plumbline.sources.steps import once

LEVELS = [f"{n}级功能" for n in "一二三四五六"]


#: The columns that keys, paths and statuses are made of.
_READ = ("验证状态", "状态", *LEVELS, "功能路径", "标准功能ID", "模块", "证据文件", "证据ID", "备注")


def normalized(df: DataFrame) -> DataFrame:
    """df with all columns that are read here in NFKC and trimmed, null as empty: one call for the whole row."""
    names = [c for c in _READ if c in df.columns]
    if not names:
        return df
    row = df.withColumn("_row", F.array_join(F.array(*(blank(F.col(f"`{c}`")) for c in names)), "\x1f"))  # steps of their own: each is used often
    row = row.withColumn("_cells", F.split(nfkc(F.col("_row")), "\x1f", -1))
    return row.withColumns({c: F.trim(F.get("_cells", F.lit(i))) for i, c in enumerate(names)}).drop("_row", "_cells")


def _column(df: DataFrame, name: str) -> Column:
    return blank(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def status_of(df: DataFrame) -> Column:
    """The status of a row of normalized(): its alias' meaning, from the first of two columns that is filled."""
    raw = _column(df, "验证状态")
    return lookup(F.when(raw == "", _column(df, "状态")).otherwise(raw), STATUS_ALIASES)


def hierarchy(df: DataFrame) -> Column:
    """Of normalized() rows the filled level columns, or the parts of 功能路径 between >, / and →."""
    path = F.filter(F.transform(F.split(_column(df, "功能路径"), r"\s*(?:>|/|→)\s*"), lambda x: F.trim(x)), lambda x: x != "")
    held = [_column(df, c) for c in LEVELS if c in df.columns]
    if not held:
        return path
    filled = F.concat(*held) != ""
    return F.when(filled, F.filter(F.array(*held), lambda x: x != "")).otherwise(path)


def keyed(df: DataFrame) -> DataFrame:
    """(row_idx, key, feature_id, module, path, status, evidence, notes) of inventory rows. The key is the feature id in
    lower case, else the hierarchy (the module where there is none) without anything but letters and digits."""
    df = normalized(df)
    df = df.withColumn("_levels", hierarchy(df))  # a step of its own: it is used four times
    levels = F.col("_levels")
    explicit = _column(df, "标准功能ID")
    parts = F.when(F.size(levels) > 0, levels).otherwise(F.array(_column(df, "模块")))
    fallback = F.regexp_replace(casefold(F.array_join(parts, "|")), r"(?U)[\s\W_]+", "")
    evidence = F.when(_column(df, "证据文件") != "", _column(df, "证据文件")).otherwise(_column(df, "证据ID"))
    key = F.when(explicit != "", casefold(explicit)).otherwise(fallback)
    return df.select("row_idx", key.alias("key"), explicit.alias("feature_id"), _column(df, "模块").alias("module"), F.array_join(levels, " > ").alias("path"), status_of(df).alias("status"), evidence.alias("evidence"), _column(df, "备注").alias("notes"))


def keyed_once(df: DataFrame) -> DataFrame:
    """keyed(df) as a stored table: findings, merges and comparisons all read it more than once."""
    return once(keyed(df), "inventory")


def header_issues(columns: list[str]) -> list[str]:
    """What a header lacks."""
    out = [] if "模块" in columns else ["模块"]
    out += [] if {"验证状态", "状态"} & set(columns) else ["验证状态"]
    return out + ([] if {*LEVELS, "功能路径"} & set(columns) else ["功能路径"])


def validate(rows: DataFrame) -> DataFrame:
    """Findings of keyed rows: rows without a key give that alone; then path, status and evidence; then keys that occur more
    than once (equal statuses: duplicate, else conflict) at their first row, and different paths under one fallback key."""
    keyless = F.col("key") == ""
    one = report(
        rows,
        F.col("row_idx") + 2,
        [
            issue(keyless, "error", "missing_key"),
            issue(~keyless & (F.col("path") == "") & (F.col("feature_id") == ""), "error", "missing_path"),
            issue(~keyless & ~F.col("status").isin(*ALLOWED_STATUSES), "error", "status"),
            issue(~keyless & F.col("status").isin(*PRESENT, *PARTIAL) & (F.col("evidence") == ""), "warning", "no_evidence"),
        ],
    )
    path = F.when(F.col("feature_id") == "", F.col("path"))
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))  # noqa: E731  more than one value, without a distinct count
    groups = rows.where(~keyless).groupBy("key").agg(F.count("*").alias("n"), differ(F.col("status")).alias("k"), F.min("row_idx").alias("first"), differ(path).alias("p")).where("n > 1")
    many = report(groups, F.col("first") + 2, [issue(F.col("k"), "warning", "conflict"), issue(~F.col("k"), "warning", "duplicate"), issue(F.col("p"), "warning", "key_collision")])
    return one.unionByName(many)


def rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv)), status), F.lit(-1))


def first_seen(rows: DataFrame, key: str, columns: list[str], order: str = "row_idx") -> DataFrame:
    """For each key and column its different non-empty values in order of first sight, as an array. Repeats are settled before
    anything is gathered: a value is one row by then, whatever its key's number of rows."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns)))
    seen = rows.select(key, order, cells.alias("c")).where("c.value <> ''").groupBy(key, "c.name", "c.value").agg(F.min(order).alias("first"))
    values = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == c, F.struct("first", "value")))), lambda x: x["value"])
    return seen.groupBy(key).agg(*(values(c).alias(c) for c in columns))


def merge(rows: DataFrame) -> DataFrame:
    """One row per key: id, module and path of the row with the highest status rank (the first of equals), the status or
    状态冲突 where statuses differ, evidence and notes without repeats in order of first sight."""
    keyed_rows = rows.where("key <> ''")
    best = F.max_by(F.struct("feature_id", "module", "path"), F.struct(rank(F.col("status")), -F.col("row_idx")))
    one = keyed_rows.groupBy("key").agg(best.alias("r"), F.when(F.min("status") != F.max("status"), "状态冲突").otherwise(F.min("status")).alias("status"))
    out = one.join(first_seen(keyed_rows, "key", ["evidence", "notes"]), "key", "left")
    told = (F.coalesce(F.array_join(c, "；"), F.lit("")).alias(c) for c in ("evidence", "notes"))
    return out.select("key", F.when(F.col("r.feature_id") != "", F.col("r.feature_id")).otherwise(F.col("key")).alias("feature_id"), "r.module", "r.path", "status", *told)


def status_histogram(rows: DataFrame) -> DataFrame:
    """Keyed rows per status, in no order; rows without a key count too."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def validate_table(df: DataFrame) -> DataFrame:
    """Findings of a whole inventory table: what its header lacks (row 1), then those of its rows."""
    spark = df.sparkSession
    header = [(1, "error", "header", name) for name in header_issues(df.columns)]
    found = spark.createDataFrame(header, "row_no long, severity string, code string, field string")
    return found.unionByName(validate(keyed_once(df)))


def compare_tables(left: DataFrame, right: DataFrame, left_label: str = "左", right_label: str = "右") -> DataFrame:
    """The parity matrix of two inventory tables. A side with findings that are errors is refused before anything is
    compared."""
    rows = []
    for label, side in ((left_label, left), (right_label, right)):
        rows.append(keyed_once(side))
        if header_issues(side.columns) or not passed(validate(rows[-1])):
            raise ValueError(f"the inventory {label} has errors")
    return compare(merge(rows[0]), merge(rows[1]), left_label, right_label)


def gap_status(matrix: DataFrame, own: str = "left") -> DataFrame:
    """(feature_id, gap_status) of a parity matrix for one side: absent where it lacks what the other has, partial or entry
    where it has less, ahead where the other lacks it; features on a par or not verified have no row."""
    other = "right" if own == "left" else "left"
    mine, theirs = F.col(f"{own}_status"), F.col(f"{other}_status")
    there = theirs.isin(*PRESENT, *PARTIAL)
    status = (
        F.when((mine == "明确缺失") & there, "absent")
        .when((mine == "仅入口存在") & theirs.isin(*PRESENT), "entry")
        .when((mine == "部分可用") & theirs.isin(*PRESENT), "partial")
        .when(mine.isin(*PRESENT, *PARTIAL) & (theirs == "明确缺失"), "ahead")
    )
    return matrix.select("feature_id", status.alias("gap_status")).where("gap_status is not null")


def themes_with_gaps(themes: DataFrame, matrix: DataFrame, own: str = "left") -> DataFrame:
    """themes(theme, feature_id and more) with the gap status of their feature, null where there is none: what the priority's
    gap component reads. Of several rows of one feature the worst gap counts."""
    worst = F.min_by("gap_status", F.array_position(F.array(*map(F.lit, ("absent", "partial", "entry", "ahead"))), F.col("gap_status")))
    gaps = gap_status(matrix, own).groupBy("feature_id").agg(worst.alias("gap_status"))
    return themes.drop("gap_status").join(gaps, "feature_id", "left")


def compare(left: DataFrame, right: DataFrame, left_label: str = "左", right_label: str = "右") -> DataFrame:
    """The parity matrix: a full outer join of two merged inventories on key; the side that lacks a key is 未收录."""
    pair = left.alias("l").join(right.alias("r"), "key", "full_outer")
    statuses = [F.coalesce(F.col(f"{s}.status"), F.lit("未收录")) for s in "lr"]
    first = lambda c: F.coalesce(F.nullif(F.col(f"l.{c}"), F.lit("")), F.col(f"r.{c}"), F.lit(""))
    cells = [F.coalesce(F.col(f"{s}.{c}"), F.lit("")).alias(f"{n}_{c}") for c in ("evidence", "notes") for s, n in (("l", "left"), ("r", "right"))]
    return pair.select("key", first("feature_id").alias("feature_id"), first("module").alias("module"), first("path").alias("path"), statuses[0].alias("left_status"), statuses[1].alias("right_status"), diff_type(*statuses, left_label, right_label).alias("diff"), *cells)


def diff_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("diff").agg(F.count("*").alias("n"))


def retest(merged: DataFrame, changed_modules: DataFrame) -> DataFrame:
    """What to test again for a new version: rows that were partial, absent or blocked, and all rows of changed modules."""
    open_ = F.col("status").isin(*PARTIAL, "明确缺失", "受阻")
    changed = changed_modules.select("module").distinct().withColumn("_changed", F.lit(True))
    return merged.join(changed, "module", "left").where(open_ | F.coalesce("_changed", F.lit(False))).select("key", "module", "status", F.coalesce("_changed", F.lit(False)).alias("module_changed"))


def coverage_note(rows: DataFrame) -> DataFrame:
    """Per module: rows unchecked, blocked and unlisted, apart from real gaps."""
    count = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    return rows.groupBy("module").agg(F.count("*").alias("rows"), count("未检查", "unchecked"), count("受阻", "blocked"), count("未收录", "unlisted"), count("明确缺失", "absent"))


def missing_evidence(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows present or partial whose evidence is not in the manifest."""
    need = rows.where(F.col("status").isin(*PRESENT, *PARTIAL))
    return need.join(manifest.select(blank(F.col("evidence")).alias("evidence")).distinct(), "evidence", "left_anti")
