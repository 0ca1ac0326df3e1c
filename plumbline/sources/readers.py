"""Sources. Each numbers its rows (row_idx, from 0, in file order), as all first-wins rules depend on it.

Report-sized files of JSON (an export) are read as one record each and parsed in place, so the numbers follow the file; an
inventory by position is read line by line, in as many splits as it has; large inputs come as Parquet with a row_idx of
their own.
"""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.rules import ALLOWED_STATUSES, STATUS_ALIASES
from plumbline.functions.text import clean
from plumbline.operators.ordered import file_rows
from plumbline.sources.steps import small_batches

LEVELS = [f"{n}级功能" for n in "一二三四五六"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file, a byte order mark removed."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("content"))


#: A separator outside quotes: of cells, or (a carriage return alone) of rows.
_SEPARATOR = re.compile("[,\r]")


def _through(line: str, inside: bool) -> tuple[bool, int]:
    """Of a line, without its line feed, that starts inside a quoted cell or not: whether its end lies in one, and how many
    rows end in it. As Python's csv reader has it: only a quote at a cell's start opens, two in a quoted cell are one, and
    behind the closing quote a cell goes on to the next separator."""
    if '"' not in line and "\r" not in line[:-1]:
        return inside, 0 if inside else 1
    at = rows = 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        if inside:
            end = line.find('"', at)
            while end >= 0 and line.startswith('"', end + 1):
                end = line.find('"', end + 2)
            if end < 0:
                return True, rows
            inside, at = False, end + 1
        sep = _SEPARATOR.search(line, at)
        if sep is None or (sep.group() == "\r" and sep.end() == len(line)):
            return False, rows + 1
        rows += sep.group() == "\r"
        at = sep.end()


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, lines) of CSV files: blocks of lines that end outside quotes, most of them one line, numbered in
    the file's order, with the number of their first row.

    A file has any number of splits. A split's lines stand one after the other in one task, which notes the state and counts
    behind each for a start outside and inside quotes, as it does not know its own; a row for each split then tells which
    it is. So no task holds a file, and a line is the most that is held at once.
    """
    scan = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, told = None, 0, []
        for batch in batches:
            if split == [c[0].as_py() for c in batch.columns[1:]] and all(pc.count_distinct(c).as_py() == 1 for c in batch.columns[1:]) and not pc.any(pc.match_substring_regex(batch.column(0), '"|\r(?s:.)')).as_py():
                n = np.arange(len(batch))  # plain lines of one split, all at once
                numbers = [at + n]
                for k, (inside, blocks, rows) in enumerate(told):
                    more = n * 0 if inside else n
                    numbers += [blocks + more, rows + more, np.full(len(n), inside), blocks + more + (not inside), rows + more + (not inside)]
                    told[k] = (inside, int(numbers[-2][-1]), int(numbers[-1][-1]))
                at += len(n)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, numbers)], names=_NOTED)
                continue
            values, noted = [], []
            for line, *this in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != split:
                    split, at, told = this, 0, [(False, 0, 0), (True, 0, 0)]
                    line = line.removeprefix("\ufeff") if this[1] == 0 else line
                values.append(line)
                row = [at]
                for k, (inside, blocks, rows) in enumerate(told):
                    after, ended = _through(line, inside)
                    told[k] = (after, blocks + (not after), rows + ended)
                    row += [blocks, rows, *told[k]]
                noted.append(row)
                at += 1
            numbers = [pa.array(c) for c in zip(*noted, strict=True)] if noted else [pa.array([], t) for t in _KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), *batch.columns[1:], *numbers], names=_NOTED)

    side = lambda k: f"block{k} long, row{k} long, after{k} boolean, blocks{k} long, rows{k} long"
    lines = scan.mapInArrow(run, f"value string, file string, start long, at long, {side(0)}, {side(1)}")
    last = F.max_by(F.struct(*(F.struct(F.col(f"after{k}").alias("after"), F.col(f"blocks{k}").alias("blocks"), F.col(f"rows{k}").alias("rows")).alias(f"s{k}") for k in (0, 1))), "at")
    splits = F.array_sort(F.collect_list(F.struct("start", "s")))  # a row for each split of a file
    zero = F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(False).alias("inside"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row")))

    def step(done, x):
        before = F.element_at(done, -1)
        s = F.when(before["inside"], x["s"]["s1"]).otherwise(x["s"]["s0"])
        own = F.slice(done, 1, F.size(done) - 1)
        here = F.struct(x["start"].alias("start"), before["inside"].alias("inside"), before["block"].alias("block"), before["row"].alias("row"))
        behind = F.struct(x["start"].alias("start"), s["after"].alias("inside"), (before["block"] + s["blocks"]).alias("block"), (before["row"] + s["rows"]).alias("row"))
        return F.concat(own, F.array(here, behind))

    starts = lines.groupBy("file", "start").agg(last.alias("s")).groupBy("file").agg(F.aggregate(splits, zero, step).alias("x"))
    starts = starts.select("file", F.explode(F.slice("x", 1, F.size("x") - 1)).alias("x")).select("file", "x.*")
    known = lines.join(F.broadcast(starts.withColumnsRenamed({"block": "_block", "row": "_row"})), ["file", "start"])
    here = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")) + F.col(f"_{c}")
    placed = known.select("file", here("block").alias("block"), here("row").alias("row"), F.struct("start", "at", "value").alias("line"))
    return placed.groupBy("file", "block").agg(F.min("row").alias("row"), F.array_sort(F.collect_list("line"))["value"].alias("lines"))


_NOTED = ["value", "file", "start", "at", *(f"{c}{k}" for k in (0, 1) for c in ("block", "row", "after", "blocks", "rows"))]
_KINDS = [pa.int64(), *[pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()] * 2]


def _cells(blocks: DataFrame) -> DataFrame:
    """(file, row, cells) of blocks, cells in NFKC and trimmed; quoted cells may hold line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, first, lines in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "lines")), strict=True):
                for k, row in enumerate(csv.reader(io.StringIO("\n".join(lines) + "\n", newline=""))):
                    out.append((file, first + k, [unicodedata.normalize("NFKC", c).strip() for c in row]))
            columns = zip(*out, strict=True) if out else ([], [], [])
            types = (pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "row", "cells"])

    return blocks.mapInArrow(run, "file string, row long, cells array<string>")


def csv_table(spark: SparkSession, path: str, cleaned: bool = False, across: bool = False) -> DataFrame:
    """A CSV by its header: every cell text, missing ones empty, blank lines skipped, quoted cells may hold line breaks, a
    byte order mark is dropped; cleaned: white space collapsed too. Read by Spark's own reader, a file a task; of several
    files the first one's header holds, and each is numbered by itself, or (across) one after the other by name."""
    table = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    if not table.columns:
        return spark.createDataFrame([], "row_idx long")
    names = [c.removeprefix("\ufeff") for c in table.columns]
    form = clean if cleaned else lambda c: F.coalesce(c, F.lit(""))
    rows = file_rows(table, across=across)
    return rows.toDF("row_idx", *names).select("row_idx", *(form(F.col(f"`{h}`")).alias(h) for h in names))


def repaired(df: DataFrame, header: list[str]) -> DataFrame:
    """df with `cells`, rows of an old inventory whose empty level cells had moved the status, in the header's order.

    cells: an array in NFKC, trimmed. The first known status from the first level on is the status. The levels are what
    stands before it; over six, blanks go from the right as far as needed, then the rest joins into the sixth. What follows
    is the evidence, then notes. Without a known status the row is only padded or cut. Each step is a column of its own,
    as the next ones use it more than once.
    """
    start, status, room = header.index("一级功能"), header.index("验证状态"), len(LEVELS)
    known = F.array(*(F.lit(x) for x in sorted({*ALLOWED_STATUSES, *STATUS_ALIASES})))
    at, tail, before, left = (F.col(f"_{x}") for x in ("at", "tail", "before", "left"))
    out = df.withColumn("_tail", F.slice("cells", start + 1, F.lit(1 << 20)))
    out = out.withColumn("_at", F.array_position(F.transform(tail, lambda x: F.array_contains(known, x)), True).cast("int"))
    out = out.withColumn("_before", F.transform(F.slice(tail, F.lit(1), F.greatest(at - 1, F.lit(0))), lambda x, i: F.struct(i.alias("i"), x.alias("x"))))
    blanks = F.reverse(F.transform(F.filter(before, lambda r: r["x"] == ""), lambda r: r["i"]))
    out = out.withColumn("_go", F.slice(blanks, F.lit(1), F.greatest(F.size(before) - room, F.lit(0))))
    out = out.withColumn("_left", F.transform(F.filter(before, lambda r: ~F.array_contains(F.col("_go"), r["i"])), lambda r: r["x"]))
    sixth = F.array_join(F.slice(left, F.lit(room), F.lit(1 << 20)), " / ")
    out = out.withColumn("_levels", F.when(F.size(left) > room, F.concat(F.slice(left, 1, room - 1), F.array(sixth))).otherwise(left))
    out = out.withColumn("_rest", F.slice(tail, at + 1, F.lit(1 << 20)))
    cell = lambda c: F.coalesce(c, F.lit(""))
    moved = []
    for i, name in enumerate(header):
        if i == status:
            moved.append(cell(F.get(tail, at - 1)))
        elif name == "证据文件":
            moved.append(cell(F.get("_rest", F.lit(0))))
        elif name == "备注":
            moved.append(F.array_join(F.filter(F.slice("_rest", 2, 1 << 20), lambda x: x != ""), "；"))
        elif i < start:
            moved.append(cell(F.get("cells", F.lit(i))))
        else:
            moved.append(cell(F.get("_levels", F.lit(i - start))) if i < status else F.lit(""))
    padded = F.array(*(cell(F.get("cells", F.lit(i))) for i in range(len(header))))
    return out.withColumn("cells", F.when(at > 0, F.array(*moved)).otherwise(padded)).select(*df.columns)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """An inventory CSV by position: header and cells in NFKC, short rows padded, long ones cut, blank lines kept (as rows
    without a key). A header with status and first level but neither platform nor depth is old: its rows are repaired."""
    small_batches(spark)
    blocks = _blocks(spark, path)
    first = _cells(blocks.where("block = 0")).where("row = 0").first()
    header = list(first["cells"]) if first else []
    if not header:
        return spark.createDataFrame([], "row_idx long")
    old = {"验证状态", "一级功能"} <= set(header) and not {"平台", "验证深度"} & set(header)
    body = _cells(blocks).where("row > 0").select((F.col("row") - 1).alias("row_idx"), "cells")
    body = repaired(body, header) if old else body
    return body.select("row_idx", *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(header)))


def json_records(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """(row_idx, record variant) of a JSON list, or of the first of `keys` that a JSON object has."""
    v = _whole(spark, path).select(F.parse_json("content").alias("v"))
    inner = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "variant") for k in keys))
    lists = v.select(F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(inner).alias("v"))
    bad = lists.where(F.col("v").isNotNull() & ~F.schema_of_variant("v").startswith("ARRAY"))
    if not bad.isEmpty():
        raise ValueError(f"{path} holds neither a list nor an object with {', '.join(keys)}")
    lists.createOrReplaceTempView("_plumbline_json")
    each = spark.sql("select cast(e.pos as long) row_idx, e.value record from _plumbline_json, lateral variant_explode(v) e")
    return each.where(F.schema_of_variant("record").startswith("OBJECT"))


def update_records(spark: SparkSession, path: str, **defaults: str) -> DataFrame:
    """Canonical release records of a CSV, or of a JSON list or object with updates or records."""
    from plumbline.operators.releases import ALIASES, FIELDS, canonical

    if path.lower().endswith(".csv"):
        return canonical(csv_table(spark, path), **defaults)
    records = json_records(spark, path, ("updates", "records"))
    names = [*FIELDS, *ALIASES, "时间"]
    present = [r["k"] for r in records.select(F.explode(F.map_keys(F.expr("cast(record as map<string, variant>)"))).alias("k")).where(F.col("k").isin(*names)).groupBy("k").agg(F.count("*")).collect()]
    ordered = [n for n in names if n in present]
    return canonical(records.select("row_idx", *(F.try_variant_get("record", f"$['{n}']", "string").alias(n) for n in ordered)), **defaults)


def topic_config(text: str) -> dict[str, str]:
    """Topics of a JSON object of patterns; anything else is an error."""
    config = json.loads(text)
    if not isinstance(config, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in config.items()):
        raise ValueError("topics must map names to patterns")
    return config


def ui_nodes(trees: DataFrame, depth: int = 60) -> DataFrame:
    """All nodes of trees(screen, tree variant) with their attributes and reading order: (screen, path, key, text,
    bounds, type, clickable, selected). All trees go down together, a level a step; deeper trees are an error. Of nodes
    there may be any number (limit all lifts the session's limit of rows, a million, from this query)."""
    spark = trees.sparkSession
    trees.createOrReplaceTempView("_plumbline_trees")
    a = lambda n: f"coalesce(try_variant_get(c, '$.attributes.{n}', 'string'), '')"
    return spark.sql(f"""
        with recursive nodes(screen, c, path) max recursion level {depth} as (
          select screen, tree, array(0) from _plumbline_trees where tree is not null
          union all
          select n.screen, e.value, array_append(n.path, cast(e.pos as int)) from nodes n, lateral variant_explode(try_variant_get(n.c, '$.children', 'variant')) e
        )
        select screen, path, {a("key")} key, coalesce(nullif({a("text")}, ''), {a("originalText")}) text, {a("bounds")} bounds, {a("type")} type, {a("clickable")} clickable, {a("selected")} selected from nodes limit all""")


def review_fields(nodes: DataFrame) -> DataFrame:
    """(screen, idx, Username, Stars, StarMessage, Text, PostInfo) of nodes whose key names a review field and its number;
    a node without text makes the record and no field."""
    names = ["Username", "Stars", "StarMessage", "Text", "PostInfo"]
    pattern = r"^CommentDetail(Username|Stars|StarMessage|Text|PostInfo)(\d+)$"
    cells = nodes.select("screen", "path", F.regexp_extract("key", pattern, 1).alias("field"), F.regexp_extract("key", pattern, 2).try_cast("int").alias("idx"), "text").where("field <> ''")
    return cells.groupBy("screen", "idx").agg(*(F.coalesce(F.max_by("text", F.when((F.col("field") == n) & (F.col("text") != ""), F.col("path"))), F.lit("")).alias(n) for n in names))


def visible_text(nodes: DataFrame) -> DataFrame:
    """Texts of a screen in reading order, each (key, text, bounds, type) once."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("screen", "key", "text", "bounds", "type").orderBy("path"))
    return nodes.where("text <> ''").withColumn("_n", first).where("_n = 1").drop("_n")


def screens(spark: SparkSession, folder: str, offsets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt): review fields of all screen_*.json of a folder, numbers shifted by offsets(screen, shift), and
    the names of files that are no JSON."""
    files = _whole(spark, f"{folder}/screen_*.json").select(F.substring_index("path", "/", -1).alias("screen"), F.try_parse_json("content").alias("tree"))
    fields = review_fields(ui_nodes(files.where("tree is not null")))
    if offsets is not None:
        fields = fields.join(offsets, "screen", "left").withColumn("idx", F.col("idx") + F.coalesce("shift", F.lit(0))).drop("shift")
    return fields.where("idx >= 0"), files.where("tree is null").select("screen")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, nth, href, label) of the anchors of pages(page_id, html): offline stand-in for a page's DOM."""
    found = F.regexp_extract_all("html", F.lit(r'(<a href="[^"]*">[^<]*</a>)'), F.lit(1))
    each = pages.select("page_id", F.posexplode(found).alias("nth", "a"))
    return each.select("page_id", "nth", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", r">([^<]*)<", 1).alias("label"))


#: Headers of the templates that people fill in (fixed values).
INVENTORY_HEADER = ["应用", "平台", "版本", "构建号", "设备", "账号状态", "采集日期", "模块", "标准功能ID", *LEVELS, "验证状态", "验证深度", "证据ID", "证据文件", "备注"]
MANIFEST_HEADER = ["证据ID", "应用", "平台", "版本", "设备", "账号状态", "采集时间", "页面路径", "证据类型", "文件路径", "说明"]


def template(spark: SparkSession, header: list[str]) -> DataFrame:
    """An empty table with the header's columns."""
    return spark.createDataFrame([], T.StructType([T.StructField(h, T.StringType()) for h in header]))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema (nothing is inferred) and row numbers in file order; a file may have many splits."""
    rows = file_rows(spark.read.schema(schema).json(path))
    return rows.select(*rows.columns[1:], "row_idx")
