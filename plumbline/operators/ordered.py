"""Numbers and running values over long ordered groups, in stretches, so that no group is one task.

Each stretch of positions is looked at by itself; one row for each stretch then tells what lies before it. These rows are few
(one for so many positions, or for each split of a file); they are broadcast where a count shows that, else joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many stretches are broadcast; with more of them the join is left to the planner.
FEW = 100_000


def _small(parts: DataFrame) -> DataFrame:
    return F.broadcast(parts) if parts.limit(FEW + 1).count() <= FEW else parts


def numbered(df: DataFrame, name: str, order: str, by: list[str] | None = None, stretch: int = 1 << 16) -> DataFrame:
    """df with name: the row's number (from 1) within `by` by the integer column `order`, whose values differ within `by`."""
    by = by or []
    part = F.floor(F.col(order) / F.lit(stretch)).alias("_part")
    counts = df.groupBy(*by, part).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = _small(counts.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before")))
    rows = df.withColumn("_part", part).withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_part")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.alias("r").join(starts.alias("s"), on).select(*(F.col(f"r.{c}") for c in df.columns), (F.col("s._before") + F.col("r._nth")).alias(name))


def file_rows(scan: DataFrame, name: str = "row_idx", across: bool = False) -> DataFrame:
    """The rows of a file scan with name: their number from 0 in the order of their file (across: of all files by name).

    A split's rows stand one after the other in one task, so a row's place in its split is its running id less the least of
    the split; how many rows lie in the splits before comes from one row for each split. Nothing is sorted or shuffled.
    """
    held = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    splits = held.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    by = Window.orderBy("_file", "_block") if across else Window.partitionBy("_file").orderBy("_block")  # a row for each split
    before = F.coalesce(F.sum("_rows").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = _small(splits.select("_file", "_block", (before - F.col("_first")).alias("_shift")))
    return held.join(starts, ["_file", "_block"]).select((F.col("_at") + F.col("_shift")).cast("long").alias(name), *(F.col(f"`{c}`") for c in scan.columns))


def last_before(df: DataFrame, name: str, value: Column, order: str, by: list[str] | None = None, stretch: int = 1 << 16) -> DataFrame:
    """df with name: the last value that is not null at or before each row, within `by` by the integer column `order`."""
    by = by or []
    rows = df.withColumn("_part", F.floor(F.col(order) / F.lit(stretch))).withColumn("_value", value)
    ends = rows.groupBy(*by, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = _small(ends.select(*by, "_part", carried.alias("_carried")))
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    on = F.col("r._part").eqNullSafe(F.col("s._part"))
    for c in by:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = rows.withColumn("_inside", inside).alias("r").join(starts.alias("s"), on)
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), F.coalesce("r._inside", "s._carried").alias(name))
