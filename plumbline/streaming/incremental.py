"""Incremental collection on file streams: keyed upserts per batch, replays without harm, refusal to merge blindly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.text import displayed_date
from plumbline.operators.reviews import index_offset, position_gaps, upsert

FIELDS = ["Username", "Stars", "StarMessage", "PostInfo"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _sight(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "idx", F.col("PostInfo").alias("post_info"), F.col("Stars").alias("stars"), F.col("Text").alias("text"))


def signature() -> Column:
    """A digest of the records of a group that does not depend on their order and adds up over parts: their number and the sum
    of 48 bits of each one's hash."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("idx", "PostInfo", "Text")))
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"))


def rebase(batch: DataFrame, history: DataFrame, known: DataFrame) -> DataFrame:
    """(screen, shift, votes) for each screen of a batch(screen, idx, ...): what brings its numbers to those of the history. A
    screen that known(screen, shift) has keeps its shift (votes 0), so a file that comes again is not judged anew; others
    take the shift that most of their records agree on; one that meets nothing of the history is of the same sitting as the
    rest and takes the shift of all new screens together. If these agree with nothing either, all shifts are null."""
    names = batch.select("screen").distinct().join(known.select("screen", F.col("shift").alias("_kept")), "screen", "left")
    fresh = batch.join(known.select("screen"), "screen", "left_anti")
    each = index_offset(_sight(history), _sight(fresh, "screen"), pages=["screen"]).select("screen", F.col("offset").alias("_own"), "votes")
    whole = index_offset(_sight(history), _sight(fresh)).select(F.col("offset").alias("_all"))
    told = names.join(each, "screen", "left").join(F.broadcast(whole), how="left")  # one row at most
    shift = F.coalesce("_kept", "_own", "_all").cast("long")
    return told.select("screen", shift.alias("shift"), F.when(F.col("_kept").isNotNull(), 0).otherwise(F.coalesce("votes", F.lit(0))).cast("long").alias("votes"))


def merge_batch(batch: DataFrame, epoch: int, target: str, align: bool = True, bound: str | None = None) -> None:
    """Adds a batch of partial records (idx, seq, fields, and screen: the file that shows them, where there are several) to the
    log under target, one folder per epoch: a replayed epoch overwrites itself.

    With align, each screen is shifted to where most of its records agree with the history (see rebase), and a batch that
    fits nowhere is refused. The shifts are written beside the log, before it (see offsets), and hold for a screen that is
    seen again, after a restart too. What was done is noted in the batch's progress row (see progress).
    """
    spark = batch.sparkSession
    batch = batch.withColumn("seq", F.col("seq").cast("int"))
    batch = batch if "screen" in batch.columns else batch.withColumn("screen", F.lit(f"batch {epoch}"))
    log, shifts = f"{target}/log/epoch={epoch}", f"{target}/offsets/epoch={epoch}"
    past = align and _exists(spark, f"{target}/log") and not batch.isEmpty()
    history = current(spark, target, epoch) if past else None
    if history is not None and not history.isEmpty():
        known = offsets(spark, target, epoch)
        rebase(batch, history, known).coalesce(1).write.mode("overwrite").parquet(shifts)  # a row for each screen of a batch
        if not spark.read.parquet(shifts).where("shift is null").isEmpty():
            _delete(spark, shifts)
            raise ValueError("the batch overlaps nothing collected before")
    else:
        batch.select("screen").distinct().select("screen", F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("votes")).coalesce(1).write.mode("overwrite").parquet(shifts)
    moved = batch.join(spark.read.parquet(shifts).select("screen", "shift"), "screen")
    moved.withColumn("idx", (F.col("idx") + F.col("shift")).cast(batch.schema["idx"].dataType)).drop("shift").write.mode("overwrite").parquet(log)
    written = spark.read.parquet(log)
    day = displayed_date(F.col("PostInfo"), F.lit(bound).cast("date"))[0] if bound else F.lit(None).cast("date")
    note = written.agg(F.lit(epoch).cast("long").alias("screen"), F.count("*").alias("records"), F.max(day).alias("newest_date"), signature().alias("signature"))
    most = spark.read.parquet(shifts).agg(F.coalesce(F.max_by("shift", "votes"), F.lit(0)).cast("long").alias("shift"))
    note.crossJoin(F.broadcast(most)).coalesce(1).write.mode("overwrite").parquet(f"{target}/progress/epoch={epoch}")  # one row each


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def offsets(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(screen, shift): by how much the numbers of each screen were shifted when it was first merged (in epochs before one, if
    given). With readers.screens() it builds the records anew from the raw files."""
    if not _exists(spark, f"{target}/offsets"):
        return spark.createDataFrame([], "screen string, shift long")
    log = spark.read.schema("screen string, shift long, votes long, epoch long").parquet(f"{target}/offsets")
    if before is not None:
        log = log.where(F.col("epoch") < before)
    return log.groupBy("screen").agg(F.min_by("shift", "epoch").alias("shift"))


def progress(spark: SparkSession, target: str) -> DataFrame:
    """One row for each merged batch: screen (its epoch), records, the shift that aligned it (of several, that with most votes),
    its newest date (where the day of collection was given) and a signature of what it showed."""
    return spark.read.parquet(f"{target}/progress").select("screen", "records", "shift", "newest_date", "signature")


def compact(spark: SparkSession, target: str, upto: int) -> None:
    """Replaces the epochs up to `upto` by one with the records as they stand, so that later batches read less. The records
    are written beside the log first, then moved into its last epoch, above all that it has; only then the older epochs go.
    A run that dies on the way leaves a log that gives the same records."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    epochs = [r["epoch"] for r in spark.read.parquet(f"{target}/log").where(F.col("epoch") <= upto).select("epoch").distinct().collect()]
    if len(epochs) < 2:
        return
    fresh, home = f"{target}/compacted", f"{target}/log/epoch={max(epochs)}"
    current(spark, target, upto + 1).withColumn("seq", F.lit((1 << 31) - 1)).write.mode("overwrite").parquet(fresh)
    fs = path(fresh).getFileSystem(conf)
    for status in fs.listStatus(path(fresh)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), path(f"{home}/{status.getPath().getName()}"))
    for epoch in epochs:
        if epoch != max(epochs):
            fs.delete(path(f"{target}/log/epoch={epoch}"), True)


def gaps(spark: SparkSession, target: str, before: int | None = None, month: tuple[int, int] | None = None, collected: str | None = None) -> DataFrame:
    """One row of position_gaps() over the list (list: all), or over the positions of one month's records, dated as seen from
    the day of collection; a list without gaps has a row with 0."""
    rows = current(spark, target, before)
    if month:
        day = displayed_date(F.col("PostInfo"), F.lit(collected).cast("date"))[0]
        rows = rows.withColumn("_d", day).where((F.year("_d") == month[0]) & (F.month("_d") == month[1]))
    found = position_gaps(rows.withColumn("list", F.lit("all")), ["list"], "idx")
    whole = spark.range(1).select(F.lit("all").alias("list"))
    return whole.join(found, "list", "left").select("list", F.coalesce("gap_count", F.lit(0)).cast("long").alias("gap_count"), F.coalesce("first_gaps", F.array().cast("array<bigint>")).alias("first_gaps"))


def fill_gaps(spark: SparkSession, target: str, extra: DataFrame, epoch: int, month: tuple[int, int] | None = None, collected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A backward pass: extra partial records merged like any batch (aligned, or refused), and the missing positions before
    and after, a row each of gaps(). The log keeps every epoch, so both come from it, after a restart too."""
    merge_batch(extra, epoch, target, align=True)
    return gaps(spark, target, epoch, month, collected), gaps(spark, target, epoch + 1, month, collected)


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The records as of all merged batches (of epochs before one, if given); later epochs are newer."""
    log = spark.read.parquet(f"{target}/log")
    if before is not None:
        log = log.where(F.col("epoch") < before)
    return upsert(log.withColumn("_order", F.struct("epoch", "seq")), "idx", "_order", FIELDS, "Text")


def collect_screens(stream: DataFrame, target: str, checkpoint: str, align: bool = True, bound: str | None = None) -> StreamingQuery:
    """Runs a stream of partial records into the log until the input is used up; restarts go on after the last batch. A batch
    that overlaps nothing collected before stops the query, unless align is off."""
    return stream.writeStream.foreachBatch(lambda b, e: merge_batch(b, e, target, align, bound)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def should_stop(progress: DataFrame, bound: Column, most: int) -> bool:
    """Whether collection may end: the newest screen(screen, newest_date, signature) lies before the bound, the last four
    signatures are equal, or there are `most` screens."""
    last = progress.orderBy(F.desc("screen")).limit(4).withColumn("_past", F.col("newest_date") < bound).collect()
    plateau = len(last) == 4 and len({r["signature"] for r in last}) == 1
    return bool(last) and (bool(last[0]["_past"]) or plateau or progress.count() >= most)


def daily(stream: DataFrame, time: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events and mean value per tumbling window, closed by a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("day"), "event_type", "n", "mean_value")
