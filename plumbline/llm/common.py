"""What the operators share: the shared work folder, hash splits, Arrow column mapping, materialised steps."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the context has. A
    temporary folder only where neither is set and all tasks run in this process (local mode); else it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if base is None and held.isDefined():
        base = held.get()
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives lost executors, is computed once.

    Spark deletes the shuffle files of the writing plan when the write ends, as nothing reads them again; if executors are
    lost during it, their tasks run again like any others.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that no result needs any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo m; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def unit_hash(key: Column) -> Column:
    """A deterministic number in [0, 1) from the key, for sampling that repeats on retries."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def release() -> None:
    """Gives memory that this process holds but does not use back to the system, where the system's library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of about 4 MB, so that a task holds little of its rows in either process: the
    session's bound on a batch's bytes is set where it is unset. A single longer row is a batch of its own. Workers stay
    between tasks, so each task gives back what it no longer needs when it ends."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(4 << 20))

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(run_and_release, schema)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


#: A key that more than 1 row in so many has counts as frequent: there are at most so many of them, whatever the table.
FREQUENT = 4096


def spread_join(rows: DataFrame, table: DataFrame, key: str, frequent: DataFrame) -> DataFrame:
    """rows with the other columns of table, which has each key once; null where table lacks the key.

    frequent: those rows of table whose key more than 1 in FREQUENT rows has, so at most FREQUENT of them. They are
    broadcast; rows that they match are dealt out evenly, so the rows of one key never meet in one task.
    """
    columns = [c for c in table.columns if c != key]
    near, far = ({c: unused(rows, f"_{kind}_{c}") for c in columns} for kind in ("near", "far"))
    hit, dealt = unused(rows, "_hit"), unused(rows, "_dealt")
    few = frequent.select(key, *(F.col(c).alias(near[c]) for c in columns), F.lit(True).alias(hit))
    kind = rows.schema[key].dataType
    number = F.monotonically_increasing_id()
    spread = number.cast("string").cast(kind) if isinstance(kind, (T.StringType, T.BinaryType)) else number.cast(kind)
    mine = rows.join(F.broadcast(few), key, "left").withColumn(dealt, F.when(F.col(hit).isNull(), F.col(key)).otherwise(spread))
    joined = mine.join(table.select(F.col(key).alias(dealt), *(F.col(c).alias(far[c]) for c in columns)), dealt, "left")
    return joined.select(*rows.columns, *(F.when(F.col(hit).isNotNull(), F.col(near[c])).otherwise(F.col(far[c])).alias(c) for c in columns))


class Sieve:
    """A set of 64-bit hashes as a bitmap with two bits for each: it may let others through, never loses one of its own."""

    def __init__(self, bitmap: np.ndarray, bits: int) -> None:
        self.bitmap, self.bits = bitmap, bits

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Where in h (unsigned) the hashes are that pass."""
        a = h >> np.uint64(64 - self.bits)
        at = np.flatnonzero(self.bitmap[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8) & 1)
        b = h[at] & np.uint64((1 << self.bits) - 1)
        return at[(self.bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1) == 1]


def sieve(hashes: DataFrame, n: int, each: int = 256, most: int = 28, at_once: bool = False) -> Sieve:
    """The sieve of hashes(hash long), about n rows: `each` bits for a hash up to 2**most bits in all (32 MB), which bounds
    what a task, the driver and a broadcast of it hold; with more hashes it lets more through. Bits are dealt out by where
    they lie, so each task fills parts of its own and no part is sent twice. at_once: the driver gets all parts in one job
    (the bound holds twice then), else a task's at a time."""
    bits = int(np.clip(np.ceil(np.log2(each * max(1, n))), 16, most))
    part = 1 << 16  # bits
    signed = F.col("hash")
    places = hashes.select(F.explode(F.array(F.shiftrightunsigned(signed, 64 - bits), signed.bitwiseAND((1 << bits) - 1))).alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            bit = batch.column(0).to_numpy()
            np.bitwise_or.at(held, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
        rows = held.reshape(-1, part >> 3)
        for k in np.flatnonzero(rows.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rows[k].tobytes()], pa.binary())], names=["part", "bitmap"])

    bitmap = np.zeros(1 << bits - 3, np.uint8)
    parts = mapped(places.repartition(F.shiftright("bit", 16)), run, "part long, bitmap binary")
    for r in parts.collect() if at_once else parts.toLocalIterator():
        bitmap[r["part"] * (part >> 3) :][: part >> 3] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return Sieve(bitmap, bits)


def map_columns(df: DataFrame, inputs: list[str], outputs: str, factory: Callable[[], Callable]) -> DataFrame:
    """Appends columns computed from Arrow arrays of the inputs. factory() is called once per task and returns a
    function of the input arrays that returns the output arrays. Columns of df named like an output are replaced."""
    added = T.StructType.fromDDL(outputs)
    kept = df.drop(*(f.name for f in added if f.name.lower() not in {x.lower() for x in inputs}))
    at = [kept.columns.index(next(c for c in kept.columns if c.lower() == x.lower())) for x in inputs]
    carried = [i for i, c in enumerate(kept.columns) if c.lower() not in {f.name.lower() for f in added}]
    schema = T.StructType([kept.schema[i] for i in carried] + list(added))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = factory()
        for batch in batches:
            if batch.num_rows:
                new = function(*(batch.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in carried] + list(new), names=names)

    return mapped(kept, run, schema)


def chunks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about `most` characters, with the index of their first; one text is never cut."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > most:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def without(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """docs without the rows whose doc_id is in ids(doc_id), null like any other. Up to `most` ids are broadcast (they are
    counted first), so the texts stay where they are; more are joined by a shuffle."""
    name = unused(docs, "_gone")
    gone = stored(ids.select(F.col("doc_id").alias(name)).distinct(), "gone")
    small = gone.limit(most + 1).count() <= most
    return docs.join(F.broadcast(gone) if small else gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
