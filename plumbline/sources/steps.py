"""Steps between scans and results: rows dealt out evenly or by keys, tables that are computed once, the shared folder they lie in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def evenly(df: DataFrame) -> DataFrame:
    """A scan dealt out evenly where it has fewer splits than the session has cores, for rows that take much work each: a file
    of one row group is one task, whatever it costs. A table of more splits stays as it is, so what moves is at most one
    split for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str, share: int = 8 << 20) -> DataFrame:
    """df dealt out by keys to as many tasks as the session's shuffles have, or more: one for each `share` bytes of the files
    that it reads. The number is given, so small parts are not joined again by their compressed size, which tells little of
    what sorts and tables of distinct rows hold of them: a task's memory stays the same however large the files are."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).nodeName() == "LogicalRelation"]
    size = sum(int(str(f.stats().sizeInBytes())) for f in files)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-size // share)), *keys)


#: The session's bound on the bytes of a batch that goes to Python.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches to Python hold about 4 MB where the session sets no bound of its own: by rows alone they grow with the table up
    to 64 MB, of which a worker holds several copies in several forms."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(4 << 20))


def shared_folder(spark: SparkSession, name: str = "files") -> str:
    """A new folder in the shared one (spark.checkpoint.dir), which goes when the driver ends; a temporary one where that is
    unset and all tasks run in this process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="plumbline-")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return folder


def once(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: computed once however often it is read, and no lost executor costs
    more than its tasks."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
