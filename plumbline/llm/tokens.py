"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe import encoder
from plumbline.llm.common import FREQUENT, Sieve, chunks, discard, mapped, sieve, spread_join, stored, unused, work_dir

COUNTS = "content_digest binary, n_tokens long"


def tokenizer_digest(tokenizer: str) -> str:
    """The tokenizer's version: the SHA-256 of its file in hex digits."""
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _hash(digest: Column) -> Column:
    """The first 64 bits of a digest."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _hashes(digests: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big") for d in digests.to_pylist()], np.uint64)


def default_cache(spark: SparkSession) -> str:
    """The cache that calls without one of their own share: a folder in the shared folder, kept between calls."""
    return f"{work_dir(spark)}/token-cache"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts (content_digest, n_tokens) that are stored for a tokenizer, none where there is no cache yet. Only that
    tokenizer's folder is read."""
    folder = f"{cache}/tokenizer_digest={version}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(COUNTS).parquet(folder) if there else spark.createDataFrame([], COUNTS)


def _encoded(texts: DataFrame, tokenizer: str, ranks: str | None) -> DataFrame:
    """(content_digest, n_tokens) of texts(content_digest, text), once for each digest of a task."""

    def run(batches):
        encode, seen = encoder(tokenizer, ranks), set()
        for batch in batches:
            keys, n = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d not in seen:
                    seen.add(d)
                    keys.append(d)
                    n.append(len(encode(t)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["content_digest", "n_tokens"])

    return mapped(texts, run, COUNTS)


def _sorted_out(texts: DataFrame, known: Sieve, moved: Sieve, tokenizer: str, ranks: str | None) -> DataFrame:
    """(content_digest, n_tokens, text): counts of the texts that no sieve holds, encoded where they lie; the texts that
    both hold, once for each task, for the exact route. What only `known` holds has a count already."""
    a, b = (texts.sparkSession.sparkContext.broadcast(s) for s in (known, moved))

    def run(batches):
        encode, seen = encoder(tokenizer, ranks), set()
        for batch in batches:
            digests = batch.column(0)
            h = _hashes(digests)
            mine = np.ones(len(h), bool)
            perhaps = a.value.passed(h)
            mine[perhaps] = False
            further = perhaps[b.value.passed(h[perhaps])]
            own = np.flatnonzero(mine)
            n = [len(encode(t)) for _, part in chunks(batch.column(1).take(pa.array(own)).to_pylist()) for t in part]
            go = []
            for i in further.tolist():
                d = digests[i].as_py()
                if d not in seen:
                    seen.add(d)
                    go.append(i)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([digests.take(pa.array(own)), pa.array(n, pa.int64()), pa.nulls(len(own), pa.string())], names=["content_digest", "n_tokens", "text"])
            go = pa.array(go, pa.int64())
            yield pa.RecordBatch.from_arrays([digests.take(go), pa.nulls(len(go), pa.int64()), batch.column(1).take(go)], names=["content_digest", "n_tokens", "text"])

    return mapped(texts, run, f"{COUNTS}, text string")


def fill_cache(docs: DataFrame, tokenizer: str, ranks: str | None, cache: str) -> DataFrame:
    """Appends the counts of all contents of docs(text) that the cache has none of; returns a stored
    table (content_digest, rows, stored): how many rows of docs have each content, and whether the cache had it.

    Only digests are shuffled to find what is stored, what occurs once and what repeats. A sieve of the stored and the
    repeated ones tells each task which of its texts are new and single: these are encoded where they lie. Of the others, a
    second sieve lets those through that need encoding after all; they alone are shuffled, joined to the exact list, and
    encoded once each. Sieves are of bounded size and only save moving texts: what they let through is decided exactly.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    have = read_cache(spark, cache, version).select("content_digest", F.lit(True).alias("stored"))
    counted = docs.select(_digest().alias("content_digest")).groupBy("content_digest").agg(F.count("*").alias("rows"))
    met = stored(counted.join(have.distinct(), "content_digest", "left").select("content_digest", "rows", F.coalesce("stored", F.lit(False)).alias("stored")), "token-digests")
    missing = met.where("not stored")
    if missing.isEmpty():
        return met
    held = met.where("stored or rows > 1").select(_hash(F.col("content_digest")).alias("hash"))
    known = sieve(held, held.count(), each=32)
    among = spark.sparkContext.broadcast(known)

    def let_through(batches):
        for batch in batches:
            yield batch.take(pa.array(among.value.passed(_hashes(batch.column(0)))))

    again = stored(mapped(missing.select("content_digest"), let_through, "content_digest binary"), "token-moved")
    moved = sieve(again.select(_hash(F.col("content_digest")).alias("hash")), again.count(), each=32)
    texts = docs.select(_digest().alias("content_digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parted = stored(_sorted_out(texts, known, moved, tokenizer, ranks), "token-parted")
    exact = parted.where("text is not null").join(again.hint("merge"), "content_digest", "left_semi").select("content_digest", "text")
    new = parted.where("text is null").select("content_digest", "n_tokens").unionByName(_encoded(exact, tokenizer, ranks))
    new.write.mode("append").option("compression", "zstd").parquet(f"{cache}/tokenizer_digest={version}")
    for step in (again, parted):
        discard(step)
    return met


def token_counts(docs: DataFrame, tokenizer: str, ranks: str | None = None, cache: str | None = None) -> DataFrame:
    """docs with n_tokens (long): tokens of the whole text, null counting as empty.

    Contents are keyed by the SHA-256 of their UTF-8 bytes (the only normalisation that keeps counts exact: null as
    empty) and of the tokenizer's file. Counts stored in `cache` (a folder of Parquet that all machines reach, a
    subfolder for each tokenizer; that of default_cache if None, which later calls find filled) are joined; only distinct
    misses are encoded, and appended. A run that dies leaves the cache as it was; repeated keys are read as one. Extra
    columns stay, whatever their names; n_tokens is replaced. Contents with more than 1 in 4096 of all rows (so at most
    4096 of them) get their counts from a broadcast, so that no frequent text meets in one task.
    """
    spark = docs.sparkSession
    cache = cache or default_cache(spark)
    met = fill_cache(docs, tokenizer, ranks, cache)
    key = unused(docs, "_digest")
    counts = read_cache(spark, cache, tokenizer_digest(tokenizer)).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = counts.withColumnRenamed("content_digest", key)
    total = met.agg(F.sum("rows")).first()[0] or 0
    often = met.where(F.col("rows") > max(1.0, total / FREQUENT)).select(F.col("content_digest").alias(key))
    frequent = stored(often.join(counts, key), "token-frequent")
    discard(met)
    return spread_join(docs.drop("n_tokens").withColumn(key, _digest()), counts, key, frequent).drop(key)
