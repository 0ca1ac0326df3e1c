"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import FREQUENT, discard, map_columns, mapped, spread_join, stored, without
from plumbline.llm.graph import components

BITS = 64


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit SimHash of a text's word n-grams: bit i is set if it is set in over half the XXH64 (seed 42) hashes.

    A-Z are lower-cased; words are runs without ASCII white space; fewer than n words are one shingle, no word gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """docs with the column fingerprint (bigint holding the 64 bits). Null and empty texts get 0; texts are read whole."""

    def factory():
        def run(text):
            values = np.array([fingerprint(t, n) for t in text.to_pylist()], np.uint64)
            return (pa.array(values.view(np.int64)),)

        return run

    return map_columns(docs, ["text"], "fingerprint long", factory)


def masks(radius: int = 3) -> list[int]:
    """The 2**(radius+1) - 1 covering masks. Bit i has a non-zero vector m(i) of radius+1 bits, dealt out evenly; the mask
    of a non-zero v keeps the bits with an odd <m(i), v>. Any `radius` differing bits leave a v that is orthogonal to
    all their vectors, so some mask hides every difference and the pair collides there."""
    top = (1 << radius + 1) - 1
    vectors = [1 + i % top for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For each group that links within the radius form among the values: an edge from its first value to each other."""
    out, left = [], np.ones(len(values), bool)
    for i in range(len(values)):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            near = np.flatnonzero(left & (np.bitwise_count(values ^ values[todo.pop()]) <= radius))
            left[near] = False
            todo.extend(near.tolist())
            out.extend((i, int(j)) for j in near)
    return out


def _small(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                v = np.array(row.as_py(), np.int64)
                for i, j in forest(v.view(np.uint64), radius):
                    a.append(v[i])
                    b.append(v[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return mapped(buckets.select("members"), run, "a long, b long")


def _large(rows: DataFrame, radius: int) -> DataFrame:
    """Links in buckets too large to compare in one task. Values within the radius share a value z that is one flip of a
    bit (or none) from one of them and at most radius - 1 flips from the other; all flips are of bits that the mask
    hides. Each value goes to its own z; in each z, the smallest value at most one flip away links to all others there:
    every such link is within the radius, and the links connect whatever is linked."""
    table = masks(radius)

    def run(batches):
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hidden = [np.uint64(1 << i) for i in range(BITS) if not table[t] >> i & 1]
                z, near = [], []
                for k in range(max(1, radius - 1) + 1):
                    for flips in itertools.combinations(hidden, k):
                        z.append(np.uint64(x & (1 << 64) - 1) ^ np.bitwise_or.reduce(np.array(flips, np.uint64)) if flips else np.uint64(x & (1 << 64) - 1))
                        near.append(k <= min(1, radius))
                n = len(z)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.array(z, np.uint64).view(np.int64)), pa.array(np.full(n, x, np.int64)), pa.array(near)], names=["t", "z", "x", "near"])

    balls = mapped(rows, run, "t int, z long, x long, near boolean")
    hubs = balls.groupBy("t", "z").agg(F.min(F.when(F.col("near"), F.col("x"))).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null").drop("n")
    return balls.join(hubs, ["t", "z"]).where("x <> hub").select(F.col("hub").alias("a"), F.col("x").alias("b")).distinct()


def links(values: DataFrame, radius: int = 3, bucket: int = 1024) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of values(fingerprint) that connect all those which chains of
    links of at most `radius` bits connect; every edge is itself such a link.

    Buckets of up to `bucket` distinct fingerprints are compared in one task; larger ones take an exact route whose
    work is linear in their size. No pair is emitted for each pair in a bucket.
    """
    table = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks(radius)))
    rows = values.select(F.col("fingerprint").alias("x"), F.posexplode(table).alias("t", "mask")).select("t", "x", F.col("x").bitwiseAND(F.col("mask")).alias("key"))
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, ["t", "key"]), "simhash-shared")
    small = shared.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("x").alias("members"))
    edges = _small(small, radius)
    large = shared.where(F.col("n") > bucket)
    if not large.isEmpty():
        edges = edges.unionByName(_large(large.select("t", "x"), radius))
    edges = stored(edges.distinct(), "simhash-edges")
    discard(shared)
    return edges


def near_duplicates(docs: DataFrame, radius: int = 3, n: int = 3, bucket: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (bigint), component_id (the smallest doc_id reachable over links of
    at most `radius` differing bits, itself included).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay, each with the same class. A
    null doc_id is never the smallest while its class has another; a class of nulls alone has a null component_id.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), n).select("doc_id", "fingerprint"), "simhash-prints")
    values = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    edges = links(values, radius, bucket)
    roots = components(edges, "simhash-links")
    discard(edges)
    classed = values.join(roots, values.fingerprint == roots.node, "left").select("fingerprint", "first", "rows", F.coalesce("root", "fingerprint").alias("root"))
    smallest = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classed.join(smallest, "root").select("fingerprint", "component_id", "rows")
    often = classes.where(F.col("rows") > max(1.0, prints.count() / FREQUENT)).drop("rows")
    return spread_join(prints, classes.drop("rows"), "fingerprint", often).select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, radius: int = 3, n: int = 3) -> DataFrame:
    """docs without all but the document with the smallest doc_id of each near-duplicate class (of rows that repeat that
    doc_id one stays; a row with a null doc_id stays only in a class of nulls)."""
    first = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = without(docs, near_duplicates(docs, radius, n).groupBy("doc_id").agg(first.alias("first")).where("not first").select("doc_id"))
    again = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return out.dropDuplicates(["doc_id"]) if again else out
