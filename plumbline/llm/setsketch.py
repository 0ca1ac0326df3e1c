"""Near-duplicate classes of documents by SetSketch registers over their sets of word shingles.

A register is the truncated logarithm to base B of the least of exponentially distributed values that a hash gives each
element: K = floor(1 - log_B(min x)), within 0 to Q + 1. The registers of a union are the maxima of two sets' registers, and
those of similar sets are mostly equal. Bands of them lead to candidates, the joint likelihood of all registers of two sets
decides which of these can be similar enough, and full sets confirm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import FREQUENT, discard, mapped, sieve, spread_join, stored
from plumbline.llm.graph import components

M, B, A, Q = 256, 1.02, 20.0, (1 << 12) - 2  # registers, base, rate, limit
BANDS, WIDTH = 64, 8

_random = np.random.default_rng(11)
_LOW, _HIGH = (_random.integers(1, 1 << 32, M, dtype=np.uint32) | np.uint32(1) for _ in range(2))
#: The registers of each band, drawn without repeats within a band.
_BANDS = np.stack([_random.permutation(M)[:WIDTH] for _ in range(BANDS)])
_FACTORS = _random.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_C1, _C2, _C3, _C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C3
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct 2-word shingles of a text, A-Z lower-cased, words between ASCII white space, as sorted 64-bit hashes; one
    word is a shingle by itself, no word gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    if len(h) < 2:
        return mixed(h * _C1 + _C4)
    return np.unique(mixed(h[:-1] * _C1 + h[1:] * _C2))


def registers(elements: np.ndarray) -> np.ndarray:
    """The M registers of a set: for each the largest of uniform hashes of the elements, as -log of a uniform number is
    exponential and its least value belongs to the largest number."""
    low, high = elements.astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    best = np.zeros(M, np.uint32)
    for k in range(0, len(elements), 256):
        v = low[k : k + 256, None] * _LOW
        v += high[k : k + 256, None] * _HIGH
        np.maximum(best, v.max(0), out=best)
    least = -np.log((best + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, Q + 1).astype(np.uint16)


def at_least(similarity: float, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the most likely Jaccard similarity of each pair of sets is at least `similarity`, from their registers (rows of
    a and b) and sizes. The likelihood of the numbers of larger, smaller and equal registers is concave in the similarity,
    so its maximum lies there if its slope at `similarity` is not negative."""
    n_a, n_b = np.broadcast_arrays(np.asarray(n_a, float), np.asarray(n_b, float))
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    possible = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)
    more, fewer = (a > b).sum(-1), (a < b).sum(-1)
    step = (B - 1) / B
    chance, slope = (lambda x: -np.log1p(-x * step) / np.log(B)), (lambda x: step / ((1 - x * step) * np.log(B)))
    x, y = np.maximum(u - v * similarity, 1e-9), np.maximum(v - u * similarity, 1e-9)
    p, q = chance(x), chance(y)
    score = -more * v * slope(x) / p - fewer * u * slope(y) / q + (M - more - fewer) * (v * slope(x) + u * slope(y)) / (1 - p - q)
    return possible & (score >= 0)


def bands(matrix: np.ndarray) -> np.ndarray:
    """The 64-bit bucket of each set (row of registers) in each band."""
    h = (matrix[:, _BANDS].astype(np.uint64) * _FACTORS).sum(2, dtype=np.uint64)
    return mixed(h + np.arange(BANDS, dtype=np.uint64) * _C2)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, registers) of each document; registers only where a task meets a set first. The digest is
    of the set, so equal sets are one from here on; an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, sizes, held = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                fresh = digest is not None and digest not in seen
                if fresh:
                    seen.add(digest)
                digests.append(digest and digest.hex())
                sizes.append(len(s))
                held.append(registers(s).tobytes() if fresh else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "digest", "n_shingles", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, digest string, n_shingles long, registers binary")


def buckets(sets: DataFrame, wanted=None) -> DataFrame:
    """(bucket, node) of sets(node, registers) in all bands, or of the buckets that a sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted and wanted.value
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for k in range(0, len(nodes), 512):
                part = batch.column(1).slice(k, 512)
                keys = bands(np.frombuffer(b"".join(part.to_pylist()), np.uint16).reshape(-1, M)).ravel()
                who = np.repeat(nodes[k : k + 512], BANDS)
                if held is not None:
                    at = held.passed(keys)
                    keys, who = keys[at], who[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who)], names=["bucket", "node"])

    return mapped(sets.select("node", "registers"), run, "bucket long, node long")


def forest(n: int, near) -> list[tuple[int, int]]:
    """Edges that connect what links connect among 0 to n - 1; near(i, others) tells which of the others link to i. What has
    been reached is not compared again, so a group of alike members costs one look at each."""
    out, left = [], np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            at = todo.pop()
            others = np.flatnonzero(left)
            if not len(others):
                break
            hit = others[near(at, others)]
            left[hit] = False
            todo.extend(hit.tolist())
            out.extend((at, int(j)) for j in hit)
    return out


def set_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest over the links of full sets: 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    together = lambda inter, a, b: 100 * inter >= percent * (a + b - inter)
    if len(sets) == 2:
        return [(0, 1)] if together(len(np.intersect1d(*sets, assume_unique=True)), *sizes) else []
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [place[e - s : e] for s, e in zip(sizes, ends, strict=True)]
    mark = np.zeros(int(place.max()) + 1, bool)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        fit = 100 * np.minimum(sizes[others], sizes[at]) >= percent * np.maximum(sizes[others], sizes[at])
        out = np.zeros(len(others), bool)
        if fit.any():
            mark[own[at]] = True
            some = others[fit]
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            inter = np.add.reduceat(mark[np.concatenate([own[j] for j in some])], starts, dtype=np.int64)
            mark[own[at]] = False
            out[fit] = together(inter, sizes[some], sizes[at])
        return out

    return forest(len(sets), near)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _likely(groups: DataFrame, similarity: float) -> DataFrame:
    """Candidate edges in groups(members array of node, n, registers), a forest for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
            node, size = (flat.field(k).to_numpy() for k in ("node", "n"))
            matrix = np.frombuffer(b"".join(flat.field("registers").to_pylist()), np.uint16).reshape(-1, M)
            starts = np.concatenate([[0], np.cumsum(ends)[:-1]])
            two = starts[ends == 2]  # most groups: all at once
            a, b = [], []
            for k in range(0, len(two), 4096):
                x, y = two[k : k + 4096], two[k : k + 4096] + 1
                hit = at_least(similarity, matrix[x], matrix[y], size[x], size[y])
                a += node[x[hit]].tolist()
                b += node[y[hit]].tolist()
            for s, n in zip(starts[ends > 2].tolist(), ends[ends > 2].tolist(), strict=True):
                own, sizes = matrix[s : s + n], size[s : s + n]
                for i, j in forest(n, lambda at, others: at_least(similarity, own[others], own[at], sizes[others], sizes[at])):  # noqa: B023
                    a.append(node[s + i])
                    b.append(node[s + j])
            yield _pairs(a, b)

    return mapped(groups.select("members"), run, "a long, b long")


def _blocks(rows: DataFrame, keys: list[str], n: str, limit: int) -> DataFrame:
    """rows of groups with over `limit` members (their number in column n) dealt to pairs of blocks of half that size, so that
    any two members meet in a group of about `limit`."""
    count = F.ceil(F.col(n) * 2 / limit).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least("_own", j).alias("low"), F.greatest("_own", j).alias("high")))
    dealt = rows.withColumn("_blocks", count).withColumn("_own", own).withColumn("_pair", F.explode(pairs))
    return dealt.select(F.xxhash64(*keys, "_pair").alias("group"), "node")


def _members(groups: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """(members) of groups(group, node) with columns of sets(node, ...)."""
    return groups.select("group", "node").join(sets.select("node", *columns), "node").groupBy("group").agg(F.collect_list(F.struct("node", *columns)).alias("members")).where(F.size("members") > 1)


def _compared(pairs: DataFrame, sets: DataFrame, close: float, absorbed: float) -> DataFrame:
    """(hub, node, close, absorbed) of pairs(hub, node) of sets, by their registers."""
    end = lambda k, c: sets.select(F.col("node").alias(k), F.col("n").alias(f"{c}_size"), F.col("registers").alias(f"{c}_registers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                a, b = (np.frombuffer(b"".join(part.column(f"{c}_registers").to_pylist()), np.uint16).reshape(-1, M) for c in "ab")
                n_a, n_b = (part.column(f"{c}_size").to_numpy() for c in "ab")
                hit = [pa.array(at_least(t, a, b, n_a, n_b)) for t in (close, absorbed)]
                yield pa.RecordBatch.from_arrays([part.column("hub"), part.column("node"), *hit], names=["hub", "node", "close", "absorbed"])

    return mapped(pairs.join(end("hub", "a"), "hub").join(end("node", "b"), "node"), run, "hub long, node long, close boolean, absorbed boolean")


def candidates(sets: DataFrame, similarity: float, limit: int = 1024, rounds: int = 1, close: float = 0.55, absorbed: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(edges, buckets): candidate edges(a, b) whose classes hold all that is likely to be linked, and the buckets they come from
    as (group, node, n).

    In each round the sets of a bucket are compared with its smallest node alone, its hub; as buckets of near copies have few
    hubs between them, a pair is compared once for all its buckets. What is `close` to the hub gets an edge to it. A set that
    is `absorbed` (so similar that its Jaccard distance, a metric, is under 0.16 for all but chance) can link only to sets
    that are under 0.36 from the hub, which have their edge, so nothing in this bucket needs to see it again. What is left
    after the rounds is compared with each other: groups of up to `limit` in a task, larger ones in pairs of blocks.
    """
    spark = sets.sparkSession
    shared = stored(buckets(sets).groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "sketch-shared")
    passed = sieve(shared.select(F.col("bucket").alias("hash")), max(1, shared.count()), each=64, at_once=True)
    sent = spark.sparkContext.broadcast(passed)
    rows = stored(buckets(sets, sent).join(shared, "bucket"), "sketch-buckets")
    discard(shared)
    edges, left = [], rows
    for k in range(rounds):
        seen = stored(_compared(left.where("node <> hub").select("hub", "node").distinct(), sets, close, absorbed), f"sketch-hubs-{k}")
        edges.append(seen.where("close").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rest = left.join(seen.where("not absorbed").select("hub", "node"), ["hub", "node"]).select("bucket", "node")
        left = stored(rest.join(rest.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "bucket"), f"sketch-rest-{k}")
    alike = left.where(F.col("n") <= limit).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    groups = alike.select(F.xxhash64("nodes").alias("group"), F.explode("nodes").alias("node"))
    edges.append(_likely(_members(groups, sets, "n", "registers"), similarity))
    large = left.where(F.col("n") > limit)
    if not large.isEmpty():
        edges.append(_likely(_members(_blocks(large, ["bucket"], "n", limit), sets, "n", "registers"), similarity))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out, rows.select(F.col("bucket").alias("group"), "node", "n")


def _full_sets(docs: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """(node, elements) of nodes(node, digest, first): each set made again from one of its texts. A sieve over doc_ids picks
    these where they lie; the digest decides."""
    spark = docs.sparkSession
    number = lambda c: F.xxhash64(F.col(c), F.lit("doc")).alias("hash")
    sent = spark.sparkContext.broadcast(sieve(nodes.select(number("first")), max(1, total), at_once=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            at = sent.value.passed(batch.column(0).to_numpy().view(np.uint64))
            digests, held = [], []
            for text in batch.column(1).take(pa.array(at)).to_pylist():
                s = shingles(text).tobytes()
                digest = xxhash.xxh3_128_hexdigest(s)
                if s and digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    held.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(held, pa.binary())], names=["digest", "elements"])

    made = mapped(docs.select(number("doc_id"), "text"), run, "digest string, elements binary")
    return made.join(nodes.select("node", "digest"), "digest").select("node", "elements").dropDuplicates(["node"])


def _confirmed(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) in groups(members array of node, elements): each node b that is linked to a smaller one, with the smallest node a
    that it reaches over confirmed links in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                members = row.values
                nodes = members.field("node").to_numpy()
                order = np.argsort(nodes)  # smallest first, so a tree's first member is its least
                elements = members.field("elements")
                sets = [np.frombuffer(elements[int(k)].as_py(), np.uint64) for k in order]
                least: dict[int, int] = {}
                for i, j in set_links(sets, percent):
                    least[j] = least.get(i, i)
                    a.append(nodes[order[least[j]]])
                    b.append(nodes[order[j]])
            yield _pairs(a, b)

    return mapped(groups.select("members"), run, "a long, b long")


def roots(docs: DataFrame, sets: DataFrame, percent: int = 80, limit: int = 1024, elements: int = 1 << 22) -> DataFrame:
    """(node, root) for the distinct sets(node, digest, first, n, registers) of docs that are linked to a smaller node: root is
    the smallest node that confirmed links reach.

    Candidates are taken down to 0.12 below the threshold (over four standard deviations of the estimate). Their classes are
    confirmed in one task each where they have up to 4 * `limit` sets and `elements` shingles; in larger ones each bucket is
    confirmed by itself, in pairs of blocks where it is over `limit`, and the links are put together.
    """
    likely, groups = candidates(sets, percent / 100 - 0.12, limit)
    known = stored(components(likely, "sketch-likely").join(sets.select("node", "digest", "first", "n"), "node"), "sketch-classes")
    full = stored(_full_sets(docs, known, known.count()), "sketch-sets")
    sizes = known.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    large = stored(sizes.where((F.col("members") > 4 * limit) | (F.col("total") > elements)).select("root"), "sketch-large")
    whole = known.join(large, "root", "left_anti").select(F.col("root").alias("group"), "node")
    found = _confirmed(_members(whole, full, "elements"), percent).select(F.col("b").alias("node"), F.col("a").alias("root"))
    if not large.isEmpty():
        nodes = known.join(large, "root", "left_semi").select("node")
        own = groups.join(nodes, "node", "left_semi")
        small = own.where(F.col("n") <= limit).select("group", "node")
        blocks = _blocks(own.where(F.col("n") > limit), ["group"], "n", limit)
        edges = _confirmed(_members(small, full, "elements"), percent).unionByName(_confirmed(_members(blocks, full, "elements"), percent))
        found = found.unionByName(components(edges, "sketch-links"))
    return stored(found, "sketch-roots")


def near_duplicates(docs: DataFrame, percent: int = 80, limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links between sets with
    100 * intersection >= percent * union, itself included), kept (doc_id = component_id).

    Null and empty texts, and texts without words, have an empty set and link with nothing, each other included. Rows that
    repeat a set are one class. A null doc_id is never the smallest while its class has another; a class of nulls alone has
    a null component_id, and its rows count as kept. No other column is looked at. Shingles are compared by 64-bit hashes.
    """
    prints = stored(sketched(docs), "sketch-prints")
    values = prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.max("n_shingles").alias("n"), F.max("registers").alias("registers"))
    sets = stored(values.withColumn("node", F.monotonically_increasing_id()), "sketch-values")
    linked = roots(docs, sets, percent, limit).withColumnRenamed("root", "_root")
    classed = sets.select("node", "digest", "first", "rows").join(linked, "node", "left").select("digest", "first", "rows", F.coalesce("_root", "node").alias("root"))
    smallest = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(classed.join(smallest, "root").select("digest", "component_id", "rows"), "sketch-result")
    often = classes.where(F.col("rows") > max(1.0, prints.count() / FREQUENT)).drop("rows")
    out = spread_join(prints.drop("registers"), classes.drop("rows"), "digest", often)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
