"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, discard, mapped, sieve, stored, without

#: Tokens of a window, its blocks, and the substitutions that are tolerated in it.
WINDOW, BLOCKS, SUBSTITUTIONS = 12, 4, 2
#: Each mask keeps two blocks of a window and ignores the two others, so whichever two tokens differ, a mask ignores both.
MASKS = tuple(itertools.combinations(range(BLOCKS), BLOCKS - SUBSTITUTIONS))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, end to end, and where each text's tokens start (one entry more).

    Tokens are runs of ASCII letters, digits and all non-ASCII characters of the lower-cased text.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    powers = np.ones(len(data), np.uint64)
    powers[1:] = _ODD
    powers = np.cumprod(powers)
    inverse = np.ones(len(data), np.uint64)
    inverse[1:] = _INVERSE
    inverse = np.cumprod(inverse)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    hashes = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)])


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """For each mask: the seed hash of the window at each position (none if there are fewer tokens than a window)."""
    step = WINDOW // BLOCKS
    n = len(h) - WINDOW + 1
    if n <= 0:
        return [np.empty(0, np.uint64) for _ in MASKS]
    block = np.zeros(len(h) - step + 1, np.uint64)
    for k in range(step):
        block = (block + h[k : k + len(block)]) * _ODD
    block ^= block >> np.uint64(29)
    return [_mix(sum((block[b * step : b * step + n] * np.uint64(2 * i + 3) for i, b in enumerate(mask)), np.full(n, k + 1, np.uint64))) for k, mask in enumerate(MASKS)]


def _whole(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n tokens at each position, for items shorter than a window."""
    m = len(h) - n + 1
    out = np.full(max(0, m), n, np.uint64)
    for k in range(n):
        out = (out + h[k : k + m]) * _ODD if m > 0 else out
    return _mix(out)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(mask, hash, window, item_id): each distinct window of the benchmark under each mask, with each item that has it.
    window: its token hashes as bytes. An item of n tokens, fewer than a window, is one window of its own under mask -n;
    null texts and texts without a token have none."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, _ = tokens([text or ""])
                found = [(k, s) for k, s in enumerate(seeds(h))] if len(h) >= WINDOW else [(-len(h), _whole(h, len(h)))] if len(h) else []
                for k, s in found:
                    size = WINDOW if k >= 0 else -k
                    for at in range(len(s)):
                        for column, value in zip(out, (k, int(s[at].view(np.int64)), h[at : at + size].tobytes(), item), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), batch.column(0).type), strict=True)], names=["mask", "hash", "window", "item_id"])

    kind = benchmark.select("item_id").schema[0].dataType.simpleString()
    return mapped(benchmark.select("item_id", "text"), run, f"mask int, hash long, window binary, item_id {kind}").distinct()


def _matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, start, length, window): the verified windows of documents, once for each distinct window of the benchmark
    that they match; (window, item_id): each item that has a window; and the stored tables that both read.

    Windows that some mask maps to a benchmark hash pass a bitmap of bounded size, are joined on (mask, hash), and the
    joined windows are compared token by token. Items (ids of any type) join only afterwards, so one window of many items is compared once.
    """
    held_by = stored(benchmark_windows(benchmark), "decontaminate-items")
    members = held_by.select("window", "item_id").distinct()
    windows = stored(held_by.select("mask", "hash", "window").distinct(), "decontaminate-windows")
    shape = windows.groupBy("mask").agg(F.count("*").alias("n")).collect()
    short = sorted(-r["mask"] for r in shape if r["mask"] < 0)
    held = docs.sparkSession.sparkContext.broadcast(sieve(windows.select("hash"), sum(r["n"] for r in shape)))
    kind = docs.select("doc_id").schema[0].dataType

    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                h, starts = tokens(texts)
                doc, mask, code, at, window = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
                for k, size, s in [(k, WINDOW, s) for k, s in enumerate(seeds(h))] + [(-n, n, _whole(h, n)) for n in short]:
                    p = held.value.passed(s)
                    owner = np.searchsorted(starts, p, "right") - 1
                    p, owner = (x[p + size <= starts[owner + 1]] for x in (p, owner))
                    doc.append(owner)
                    mask.append(np.full(len(p), k, np.int32))
                    code.append(s[p])
                    at.append(p - starts[owner])
                    window.extend(h[i : i + size].tobytes() for i in p.tolist())
                owners = pa.array(np.concatenate(doc) + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owners), pa.array(np.concatenate(mask)), pa.array(np.concatenate(code).view(np.int64)), pa.array(np.concatenate(at)), pa.array(window, pa.binary())], names=["doc_id", "mask", "hash", "start", "seen"])

    candidates = mapped(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), run, f"doc_id {kind.simpleString()}, mask int, hash long, start long, seen binary")
    size = F.octet_length("window") / 8
    differ = F.expr("aggregate(sequence(0, cast(octet_length(window) / 8 as int) - 1), 0, (n, i) -> n + if(substr(window, 8 * i + 1, 8) = substr(seen, 8 * i + 1, 8), 0, 1))")
    joined = candidates.join(windows, ["mask", "hash"]).where(F.octet_length("window") == F.octet_length("seen"))
    near = joined.where(differ <= F.when(F.col("mask") < 0, 0).otherwise(SUBSTITUTIONS))
    return near.select("doc_id", "start", size.cast("int").alias("length"), "window").distinct(), members, [held_by, windows]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, length): each verified window of a document: `length` tokens from token `start` on that
    differ from a window of the item in at most SUBSTITUTIONS tokens (items shorter than a window: in none).

    A window that matches several items has a row for each. Null and empty texts have no window. Repeated rows give one
    set of hits.
    """
    found, members, _ = _matches(docs, benchmark)
    return found.join(members, "window").select("doc_id", "item_id", "start", "length").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with a verified overlap: doc_id, item_ids (sorted; all items that a window of it matches),
    n_windows, first_token and end_token of what is covered. Documents without one have no row."""
    found, members, steps = _matches(docs, benchmark)
    found = stored(found, "decontaminate-matches")
    discard(steps[1])
    kind = members.schema["item_id"].dataType
    nothing = F.lit(None)
    places = found.select("doc_id", "start", "length").distinct().withColumn("item_id", nothing.cast(kind))
    items = found.select("doc_id", "window").distinct().join(members, "window").select("doc_id", nothing.cast("long").alias("start"), nothing.cast("int").alias("length"), "item_id")
    return places.unionByName(items).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("start").alias("n_windows"), F.min("start").alias("first_token"), F.max(F.col("start") + F.col("length")).alias("end_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has a verified overlap with the benchmark; all columns and other rows stay."""
    found, _, steps = _matches(docs, benchmark)
    clean = without(docs, found.select("doc_id"))
    for step in steps:
        discard(step)
    return clean
