"""Exact removal of repeated byte strings: sampled suffixes, sorted by bucket-pointer refinement.

A string of `length` bytes counts as repeated where it also starts earlier. Every window of that length is represented
by one q-gram in it (its anchor: the leftmost of least hash), so equal windows have equal anchors and only windows whose
anchor's q-gram occurs twice can repeat. Their surroundings are dealt out by that q-gram - the initial buckets - and in
each bucket the suffixes are refined to the full length by sorting on the bucket numbers of later offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, mapped, stored

Q = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_INDEX_BITS = 24
#: Windows that are looked at together; longer texts are taken in such parts, which overlap by a window.
_PART = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's q-gram, anchor, first window, number of windows) of each run of windows with one anchor;
    windows start where valid is true."""
    n = len(data)
    w = length - Q + 1
    if n < length:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    power, inverse = _powers(_ODD, n), _powers(_INVERSE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = (total[Q:] - total[:-Q]) * inverse[: n - Q + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    starts = np.flatnonzero(valid[: len(at)])
    if not len(starts):
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    own = at[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return h[own[first]], own[first], starts[first], np.diff(np.concatenate([first, [len(starts)]]))


def parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, valid window starts, text number of each byte run's start, ...) of runs of texts, long texts in parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made():
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        edge = np.concatenate([[0], np.cumsum([len(b) for _, _, b in held])]).astype(np.int64)
        valid = np.ones(len(data), bool)
        for k in range(1, length):
            cut = edge[1:] - k
            valid[cut[cut >= edge[:-1]]] = False
        return data, valid, edge, np.array([(d, o) for d, o, _ in held], np.int64).reshape(-1, 2)

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _PART):
            piece = t[at : at + _PART + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > 2 * _PART:
                yield made()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield made()


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, known, doc, twin, run): the runs of windows of each document. run holds the byte of the first window, above 16
    bits of the anchor's distance from it and the number of windows, 8 bits each. Runs whose q-gram this task has met before
    are known to be shared and need no look at other tasks; one of each such q-gram still tells the others."""

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            doc, twin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for data, valid, edge, source in parts(texts, length):
                h, anchor, first, n = anchors(data, valid, length)
                if not len(h):
                    continue
                piece = np.searchsorted(edge, first, "right") - 1
                values, index, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                shared = values[count > 1].tolist()
                before = np.array([v in met for v in shared], bool) if shared else np.empty(0, bool)
                old = np.zeros(len(values), bool)
                old[count > 1] = before
                if len(met) > 500_000:
                    met.clear()
                met.update(shared)
                tells = np.zeros(len(h), bool)
                tells[index] = True
                known = np.where(count[inverse] > 1, np.where(tells & ~old[inverse], 1, 2), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(known), pa.array(doc[source[piece, 0]]), pa.array(twin[source[piece, 0]]), pa.array(source[piece, 1] + first - edge[piece] << 16 | anchor - first << 8 | n)], names=["h", "known", "doc", "twin", "run"])

    return mapped(docs, run, "h long, known int, doc long, twin long, run long")


def _shared_runs(rows: DataFrame) -> DataFrame:
    """The rows whose q-gram occurs at least twice; known: 0 not yet, 1 shared and to be told, 2 shared. Each task reads its
    rows in the order of their q-grams and holds one batch."""

    def run(batches):
        names = ["h", "doc", "twin", "run"]
        pending, prior = None, None  # the row held back as the next batch decides it; the h before it
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch] if pending is None else [pending, batch]).combine_chunks()
            h, known = part.column("h").to_numpy(), part.column("known").to_numpy()
            twice = np.zeros(len(h), bool)
            twice[1:] = h[1:] == h[:-1]
            twice[:-1] |= twice[1:]
            twice[0] |= prior is not None and prior == h[0]
            keep = (twice | (known > 0))[:-1]
            prior = h[-2] if len(h) > 1 else prior
            pending = part.slice(len(h) - 1).to_batches()[0]
            if keep.any():
                yield from part.slice(0, len(keep)).filter(pa.array(keep)).select(names).to_batches()
        if pending is not None and (pending.column(1)[0].as_py() > 0 or prior == pending.column(0)[0].as_py()):
            yield pending.select(names)

    dealt = rows.repartition(F.when(F.col("known") == 2, F.xxhash64("doc", "run")).otherwise(F.col("h"))).sortWithinPartitions("h")
    return mapped(dealt, run, "h long, doc long, twin long, run long")


def _contexts(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(h, doc, twin, run, context): the bytes that the windows of each shared run cover. A run with the same bytes as an
    earlier one of its task repeats whole, whatever else there is; it comes without bytes."""
    lists = runs.groupBy("doc", "twin").agg(F.sort_array(F.collect_list(F.struct("run", "h"))).alias("runs"))
    joined = docs.join(lists.hint("merge"), ["doc", "twin"]).select("doc", "twin", "text", "runs")

    def run(batches):
        met: dict[bytes, tuple] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, twin, text, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for packed, h in zip(*(rows.values.field(i).to_pylist() for i in range(2)), strict=True):
                    at = packed >> 16
                    context = data[at : at + (packed & 255) + length - 1]
                    me = (doc, twin, at)
                    if met.setdefault(context, me) < me:
                        context = None
                    else:
                        met[context] = me
                    for column, value in zip(out, (h, doc, twin, packed, context), strict=True):
                        column.append(value)
                if len(met) > 200_000:
                    met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "doc", "twin", "run", "context"])

    return mapped(joined, run, "h long, doc long, twin long, run long, context binary")


def again(group: np.ndarray, run: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window within it, whether the window occurs in an earlier one) for all windows of contexts given in
    document order. Windows can only be equal in one bucket (group) and at one distance from its anchor, so each is named
    by the bucket of what it has before the anchor and of what follows; equal names are equal windows. At most 8192
    contexts and 2**20 windows: their numbers are packed into 13 and 20 bits."""
    n, lead = run & 255, run >> 8 & 255
    k = len(n)
    end = begin + n + length - 1
    anchor = begin + lead
    reach = length - Q
    after = _aligned(data, anchor[:, None] + np.arange(-(-length // 8) * 8), begin, end)
    before = _aligned(data, anchor[:, None] - 1 - np.arange(-(-reach // 8) * 8), begin, end)
    owner = np.repeat(np.arange(k), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    distance = lead[owner] - within
    right, left = _classes(after, group), _classes(before, group)
    name = distance << 26 | left(distance)[distance, owner] << 13 | right(length - distance)[length - distance, owner]
    name = name << 20 | np.arange(len(owner))
    name.sort()
    repeat = np.zeros(len(owner), bool)
    repeat[name[1:][name[1:] >> 20 == name[:-1] >> 20] & (1 << 20) - 1] = True
    return owner, within, repeat


def _aligned(data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes at the positions, 0 outside the row's context."""
    outside = (at < begin[:, None]) | (at >= end[:, None])
    out = data[np.clip(at, 0, len(data) - 1)]
    out[outside] = 0
    return out


def _classes(rows: np.ndarray, group: np.ndarray):
    """A function of depths that gives a table (depth, row): a number equal for rows of one group with `depth` equal first
    bytes. From the order of the rows by bucket-pointer refinement and the lengths that neighbours share."""
    order = refine(rows, group)
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[group[order][1:] != group[order][:-1]] = -1

    def table(depths: np.ndarray) -> np.ndarray:
        out = np.zeros((int(depths.max()) + 1, len(order)), np.int64)
        for depth in np.unique(depths).tolist():
            out[depth, order[1:]] = np.cumsum(common < depth)
        return out

    return table


def refine(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The rows (of a multiple of 8 bytes each) in order of group, then bytes: bucket-pointer refinement.

    The 8-byte grams at each offset are put into buckets, each numbered by where it begins in their order. Then buckets
    are refined by sorting on their own number and the number of the bucket at the offset behind, which gives numbers for
    grams of twice the length; these are used in turn, until one number orders the whole rows, and last by the group.
    """
    k = len(rows)
    index = np.arange(k)

    def begins(ranked: np.ndarray, order: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        out = np.empty(k, np.int64)
        out[order] = np.maximum.accumulate(np.where(new, index, 0))
        return out

    def joined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
        both = (first << 13 | later) << 13 | index
        both.sort()
        return begins(both >> 13, both & 8191)

    grams = np.ascontiguousarray(rows).view(">u8").astype(np.uint64).T
    pointers = []
    for column in grams:
        order = np.argsort(column)
        pointers.append(begins(column[order], order))
    while len(pointers) > 1:
        pairs = [joined(a, b) for a, b in zip(pointers[::2], pointers[1::2], strict=False)]
        pointers = pairs + pointers[len(pairs) * 2 :]
    both = (group << 13 | pointers[0]) << 13 | index
    both.sort()
    return both & 8191


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """The contexts of buckets too large for one task, in buckets refined by more bytes on one side of the anchor.

    In a bucket, windows at distances lo to hi from their anchor are equal in what all of them hold: lo bytes before it and
    length - hi behind its start. The upper half of the distances holds more bytes before it, the lower half more behind
    it; each half of a context becomes a context of its own in the bucket of those bytes. Halving ends at one distance,
    where the bytes are the whole window. A context with the bytes of an earlier one of its task comes without bytes.
    """

    def run(batches):
        met: dict[bytes, tuple] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for h, doc, twin, packed, context, reach in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                at, lead, n, lo, hi = packed >> 16, packed >> 8 & 255, packed & 255, reach >> 8, reach & 255
                middle = (lo + hi + 1) // 2
                skip = max(0, lead - middle + 1)  # windows of the upper half
                halves = []
                if skip:
                    halves.append((0, min(n, skip), context[lead - middle : lead], middle << 8 | hi))
                if skip < n:
                    halves.append((skip, n - skip, context[lead : lead + length - middle + 1], lo << 8 | middle - 1))
                for first, count, more, span in halves:
                    part = context[first : first + count + length - 1]
                    me = (doc, twin, at + first)
                    if met.setdefault(part, me) < me:
                        part = None
                    else:
                        met[part] = me
                    bucket = xxhash.xxh64_intdigest(more, h & (1 << 64) - 1 ^ span) - (1 << 63)
                    for column, value in zip(out, (bucket, doc, twin, at + first << 16 | lead - first << 8 | count, part, span), strict=True):
                        column.append(value)
                if len(met) > 200_000:
                    met.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["h", "doc", "twin", "run", "context", "reach"])

    return mapped(contexts, run, "h long, doc long, twin long, run long, context binary, reach int")


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, twin, at, n): runs of windows that also start earlier, among contexts dealt out by h; at most 4096 of one h but
    where its windows have one distance. Without `reach` all distances are open. A task reads its buckets in order and
    holds about 20,000 contexts at once."""

    def found(table: pa.Table):
        h = table.column("h").to_numpy()
        ends = np.flatnonzero(np.concatenate([h[1:] != h[:-1], [True]])) + 1  # of buckets
        columns = [table.column(c).to_numpy() for c in ("doc", "twin", "run")]
        texts = table.column("context").combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        upto = np.concatenate([[0], np.cumsum(columns[2] & 255)])  # windows of the contexts before each
        first = 0
        while first < len(h):  # whole buckets, of which each alone is within the bounds
            most = min(np.searchsorted(ends, first + 8192, "right"), np.searchsorted(upto[ends], upto[first] + (1 << 20), "right")) - 1
            last = int(ends[max(most, np.searchsorted(ends, first, "right"))])
            rows = np.arange(first, last)
            group = np.cumsum(np.concatenate([[0], h[first + 1 : last] != h[first : last - 1]])).astype(np.int64)
            doc, twin, packed = (c[rows] for c in columns)
            order = np.lexsort((packed, twin, doc))
            rows, group, doc, twin, packed = rows[order], group[order], doc[order], twin[order], packed[order]
            first = last
            owner, within, repeat = again(group, packed, data, offsets[rows], length)
            hit = np.flatnonzero(repeat)
            if not len(hit):
                continue
            head = np.flatnonzero(np.concatenate([[True], (owner[hit][1:] != owner[hit][:-1]) | (hit[1:] != hit[:-1] + 1)]))
            mine = hit[head]
            count = np.diff(np.concatenate([head, [len(hit)]])).astype(np.int32)
            yield _runs(doc[owner[mine]], twin[owner[mine]], (packed[owner[mine]] >> 16) + within[mine], count)

    def run(batches):
        kept: list[pa.RecordBatch] = []
        whole: tuple[int, set[bytes]] = (0, set())
        for batch in batches:
            reach = batch.column("reach").to_numpy()
            full = reach >> 8 == reach & 255
            if full.any():  # single windows in document order: the first of each is no repeat
                single = batch.filter(pa.array(full))
                repeat = []
                for h, context in zip(single.column("h").to_pylist(), single.column("context").to_pylist(), strict=True):
                    whole = whole if whole[0] == h else (h, set())
                    repeat.append(context in whole[1])
                    whole[1].add(context)
                single = single.filter(pa.array(repeat, pa.bool_()))
                doc, twin, packed = (single.column(c).to_numpy() for c in ("doc", "twin", "run"))
                yield _runs(doc, twin, packed >> 16, (packed & 255).astype(np.int32))
                batch = batch.filter(pa.array(~full))
            if not batch.num_rows:
                continue
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= 16_384:
                table = pa.Table.from_batches(kept).combine_chunks()
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
                yield from found(table.slice(0, cut)) if cut else ()
                kept = table.slice(cut).to_batches()
        if kept:
            yield from found(pa.Table.from_batches(kept).combine_chunks())

    if "reach" not in contexts.columns:
        contexts = contexts.withColumn("reach", F.lit(length - Q))
    dealt = contexts.repartition(F.col("h")).sortWithinPartitions("h", "doc", "twin", "run")
    return mapped(dealt, run, _RUNS)


_RUNS = "doc long, twin long, at long, n int"


def _runs(doc: np.ndarray, twin: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(twin), pa.array(at), pa.array(n)], names=["doc", "twin", "at", "n"])


def repeated_runs(docs: DataFrame, length: int = 100, bucket: int = 4096) -> DataFrame:
    """(doc, twin, at, n): the windows of `length` bytes, n in a row from byte `at` on, that also start earlier.

    docs(doc, twin, text) with unique (doc, twin), which is the order of documents. Buckets of more than `bucket` (at most
    4096) different surroundings are refined by more and more bytes around the anchor until they are small or hold one
    window each; a step halves the distances, so there are at most eight. Keys of buckets only deal out, bytes decide.
    """
    if not Q <= length <= Q + 200 or bucket > 4096:
        raise ValueError("length must be 24 to 224 and bucket at most 4096")
    shared = stored(_shared_runs(_anchor_rows(docs, length)), "suffix-shared")
    contexts = stored(_contexts(docs, shared, length).withColumn("reach", F.lit(length - Q)), "suffix-contexts")
    discard(shared)
    steps, found = [contexts], []
    while True:
        now = steps[-1]
        found.append(now.where("context is null").select("doc", "twin", F.shiftright("run", 16).alias("at"), F.col("run").bitwiseAND(255).cast("int").alias("n")))
        now = now.where("context is not null")
        hot = now.where("shiftright(reach, 8) < (reach & 255)").groupBy("h").agg(F.count("*").alias("_n")).where(F.col("_n") > bucket).select("h")
        hot = stored(hot, "suffix-hot")
        n_hot = hot.limit(100_001).count()
        if not n_hot:
            found.append(_repeats(now, length))
            discard(hot)
            break
        few = F.broadcast(hot) if n_hot <= 100_000 else hot
        found.append(_repeats(now.join(few, "h", "left_anti"), length))
        steps += [hot, stored(_split(now.join(few, "h", "left_semi").select(*now.columns), length), "suffix-split")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    runs = stored(every, "suffix-runs")
    for step in steps:
        discard(step)
    return runs


def deduplicate(docs: DataFrame, length: int = 100, bucket: int = 4096) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left) and
    spans (array of start and end bytes of what is removed).

    Each byte covered by a `length`-byte string that also starts earlier is removed: earlier in the same text, or in one
    with a smaller doc_id. Strings are judged on the input, and matches never cross documents. Null counts as empty;
    texts shorter than `length` stay whole. A null doc_id comes before all others. Of rows with one doc_id, equal texts
    are one document (each keeps the same), different texts are ordered by a hash of theirs.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    again = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    twin = F.xxhash64(text) if again else F.lit(0).cast("long")
    keyed = docs.select(doc.alias("doc"), twin.alias("twin"), text.alias("text"), "doc_id")
    long_ = keyed.where(F.octet_length("text") >= length).select("doc", "twin", "text")
    runs = repeated_runs(long_.dropDuplicates(["doc", "twin"]) if again else long_, length, bucket)
    lists = runs.groupBy("doc", "twin").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    spans_type = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            size, removed, count, kept, spans = [], [], [], [], []
            for text, rows in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                if rows.is_valid:
                    for a, n in zip(*(rows.values.field(i).to_pylist() for i in range(2)), strict=True):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], a + n + length - 1)
                        else:
                            merged.append([a, a + n + length - 1])
                left, at = [], 0
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                size.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                count.append(len(merged))
                kept.append(b"".join(left))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = keyed.join(lists, ["doc", "twin"], "left").select("doc_id", "text", "runs")
    return mapped(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: bigint, end: bigint>>")
