"""Best-fit packing of tokenized documents into sequences: minimum bin slack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import encoder
from plumbline.llm.common import mapped, stored, unused


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids) for each piece of each document: the text's ids, then end_id.

    A null or empty text is the end id alone. Longer documents are cut from their end into pieces of exactly `capacity`
    tokens; the first piece may be shorter. ids: the piece's ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches):
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(encode(text or "") + [end_id], "<u4")
                first = len(ids) % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids) + 1, capacity)], strict=True)):
                    for column, value in zip(out, (doc, k, a, b - a, ids[a:b].tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def fullest(counts: np.ndarray, capacity: int, slack: int = 0) -> list[tuple[int, int]]:
    """(length, copies) of a combination of available lengths, the longest among them, whose sum is at most `slack` below the
    largest that fits; of these the one with the longest pieces, so that short ones are left for the gaps of others.

    Subset sums are bits of one integer, of the short lengths first; each length joins in shares of 1, 2, 4 ... copies, so no
    sum needs more copies than there are. From the longest share down, a share is taken if a wanted sum is still within
    reach of those below it.
    """
    longest = int(np.flatnonzero(counts)[-1])
    room = capacity - longest
    full = (1 << room + 1) - 1
    left = counts[: room + 1].copy()
    if longest <= room:
        left[longest] -= 1
    sums, steps = 1, []
    for length in np.flatnonzero(left).tolist():
        copies, share = min(int(left[length]), room // length), 1
        while copies:
            share = min(share, copies)
            steps.append((length, share, sums))
            sums |= sums << length * share & full
            copies -= share
            share *= 2
    wanted = sums >> max(0, sums.bit_length() - 1 - slack) << max(0, sums.bit_length() - 1 - slack)
    chosen = {longest: 1}
    for length, share, before in reversed(steps):
        if within := wanted >> length * share & before:
            chosen[length] = chosen.get(length, 0) + share
            wanted = within
        else:
            wanted &= before
    return sorted(chosen.items(), reverse=True)


#: From none (the fullest sequence each time) to all (the longest piece that fits each time).
SLACKS = (0, 8, 1, 2, 32, 64, 1 << 20)


def plan(counts: dict[int, int], capacity: int, slacks: tuple[int, ...] = SLACKS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, end_rank, copies, first_sequence, offset): the pieces of a length with ranks from
    first_rank on go, `copies` to a sequence, into sequences from first_sequence on, at offset and behind each other.

    One row set per combination: what fills one sequence best is used as often as its lengths last, so the work depends
    on the number of lengths (at most `capacity`), not of pieces. The slack that a sequence may keep for the sake of longer
    pieces is tried in turn; the plan with fewest sequences stays, the first of equals, or at once one that has no more
    than the tokens need.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best, fewest = [], None
    for slack in slacks:
        rows, sequences = _plan(counts, capacity, slack)
        if fewest is None or sequences < fewest:
            best, fewest = rows, sequences
        if fewest == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, slack: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    while left.any():
        combination = fullest(left, capacity, slack)
        times = min(int(left[length]) // copies for length, copies in combination)
        offset = 0
        for length, copies in combination:
            rows.append((length, int(used[length]), int(used[length]) + copies * times, copies, sequence, offset))
            used[length] += copies * times
            left[length] -= copies * times
            offset += copies * length
        sequence += times
    return rows, sequence


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items(doc_id, piece, length and more) with sequence_id and offset: the place of each piece.

    Each length occurs in at most `capacity` counts, which is all that reaches the driver. A piece's rank among those of
    its length is its rank in a salted group plus the sizes of the groups before, so no length is ranked in one task;
    ties of repeated rows are broken by any order that the written table keeps. An empty table packs to an empty one.
    """
    columns = items.columns
    salt = unused(items, "salt")
    by = F.col(salt)
    # dealt out by where a piece lies, so that pieces which repeat a doc_id, or have none, do not meet in one group
    items = stored(items.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096)).cast("int")), "packing-pieces")
    groups = items.select("length", by.alias("salt")).groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, capacity)
    spark = items.sparkSession
    held = spark.sparkContext.broadcast({k: np.array(sorted(r[1:] for r in rows if r[0] == k), np.int64) for k in counts})
    # Sums of the groups before each, first of whole blocks of 64 groups, then within a block, so that no length is one window.
    blocks = groups.groupBy("length", F.shiftright("salt", 6).alias("block")).agg(F.sum("n").alias("n"))
    blocks = blocks.selectExpr("length", "block", "sum(n) over (partition by length order by block) - n as earlier")
    inner = groups.selectExpr("length", "salt", "shiftright(salt, 6) as block", "sum(n) over (partition by length, shiftright(salt, 6) order by salt) - n as nearer")
    before = inner.join(blocks, ["length", "block"]).select("length", "salt", (F.col("earlier") + F.col("nearer")).alias("ahead"))
    ranked = items.select(*columns, by.alias("_salt")).selectExpr("*", "row_number() over (partition by length, _salt order by doc_id, piece) - 1 as nth").withColumnRenamed("_salt", "salt")
    placed = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "salt")
    kept = T.StructType([*items.schema][: len(columns)])
    columns = [*columns, "sequence_id", "offset"]
    at = placed.columns.index("rank"), placed.columns.index("length")

    def run(batches):
        for batch in batches:
            rank, length = batch.column(at[0]).to_numpy(), batch.column(at[1]).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                mine = length == k
                table = held.value[int(k)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                nth, copies = rank[mine] - row[:, 0], row[:, 2]
                sequence[mine] = row[:, 3] + nth // copies
                offset[mine] = row[:, 4] + nth % copies * k
            got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([got[c] for c in columns], names=columns)

    return mapped(placed, run, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32 (unsigned, of the ids' bytes), sequence_id, offset.

    The ids themselves are not kept in the places' table; `pieces` gives them.
    """
    items = pieces(docs, tokenizer, ranks, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(items, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
