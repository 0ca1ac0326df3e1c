"""Groups of spelling variants: words one edit apart, found with a positional q-gram inverted index and a count filter."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, mapped, stored

LEAST = 7


def words(docs: DataFrame, least: int = LEAST, one_in: int = 31, occurrences: int = 2) -> DataFrame:
    """(word, n): the maximal runs of Latin letters of all whole texts, A-Z lower-cased, of at least `least` code points, with
    how often they occur, if that is at least `occurrences`.

    A misspelling is made of some: where `one_in` divides h, the unsigned crc32 of `doc_id:run`, the run loses its code point
    h modulo its length. A null doc_id is the empty text here; null and empty texts have no words. Counts are added up in
    tasks before they are shuffled, so frequent words are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(found(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > 200_000:
                    yield flush()
        if total:
            yield flush()

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(given, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def spans(size: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """Where a bucket's common parts end: how many leading and trailing code points its words share, and the stretches that
    its pairs must not share, as pairs that do belong to the bucket beside it.

    A bucket is for words of `size` or size + 1 code points. Each step of the path halves what may still differ: of two words
    an edit apart either the first half is the same (L), or else what is behind it (R)."""
    head, tail, differing = 0, 0, []
    for side in path:
        half = (size - head - tail) // 2
        if side == "L":
            head += half
        else:
            differing.append((head, head + half))
            tail = size - head - half
    return head, tail, differing


def key(word: str, size: int, path: str) -> str:
    head, tail, _ = spans(size, path)
    return f"{size}{path} {word[:head]} {word[len(word) - tail :]}"


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_pairs(members: list[str], size: int, path: str, q: int = 2) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket's words that are one edit apart and belong to this bucket.

    What the bucket's words do not share is cut into q-grams, its ends marked; the index has a posting list for each gram and
    position. A word's lists, those of its grams at positions at most one off, are merged in order: an edit spoils at most q
    grams of the longer word, so only words met often enough are looked at. The index holds the words before it, shorter
    ones first, so each pair comes once and lengths fit."""
    head, tail, differing = spans(size, path)
    order = sorted(range(len(members)), key=lambda i: (len(members[i]), members[i]))
    index: dict[tuple[str, int], list[int]] = {}
    short = sum(len(w) == size for w in members)  # two of the longer length meet in the buckets of that size
    for nth, at in enumerate(order):
        word = members[at]
        rest = "\0" * (q - 1) + word[head : len(word) - tail] + "\1" * (q - 1)
        grams = [rest[p : p + q] for p in range(len(rest) - q + 1)]
        least = len(grams) - q
        if least > 0:
            lists = [index[g, p + d] for p, g in enumerate(grams) for d in (-1, 0, 1) if (g, p + d) in index]
            met = (x for x, same in groupby(merge(*lists)) if sum(1 for _ in same) >= least)
        else:
            met = iter(range(min(nth, short)))
        for x in met:
            other = members[order[x]]
            if one_edit(word, other) and all(word[a:b] != other[a:b] for a, b in differing):
                yield at, order[x]
        if len(word) == size:
            for p, g in enumerate(grams):
                index.setdefault((g, p), []).append(nth)


def _dealt(rows: DataFrame, first: bool) -> DataFrame:
    """(bucket, word, n): words to their first buckets, or those of a large bucket to the two inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, which = [], []
            held = [None] * batch.num_rows if first else batch.column("bucket").to_pylist()
            for i, (word, bucket) in enumerate(zip(batch.column("word").to_pylist(), held, strict=True)):
                if first:
                    into = [(size, "") for size in (len(word), len(word) - 1)]
                else:
                    size, path = re.match(r"(\d+)([LR]*)", bucket).groups()
                    into = [(int(size), path)]
                out += [key(word, size, path + side) for size, path in into for side in "LR"]
                which += [i] * 2 * len(into)
            took = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("word").take(took), batch.column("n").take(took)], names=["bucket", "word", "n"])

    return mapped(rows, run, "bucket string, word string, n long")


def _linked(rows: DataFrame) -> DataFrame:
    """(word, other, n of the other) both ways for each near pair in whole buckets of rows(bucket, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, counts = [], [], []
            for bucket, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, path = re.match(r"(\d+)([LR]*)", bucket).groups()
                held = [m["word"] for m in members]
                for i, j in near_pairs(held, int(size), path):
                    a += [held[i], held[j]]
                    b += [held[j], held[i]]
                    counts += [members[j]["n"], members[i]["n"]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(counts, pa.int64())], names=["word", "other", "n"])

    grouped = rows.groupBy("bucket").agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)
    return mapped(grouped, run, "word string, other string, n long")


def near_words(vocabulary: DataFrame, bucket: int = 1024) -> DataFrame:
    """(word, other, n) for all pairs of vocabulary(word, n) that are one edit apart, both ways; n is the other's.

    Words of one length and the next meet where they share their first or their last half; a bucket of over `bucket` words is
    halved again, until what may differ is one code point, which bounds the bucket by the letters there are. So no bucket
    grows with the vocabulary and no word is left out."""
    rows, found, step = _dealt(vocabulary.select("word", "n"), True), None, 0
    while rows is not None:
        held = stored(rows, f"spelling-buckets-{step}")
        undecided = F.regexp_extract("bucket", r"^(\d+)", 1).cast("int") - F.length(F.regexp_replace("bucket", r"^\d+[LR]+| ", "")) > 1
        big = stored(held.groupBy("bucket").agg(F.count("*").alias("rows")).where((F.col("rows") > bucket) & undecided).select("bucket"), f"spelling-large-{step}")
        none = big.isEmpty()
        small = _linked(held if none else held.join(big, "bucket", "left_anti"))
        found = small if found is None else found.unionByName(small)
        rows, step = None if none else _dealt(held.join(big, "bucket", "left_semi"), False), step + 1
    return found


def variants(docs: DataFrame, least: int = LEAST, one_in: int = 31, ratio: int = 10, bucket: int = 1024) -> DataFrame:
    """One row for each word (see words()): word, form, root, n, n_near, form_n.

    n_near counts the words that are one edit apart from it. form is the most frequent of them, of equals the first in the
    order of code points, if it is at least `ratio` times as frequent, else null (as form_n, its count). root is where the
    forms end, the word itself if it has none. No other column of docs is looked at; an empty table gives an empty one.
    """
    vocabulary = stored(words(docs, least, one_in), "spelling-words")
    best = near_words(vocabulary, bucket).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("other"))).alias("best"))
    has = -F.col("best.m") >= ratio * F.col("n")
    told = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    told = stored(told, "spelling-forms")
    roots = _roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, root) one step each: every round follows twice as many; counts rise tenfold with each step, so
    there are at most 19 of them."""
    now = stored(links, "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        after = stored(now.join(on, now.root == on._at, "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after.select("word", "root")
        now.stored_at = after.stored_at
        if after.where("moved").isEmpty():
            return now
