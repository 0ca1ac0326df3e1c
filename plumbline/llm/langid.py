"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, crc_mod, map_columns, mapped, unit_hash
from plumbline.llm.ngrams import hashed

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """log_p: a row for each language (in name order), a column for each hashed n-gram."""

    langs: list[str]
    log_p: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


def feature_bits(n_langs: int, bits: int, cells: int) -> int:
    """How many bits of hashed features the matrix has: `bits` while languages x features stay within `cells`, fewer with
    more languages, 8 at least."""
    while bits > 8 and n_langs << bits > cells:
        bits -= 1
    return bits


def train(docs: DataFrame, *, fold: int = 4, held_out: int = 2, per_lang: int = 4000, orders: tuple[int, ...] = (1, 2, 3, 4), bits: int = 16, cells: int = 1 << 26, alpha: float = 0.5) -> Model:
    """Learns from text and non-null lang of rows whose crc32(doc_id) modulo fold is not held_out.

    About per_lang rows of each language at most are read (chosen by a hash of doc_id; the bound of the sample). The matrix
    that is broadcast has at most `cells` numbers (256 MB): 2**16 features up to 1024 languages, fewer features beyond;
    over 262144 values of lang are an error. With no usable row the model knows no language and every prediction is `und`.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held_out))
    most = cells >> 8
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(n) > most:
        raise ValueError(f"more than {most} languages")
    bits = feature_bits(len(n), bits, cells)
    langs = sorted(n)
    if not langs:
        return Model([], np.empty((0, 1 << bits), np.float32), np.empty(0), orders, bits)
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / v), i) for i, (k, v) in enumerate(sorted(n.items()))], "lang string, _rate double, _k int")
    sample = rows.select("doc_id", "text", "lang").join(F.broadcast(rates), "lang").where(unit_hash(F.col("doc_id")) < F.col("_rate")).select("text", "_k").repartition(4)

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def told():
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array((keys >> bits).astype(np.int32)), pa.array((keys & ((1 << bits) - 1)).astype(np.int32)), pa.array(n)], names=["k", "f", "n"])

        for batch in batches:
            ks = batch.column(1).to_numpy().astype(np.int64)
            for start, texts in chunks(batch.column(0).to_pylist()):
                doc, feature, n = sparse_counts(texts, orders, bits)
                parts.append((ks[start + doc] << bits | feature, n))
                if sum(len(k) for k, _ in parts) > 1_000_000:
                    yield told()
        if parts:
            yield told()

    table = mapped(sample, count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(langs), 1 << bits), alpha)
    counts[table["k"], table["f"]] += table["n"]
    prior = np.log(np.array([n[k] for k in langs], float) / sum(n.values()))
    return Model(langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), prior, orders, bits)


def sparse_counts(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' counts as a sparse matrix in row order: (text number, feature, count) of each entry that is not 0."""
    kind = np.uint32 if len(texts) << bits <= 1 << 32 else np.int64
    owner, keys = None, [np.empty(0, kind)]
    for ids, inside, starts in hashed(texts, orders, bits):
        if owner is None:
            owner = np.repeat(np.arange(len(texts), dtype=kind) << kind(bits), np.diff(starts))
        keys.append((owner[: len(ids)] | ids.astype(kind))[inside])
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first].astype(np.int64)
    return keys >> bits, keys & ((1 << bits) - 1), count


def scored(texts: list[str], m: Model, by_feature: np.ndarray) -> np.ndarray:
    """(text, language): the prior and the sparse counts times the matrix, whose rows are features here; so many languages
    at once that a product of entries and languages holds some million numbers."""
    z = np.tile(m.prior, (len(texts), 1))
    doc, feature, count = sparse_counts(texts, m.orders, m.bits)
    if not len(doc) or not m.langs:
        return z
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    step = max(1, 1_000_000 // len(doc))
    for a in range(0, len(m.langs), step):
        part = by_feature[feature, a : a + step].astype(np.float64) * count[:, None]
        z[doc[first], a : a + step] += np.add.reduceat(part, first, axis=0)
    return z


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred (a learned language, or `und` where text is null or has no letter, or nothing was learned)
    and score (the posterior of that language, 0 for `und`). Ties go to the language first in name order. Texts are
    read whole; extra columns stay, columns named lang_pred or score are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    letter = regex.compile(r"\p{L}")

    def factory():
        m = held.value

        by_feature = np.ascontiguousarray(m.log_p.T)

        def run(text):
            names, scores = [], []
            for _, texts in chunks([t or "" for t in text.to_pylist()]):
                z = scored(texts, m, by_feature)
                best = z.argmax(1) if m.langs else np.zeros(len(texts), int)
                top = np.exp(z - z[np.arange(len(texts)), best][:, None]).sum(1) if m.langs else np.ones(len(texts))
                for t, k, total in zip(texts, best.tolist(), top.tolist(), strict=True):
                    known = bool(m.langs and letter.search(t))
                    names.append(m.langs[k] if known else UNKNOWN)
                    scores.append(1 / total if known else 0.0)
            return pa.array(names, pa.string()), pa.array(scores, pa.float64())

        return run

    return map_columns(docs, ["text"], "lang_pred string, score double", factory)
