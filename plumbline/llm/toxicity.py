"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, crc_mod, discard, map_columns, mapped, stored, unit_hash, unused
from plumbline.llm.ngrams import hashed


@dataclass(frozen=True)
class Model:
    """features: sorted hashed n-grams; weights: log-count ratio times the learned weight of each."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int


def present(texts: list[str], features: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, index into features) of each feature that a text has, once."""
    known = np.zeros(1 << bits, bool)
    known[features] = True
    keys = [np.empty(0, np.int64)]
    for ids, inside, starts in hashed(texts, orders, bits):
        at = np.flatnonzero(known[ids] & inside)
        keys.append((np.searchsorted(starts, at, "right") - 1 << bits) | ids[at].astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> bits, np.searchsorted(features, keys & ((1 << bits) - 1))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, ratio: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and bias, by accelerated gradient steps on the L2-penalised logistic loss, until no
    slope is over 1e-5 or `steps` are done. rows must rise."""
    x, n, d = ratio[cols], len(y), len(ratio)
    w, b = np.zeros(d), float(np.log((weight * y).sum() / max(1e-9, (weight * (1 - y)).sum())))
    total = weight.sum()
    square = np.bincount(rows, x * x, n)
    head = np.flatnonzero(np.diff(rows, prepend=-1))  # where each row with an entry starts
    own = rows[head]
    bound = 0.25 * (np.max(square, initial=0.0) + 1)
    diag = 0.25 * np.bincount(cols, weight[rows] * x * x, d) / total
    scale = 1 / (np.sqrt(diag * bound) + l2 + 1e-3)
    v, c, pw, pb = w.copy(), b, w, b
    for k in range(steps):
        z = np.full(n, c)
        if len(head):
            z[own] += np.add.reduceat(x * v[cols], head)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = weight * (p - y) / total
        slope = np.bincount(cols, x * g[rows], d) + l2 * v
        if max(np.abs(slope).max(initial=0.0), abs(g.sum())) < 1e-5:
            return v * ratio, c
        w = v - scale * slope
        b = c - g.sum()
        v, c = w + k / (k + 3) * (w - pw), b + k / (k + 3) * (b - pb)
        pw, pb = w, b
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, *, held_out: int = 5, per_class: int = 4000, orders: tuple[int, ...] = (4, 5, 6), bits: int = 20, n_features: int = 8192, alpha: float = 1.0, l2: float = 1e-3, steps: int = 300) -> Model:
    """Fits on labelled rows whose crc32(doc_id) modulo held_out is not 0.

    At most about per_class rows of each label are used (chosen by a hash of doc_id; the bound of the sample), weighted
    back to the labels' own shares. Log-count ratios come from document counts of the n_features most telling of
    2**bits hashed n-grams. Rows with a null label or text, or a label other than 0 and 1, are not learned from; with
    no usable row of one of the labels the model is the constant 0 (no such label 1) or 1. The fit runs on the driver, which
    gets the sample's features: 8000 rows of 8192 four-byte numbers at the very most, 10 MB from 0.5 GB of documents.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), held_out) != 0)).select("doc_id", F.col("toxic").cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    empty = np.empty(0, np.int64), np.empty(0)
    if not n.get(1) or not n.get(0):
        return Model(*empty, 30.0 if n.get(1) else -30.0, orders, bits)
    rate = F.when(F.col("_y") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    chosen = known.where(unit_hash(F.col("doc_id")) < rate)  # about 2 * per_class rows, whatever the input
    sample = stored(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_y").repartition(4), "toxicity-sample")

    def count(batches):
        df = np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for start, texts in chunks(batch.column(0).to_pylist()):
                doc = [np.empty(0, np.int64)]
                for ids, inside, starts in hashed(texts, orders, bits):
                    at = np.flatnonzero(inside)
                    doc.append((np.searchsorted(starts, at, "right") - 1 << bits) | ids[at].astype(np.int64))
                keys = np.unique(np.concatenate(doc))
                y = np.array(ys[start : start + len(texts)])[keys >> bits]
                for label in (0, 1):
                    df[label] += np.bincount(keys[y == label] & ((1 << bits) - 1), minlength=1 << bits).astype(np.int32)
        ids = np.flatnonzero(df.any(0))
        for at in range(0, len(ids), 50_000):
            part = ids[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(df[0, part].astype(np.int64)), pa.array(df[1, part].astype(np.int64))], names=["f", "n0", "n1"])

    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        discard(sample)
        return Model(*empty, 30.0 if n[1] > n[0] else -30.0, orders, bits)
    counted = mapped(sample, count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (sizes[0] + sizes[1])
    telling = F.abs(F.col("n1") / sizes[1] - F.col("n0") / sizes[0]) / F.sqrt(share * (1 - share) + 1e-6)
    best = counted.orderBy(telling.desc(), "f").limit(n_features).toPandas().sort_values("f")
    features = best["f"].to_numpy(np.int64)
    p, q = best["n1"].to_numpy(float) + alpha, best["n0"].to_numpy(float) + alpha
    ratio = np.log(p / (sizes[1] + 2 * alpha)) - np.log(q / (sizes[0] + 2 * alpha))

    def encode(batches):
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for start, texts in chunks(batch.column(0).to_pylist()):
                row, col = present(texts, features, orders, bits)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ys[start : start + len(texts)], pa.int32()), pa.array([col[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["y", "x"])

    got = mapped(sample, encode, "y int, x binary").collect()  # at most about 2 * per_class rows of n_features numbers
    discard(sample)
    y = np.array([r["y"] for r in got], float)
    cols = [np.frombuffer(bytes(r["x"]), np.int32) for r in got]
    rows = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    weight = np.where(y == 1, n[1] / max(1, y.sum()), n[0] / max(1, (1 - y).sum()))
    w, b = fit_logistic(rows, np.concatenate(cols), ratio, y, weight / weight.mean(), l2, steps)
    return Model(features, w, b, orders, bits)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text the model calls toxic; all columns stay as they are, whatever their names. Null and
    empty texts are judged as texts without any feature; each of repeated rows is judged alike."""
    names = unused(docs, "_score"), unused(docs, "_predicted")
    return score(docs, model, names).where(F.col(names[1]) == 0).select(*docs.columns)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int, score >= 0.5) from text alone, under the names given.

    Null and empty texts score as a text without any feature. Long texts are read whole. Extra columns stay; columns
    with the names of the results are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most n_features entries

    def factory():
        m = held.value
        weights = m.weights

        def run(text):
            out = []
            for _, texts in chunks([t or "" for t in text.to_pylist()]):
                row, col = present(texts, m.features, m.orders, m.bits)
                z = np.bincount(row, weights[col], len(texts)) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            s = np.concatenate(out)
            return pa.array(s), pa.array((s >= 0.5).astype(np.int32))

        return run

    return map_columns(docs, ["text"], f"`{names[0]}` double, `{names[1]}` int", factory)
