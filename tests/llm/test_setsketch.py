"""SetSketch registers, their joint estimate, and classes against a comparison of all sets with all."""

import random

import numpy as np
import pytest

from plumbline.llm import setsketch as S
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, percent=80):
    """(doc_id, size, component_id, kept) by comparing every set with every other."""
    sets = []
    for _, text in docs:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append(set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} - {()})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def rows(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def copies(seed, groups, least=10):
    """Documents in groups of copies with more or fewer words changed, so that similarities lie on both sides of 0.8."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for n in groups:
        base = r.choices(vocabulary, k=r.randint(least, 120))
        for _ in range(n):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.8, 0.9])
def test_estimates(similarity):
    r = np.random.default_rng(int(similarity * 10))
    right = 0
    for size in (40, 300, 2000):
        for _ in range(40):
            both = int(round(2 * size * similarity / (1 + similarity)))
            e = r.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
            a, b = S.registers(e[:size]), S.registers(e[size - both :])
            right += S.at_least(similarity - 0.12, a, b, size, size) and not S.at_least(similarity + 0.12, a, b, size, size)
    assert right >= 118


def test_registers_merge():
    e = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (S.registers(e) == np.maximum(S.registers(e[:300]), S.registers(e[300:]))).all()
    assert (S.registers(e[:1]) >= 0).all() and (S.registers(e) <= S.Q + 1).all()


@pytest.mark.parametrize("limit", [4, 1024])
def test_classes(spark, limit):
    docs = [*copies(limit, [1] * 60 + [2] * 20 + [5] * 8 + [30]), (5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "oNE "), (None, "one"), (None, "é z"), (5005, "É z"), (None, "q r s t u v " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.near_duplicates(df, limit=limit)) == brute(docs)


def test_large_groups(spark):
    """Buckets and classes beyond the limit, by way of hubs and blocks."""
    docs = copies(7, [260, 3, 40, 2], least=60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.near_duplicates(df, limit=64)) == brute(docs)


def test_edges(spark):
    schema = "doc_id long, text string, digest string, n long, node long, first long, root long, registers string"
    rows_ = [(1, "a b c"), (1, "a b c"), (2, None), (None, "a b c"), (None, None), (3, "")]
    df = spark.createDataFrame([(*x, "d", 1, 1, 1, 1, "r") for x in rows_], schema)
    assert rows(S.near_duplicates(df)) == brute(rows_)
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op11_setsketch"](spark, SF)) == brute(docs)
