"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import spelling as S
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    """The contract word by word."""
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in known if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in known}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        forms[w] = best if best is not None and known[best] >= 10 * known[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), known[w], len(near[w]), known.get(forms[w])) for w in known)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def drawn(seed, n, letters="abé"):
    r = random.Random(seed)
    base = ["".join(r.choices(letters, k=r.randint(6, 9))) for _ in range(60)]
    return [(i, " ".join(r.choices(base, weights=[1 + 400 // (k + 1) for k in range(60)], k=40))) for i in range(n)]


@pytest.mark.parametrize("bucket", [1, 8, 1024])
def test_variants(spark, bucket):
    docs = [*drawn(bucket, 60), (7, None), (None, "Abababab ABABABAB×x Éabababab éabababab"), (8, ""), (9, "aaaaaaa aaaaaaaa aaaaaaab " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(S.variants(df, bucket=bucket)) == brute(docs)


def test_one_edit():
    r = random.Random(1)
    for _ in range(20_000):
        a, b = ("".join(r.choices("ab", k=r.randint(0, 5))) for _ in range(2))
        assert S.one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize("bucket", [2, 1 << 20])
def test_each_pair_once(spark, bucket):
    words = sorted({w for _, t in drawn(9, 200, "ab") for w in t.split() if len(w) >= 7})
    got = [tuple(r)[:2] for r in S.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), bucket).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if distance(a, b) == 1)


def test_chains_and_edges(spark):
    docs = [(1, "kolibris " * 2000 + "kolibrix " * 150 + "kolibyix " * 12 + "kolbyix"), (2, "kolbyix " * 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, word string")
    got = rows(S.variants(df))
    assert got == brute(docs)
    assert S.variants(df.limit(0)).collect() == []


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op13_spelling"](spark, SF)) == brute(docs)
