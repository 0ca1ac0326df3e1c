"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import time
import types
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import xxhash
from plumbline.llm import common, decontaminate, graph, langid, media, packing, pii, simhash, suffixes, tokens, toxicity, warc
from plumbline.llm.bpe import Encoder

SF = "/root/testdata/sf0.001"
JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def classes(keys, linked):
    """The smallest key reachable from each, by trying all pairs."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


# Toxicity


def test_toxicity_held_out(spark):
    r = random.Random(5)
    words = ["ba", "tor", "lin", "mes", "kadu", "ren", "sovi"]
    rows = []
    for i in range(600):
        bad = r.random() < 0.3
        rows.append((i, " ".join(r.choices(words, k=r.randint(3, 60)) + ["vexgrob"] * bad + r.choices(words, k=3)), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"), n_features=512)
    got = toxicity.score(df, model).collect()
    assert all(r["predicted"] == r["toxic"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame([(i, "x" * 9, 1) for i in held], "doc_id long, text string, toxic int")
    assert len(toxicity.train(df, df).features) == 0


def naive_grams(text, orders, bits):
    """The hashed n-grams of a text, repeats included, one code point after the other."""
    points = [ord(c) for c in f" {text.lower()} "]
    out = []
    for n in orders:
        for i in range(len(points) - n + 1):
            h = points[i]
            for c in points[i + 1 : i + n]:
                h = (h * 16777619 + c) % (1 << 32)
            out.append((h + n * 97) * 2654435761 % (1 << 32) >> 32 - bits)
    return out


def test_toxicity_equals_naive_counts_and_scores(spark):
    r = random.Random(8)
    words = ["ba", "tor", "lin", "mes", "kadu", "ren", "sovi", "é日"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12)) + ["vex"] * (i % 3 == 0 and r.random() < 0.8)), int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    orders, bits = (2, 3), 12
    m = toxicity.train(df.drop("toxic"), df.drop("text"), orders=orders, bits=bits, n_features=40, steps=4000, l2=0.01)
    seen = [(set(naive_grams(t, orders, bits)), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    size = [sum(y == k for _, y in seen) for k in (0, 1)]
    count = lambda f, k: sum(f in g and y == k for g, y in seen)
    every = set().union(*(g for g, _ in seen))

    def telling(f):
        share = (count(f, 0) + count(f, 1)) / sum(size)
        return abs(count(f, 1) / size[1] - count(f, 0) / size[0]) / (share * (1 - share) + 1e-6) ** 0.5

    assert m.features.tolist() == sorted(sorted(every, key=lambda f: (-telling(f), f))[:40])
    ratio = np.array([np.log((count(f, 1) + 1) / (size[1] + 2)) - np.log((count(f, 0) + 1) / (size[0] + 2)) for f in m.features])
    x = np.array([[f in g for f in m.features] for g, _ in seen], float) * ratio
    y = np.array([y for _, y in seen], float)
    weight = np.where(y == 1, size[1] / y.sum(), size[0] / (1 - y).sum())
    w = np.divide(m.weights, ratio, out=np.zeros(40), where=np.abs(ratio) > 1e-12)
    p = 1 / (1 + np.exp(-(x @ w + m.bias)))
    gradient = x.T @ (weight * (p - y)) / weight.sum() + 0.01 * w  # of the penalised loss: nothing is left to gain
    assert np.abs(gradient).max() < 1e-4 and abs((weight * (p - y)).sum() / weight.sum()) < 1e-4
    at = {f: k for f, k in zip(m.features.tolist(), m.weights.tolist(), strict=True)}
    for got in toxicity.score(df, m).collect():
        z = m.bias + sum(at.get(f, 0) for f in set(naive_grams(got["text"], orders, bits)))
        assert abs(got["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_on_labels_held_out(spark):
    """Documents that no fit has read: ranks and decisions."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs.join(labels, "doc_id"), toxicity.train(docs, labels)).select("doc_id", "toxic", "score", "predicted").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["toxic"] in (0, 1)]
    bad, good = ([r["score"] for r in held if r["toxic"] == k] for k in (1, 0))
    assert len(bad) > 20 and len(good) > 200
    assert np.mean([b > g for b in bad for g in good]) > 0.97
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert np.mean(np.array(bad) >= 0.5) > 0.75 and np.mean(np.array(good) >= 0.5) < 0.005


# SimHash


def naive_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, docs, texts):
    prints = {k: naive_print(t) for k, t in texts.items()}
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (prints[k], want[k]) for k in prints}
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert kept == {k for k in want if want[k] == k}


def test_classes_of_frequent_prints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FREQUENT", 3)
    rows = [(i, "same words here again" if i % 2 else f"other text number {i} of many words {i * i}" if i % 3 else None) for i in range(120)]
    prints = {i: naive_print(t) for i, t in rows}
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [1024, 1])
def test_links_lose_none(spark, bucket):
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(4):
            v ^= sum({1 << r.randrange(64) for _ in range(r.randint(1, 4))})
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    roots = {x["node"]: x["root"] for x in graph.components(simhash.links(df, 3, bucket), "t").collect()}
    want = classes([signed(v) for v in values], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert {v: roots.get(v, v) for v in want} == want


def test_masks_cover_every_three_bits():
    r = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in r.sample(range(64), 3))
        assert any(m & bits == 0 for m in simhash.masks(3))


# Tokens and packing


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    library = Tokenizer.from_file(JSON)
    cache = str(tmp_path / "cache")
    part = docs.where("doc_id % 2 = 0")
    tokens.token_counts(part, JSON, RANKS, cache).count()
    before = spark.read.parquet(cache).count()
    assert before == len({texts[k] for k in texts if k % 2 == 0})
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, JSON, RANKS, cache).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert spark.read.parquet(cache).count() == len(set(texts.values()))


def test_second_run_encodes_nothing(spark, docs, texts, tmp_path):
    """The counts of a second run are stored ones: it adds no file, and a wrong count that is stored comes back."""
    cache = str(tmp_path / "cache")
    files = lambda: sorted(str(p) for p in (tmp_path / "cache").rglob("*.parquet"))
    first = sorted(map(tuple, tokens.token_counts(docs, JSON, RANKS, cache).select("doc_id", "n_tokens").collect()))
    before = files()
    assert sorted(map(tuple, tokens.token_counts(docs, JSON, RANKS, cache).select("doc_id", "n_tokens").collect())) == first and files() == before
    digest = hashlib.sha256(b"never seen").digest()
    spark.createDataFrame([(bytearray(digest), 77)], tokens.COUNTS).write.mode("append").parquet(f"{cache}/tokenizer_digest={tokens.tokenizer_digest(JSON)}")
    more = spark.createDataFrame([(1, "never seen", 5), (2, "is new", 6)], "doc_id long, text string, content_digest int")
    got = {r["doc_id"]: r for r in tokens.token_counts(more, JSON, RANKS, cache).collect()}
    assert got[1]["n_tokens"] == 77 and got[1]["content_digest"] == 5
    assert got[2]["n_tokens"] == len(Tokenizer.from_file(JSON).encode("is new", add_special_tokens=False).ids)


def test_token_counts_of_frequent_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 4)
    rows = [(i, ["hot text", "warm", None, f"own {i}"][0 if i % 2 else 1 if i % 8 == 0 else 2 if i % 8 == 2 else 3]) for i in range(400)]
    library = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), JSON, RANKS, str(tmp_path / "c")).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_no_local_folder_on_a_cluster():
    none = types.SimpleNamespace(isDefined=lambda: False, isEmpty=lambda: True)
    context = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none)))
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="share"):
        common.work_dir(session)


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    blocks = lambda: sum(1 for x in (spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString().split(",")) if "shuffle_" in x)
    before = blocks()
    out = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert blocks() <= before and out.count() == 7
    common.discard(out)


def test_sieves_lose_none_of_their_own(spark):
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "hash long")
    for most in (16, 28):
        sieve = common.sieve(df, 5000, each=32, most=most)
        assert len(sieve.passed(h)) == len(h)
    other = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert len(sieve.passed(other)) < 100
    assert len(common.sieve(df.limit(0), 0).passed(h)) == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "it's\n\nx", "a<|endoftext|>b", "日本 é ²½ ١", "x\u0085y z", "🙂 ok", "\t\r\n a "])
def test_encoder_equals_library(text):
    assert Encoder(JSON, RANKS)(text) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, texts):
    library = Tokenizer.from_file(JSON)
    rows = packing.packed(docs, JSON, RANKS).collect()
    for doc, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1]) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 1024 for r in mine[1:]) and all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [n for _, n in b])[:-1]) and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 1024) + 3


def test_packing_against_best_fit_decreasing():
    """Over many documents the plan needs at most a thousandth more sequences than putting each piece, longest first, where
    it leaves least room."""
    r = random.Random(11)
    for draw in (lambda: r.randint(1, 1024), lambda: min(1024, int(r.lognormvariate(5.5, 1)) + 1), lambda: r.choice((300, 400, 500, 700, 1024))):
        lengths = [draw() for _ in range(20_000)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = packing.plan(counts, 1024)
        used = max(first + -(-(end - begin) // copies) for _, begin, end, copies, first, _ in rows)
        room, bins = [0] * 1025, 0  # how many sequences have so much room left
        for n in sorted(lengths, reverse=True):
            k = next((k for k in range(n, 1025) if room[k]), None)
            if k is None:
                bins, k = bins + 1, 1024
            else:
                room[k] -= 1
            room[k - n] += 1
        assert used <= bins * 1.001 + 1 and used >= -(-sum(lengths) // 1024)


def best_fit_decreasing(counts, capacity=1024):
    """How many sequences the plain rule needs: the longest piece left goes where the least room is left."""
    space, n = np.zeros(capacity + 1, np.int64), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = np.flatnonzero(space[length:])
            room = length + fits[0] if len(fits) else capacity
            n += not len(fits)
            space[room] -= len(fits) > 0
            space[room - length] += 1
    return n


@pytest.mark.parametrize("seed", range(20))
def test_never_more_sequences_than_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(50, 3000))
    drawn = [r.integers(1, 1025, n), np.clip(r.lognormal(5, 1, n), 1, 1024), np.clip(r.normal(400, 150, n), 1, 1024), r.choice(r.integers(1, 1025, 30), n)][seed % 4]
    counts = dict(zip(*(x.tolist() for x in np.unique(drawn.astype(int), return_counts=True)), strict=True))
    rows = packing.plan(counts, 1024)
    assert max(r[4] + (r[2] - r[1]) // r[3] for r in rows) <= best_fit_decreasing(counts)


def test_fullest_is_the_fullest():
    r = random.Random(4)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        for length in r.choices(range(1, 31), k=r.randint(1, 7)):
            counts[length] += 1
        items = [k for k in range(31) for _ in range(counts[k])]
        longest = items.pop()
        best = max(s for m in range(1 << len(items)) if (s := longest + sum(x for i, x in enumerate(items) if m >> i & 1)) <= 30)
        got = packing.fullest(counts, 30)
        assert sum(k * n for k, n in got) == best and all(n <= counts[k] for k, n in got)


# Decontamination


def test_decontamination_equals_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [r.choices(vocabulary, k=k) for k in (30, 14, 12, 5, 1)]
    rows = []
    for i in range(60):
        body = r.choices(vocabulary, k=40)
        if i % 3 == 0:
            piece = list(r.choice(items))
            for _ in range(i % 4):
                piece[r.randrange(len(piece))] = "changed"
            body[10:10] = piece
        rows.append((i, ", ".join(body).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    want = set()
    for i, text in rows:
        t = text.lower().split(", ")
        for x in items:
            size, allowed = (12, 2) if len(x) >= 12 else (len(x), 0)
            for a in range(len(t) - size + 1):
                if any(sum(p != q for p, q in zip(t[a : a + size], x[b : b + size], strict=True)) <= allowed for b in range(len(x) - size + 1)):
                    want.add((i, a, size))
    assert {(h["doc_id"], h["start"], h["length"]) for h in decontaminate.hits(docs, bench).collect()} == want
    clean = {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _, _ in want}


def test_decontamination_credits_every_item(spark):
    long_ = [f"w{i}" for i in range(20)]
    items = {1: long_[:14], 2: long_, 3: ["other" if i == 5 else w for i, w in enumerate(long_)], 4: [f"v{i}" for i in range(15)], 5: ["w3", "w4"], 6: ["w3", "w4"]}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    rows = [(1, "before " + " ".join(long_) + " after"), (2, " ".join(items[4])), (3, "w3 w4"), (None, "x w3 w4"), (4, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: set() for i, _ in rows}
    places = {i: set() for i, _ in rows}
    for i, text in rows:
        t = text.split()
        for k, x in items.items():
            size, allowed = (12, 2) if len(x) >= 12 else (len(x), 0)
            at = {a for a in range(len(t) - size + 1) for b in range(len(x) - size + 1) if sum(p != q for p, q in zip(t[a : a + size], x[b : b + size], strict=True)) <= allowed}
            want[i] |= {k} if at else set()
            places[i] |= {(a, size) for a in at}
    assert want[1] == {1, 2, 3, 5, 6} and want[None] == {5, 6}
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert {i: set(r["item_ids"]) for i, r in got.items()} == {i: k for i, k in want.items() if k}
    assert all((r["n_windows"], r["first_token"], r["end_token"]) == (len(places[i]), min(a for a, _ in places[i]), max(a + n for a, n in places[i])) for i, r in got.items())
    assert {(h["doc_id"], h["item_id"]) for h in decontaminate.hits(docs, bench).collect()} == {(i, k) for i, ks in want.items() for k in ks}


def test_decontamination_finds_planted_items(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    items = [r["text"] for r in bench.collect()]
    assert {k for k, t in texts.items() if any(x in t for x in items)} <= found and len(found) < len(texts) / 5


# Language


def test_language_held_out(docs):
    got = langid.predict(docs, langid.train(docs)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_equals_naive_bayes(spark):
    r = random.Random(9)
    letters = {"aa": "abcde", "bb": "abxyz", "cc": "éßñ日a", "dd": "01 a"}
    rows = [(i, "".join(r.choices(letters[k] + " ", k=r.randint(0, 30))), k) for i, k in enumerate(r.choices(list(letters), k=120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df, orders=(1, 2), bits=8, alpha=0.5)
    learn = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({k for _, k in learn})
    assert m.langs == langs
    count = {k: np.full(256, 0.5) for k in langs}
    for t, k in learn:
        for f in naive_grams(t, (1, 2), 8):
            count[k][f] += 1
    log_p = {k: np.log(c / c.sum()) for k, c in count.items()}
    prior = {k: np.log(sum(x == k for _, x in learn) / len(learn)) for k in langs}
    for got in langid.predict(df, m).collect():
        z = np.array([prior[k] + sum(log_p[k][f] for f in naive_grams(got["text"], (1, 2), 8)) for k in langs])
        if not any(c.isalpha() for c in got["text"]):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got["score"] - p[langs.index(got["lang_pred"])]) < 1e-4 and p[langs.index(got["lang_pred"])] > p.max() - 1e-4


def test_many_languages(spark):
    rows = [(4 * i, f"{chr(0x4E00 + i)} {chr(0x4E00 + i)}", f"l{i:04}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(df, held_out=9, cells=1500 << 10)
    assert len(m.langs) == 1500 and m.bits == 10
    texts = [t for _, t, _ in rows[:20]]
    z = langid.scored(texts, m, np.ascontiguousarray(m.log_p.T))
    one = np.concatenate([langid.scored([t], m, np.ascontiguousarray(m.log_p.T)) for t in texts])
    assert np.allclose(z, one) and (z.argmax(1)[:5] >= 0).all()


# PII


def naive_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns(texts):
    r = random.Random(3)
    made = ["".join(r.choices(r.choice(["ab@.@1-", "0123456789 -", "+1 ().2-", "12.5.0", "a@b.c 1.2+"]), k=r.randint(0, 40))) for _ in range(20000)]
    for t in [*texts.values(), *made, "4111 1111 1111 1111", "999.1.1.1 0001.2.3.4"]:
        assert pii.base_spans(t) == naive_spans(t)


def test_field_adds_and_keeps(spark):
    rows = [(0, "call (743) 555-3824 now"), (1, "x jo.do (at) site (dot) org y a@b.com"), (2, "on 2024-05-06 at noon"), (3, None), (4, "")]
    w = pii.train()
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), w).collect()}
    assert got[0]["spans"] == "phone:5:19" and got[0]["n_phone"] == 0
    assert got[1]["spans"] == "email:2:27,email:30:37" and got[1]["n_email"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:30:37").hexdigest()
    assert all(got[i]["spans"] == "" for i in (2, 3, 4))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string"), w).collect()}
    assert masked[1] == "x [EMAIL] y [EMAIL]" and masked[3] is None and masked[2] == rows[2][1]


def test_field_finds_short_spaced_addresses(spark, monkeypatch):
    w = pii.train()
    ips = ["192 . 0 . 2 . 1", "10 . 0 . 0 . 1", "1 . 2 . 3 . 4", "75 . 95 . 2 . 7"]
    rows = [(i, before + ip + after) for i, (before, ip, after) in enumerate((b, ip, a) for ip in ips for b, a in (("server ", " here"), ("x ", ", y"), ("ip: ", ". Then")))]
    got = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string"), w).collect()}
    assert got == {i: t.replace(ips[i // 3], "[IP]") for i, t in rows}
    assert all(not pii.field_spans(t, [], w) for t in ("on 3 . 9 . 4 . 300 y", "at 1 . 2 . 3 y"))
    monkeypatch.setattr(pii, "examples", lambda n: [("call 12 34 now", [("phone", 5, 10)])])
    with pytest.raises(ValueError, match="12 34"):
        pii.train()


def test_field_held_out():
    w = pii.train()
    ok = total = extra = 0
    for text, spans in pii.examples(120, seed=99):
        base = set(pii.base_spans(text))
        got = set(pii.field_spans(text, sorted(base), w))
        ok, total, extra = ok + len(got & set(spans) - base), total + len(set(spans) - base), extra + len(got - set(spans))
    assert ok >= 0.95 * total and extra <= 0.05 * total


def naive_field(text, base, w):
    """One dynamic program over all tokens of the whole text and all candidates that touch no base span."""
    tokens = pii.tokenize(text)
    segments = [(a, b) for a, b in pii.candidates(text, tokens) if not any(s < tokens[b - 1].end and e > tokens[a].start for _, s, e in base)]
    if not segments:
        return []
    scores = np.array([pii.segment_features(text, tokens, a, b) for a, b in segments], float) @ w.T
    found = [(pii.KINDS[k], tokens[a].start, tokens[b - 1].end) for a, b, k in pii.viterbi(len(tokens), segments, scores)]
    return sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


def test_spans_equal_one_program_over_whole_texts(spark):
    r = random.Random(1)
    made = ["".join(r.choices("0123456789 .-()+/@at dot[]é\n", k=r.randint(0, 90))) for _ in range(250)]
    odd = ["", "  ", "server 10 . 0 . 0 . 1 is up", "aaaa " + "y" * 60 + "jo.do(at)site.org", "IBAN DE89 3704 0044 0532 0130 00", "call 555\t382\n4445 now", "٣٤٥ 1234567", "x 1\n.2.3.4 y"]
    texts = [t for t, _ in pii.examples(60, seed=5) + pii.short_quads(10, seed=6)] + made + odd
    for w in (pii.train(), np.random.default_rng(0).normal(size=pii.train(20, 1).shape)):
        want = [naive_field(t, pii.base_spans(t), w) for t in texts]
        assert pii.field_spans_of(texts, [pii.base_spans(t) for t in texts], w) == want
    w = pii.train()
    assert naive_field(odd[2], [], w) == [("ip", 7, 21)] and naive_field(odd[3], [], w) == [("email", 5, 82)] and naive_field(odd[4], [], w) == []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.find(df, w).collect():
        base = pii.base_spans(x["text"])
        assert x["spans"] == pii.joined(sorted(base + naive_field(x["text"], base, w), key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))


def test_field_on_documents(texts):
    """Numbers that the patterns lose as another number follows at once are found; nothing else is called personal."""
    w = pii.train()
    form = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])")
    for t in texts.values():
        base = pii.base_spans(t)
        assert {("phone", *m.span()) for m in form.finditer(t)} - set(base) == set(pii.field_spans(t, base, w))


def test_dynamic_program_equals_brute_force():
    r = np.random.default_rng(0)
    for _ in range(30):
        n = 6
        segments = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 3) + 1)]
        scores = r.normal(size=(len(segments), 2))

        def best(at):
            if at == n:
                return 0.0
            return max([best(at + 1)] + [scores[i].max() + best(b) for i, (a, b) in enumerate(segments) if a == at])

        cut = pii.viterbi(n, segments, scores)
        assert abs(sum(scores[segments.index((a, b)), k] for a, b, k in cut) - best(0)) < 1e-9

        def mass(at):
            return 1.0 if at == n else mass(at + 1) + sum(np.exp(scores[i]).sum() * mass(b) for i, (a, b) in enumerate(segments) if a == at)

        p, log_z = pii.marginals(n, segments, scores)
        assert abs(np.exp(log_z) - mass(0)) < 1e-6 * mass(0) and (p > 0).all() and (p < 1).all()


# Repeated strings


@pytest.mark.parametrize(("bucket", "part"), [(4096, 1 << 20), (1, 1 << 20), (4096, 150)])
def test_suffixes_equal_brute_force(spark, monkeypatch, bucket, part):
    monkeypatch.setattr(suffixes, "_PART", part)
    r = random.Random(3)
    words = ["the", "of", "andé", "lor", "ipsum", "xx"]
    base = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(10)]
    rows = [(i, r.choice(base) if i % 4 == 0 else " ".join(r.choices(base, k=2)) if i % 4 == 1 else r.choice(base)[r.randint(0, 50) :] + " ".join(r.choices([*words, f"q{i}"], k=60)) if i % 4 == 2 else "a" * r.choice([0, 99, 100, 101, 400])) for i in range(44)]
    rows[5] = (5, None)
    seen, want = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        cut = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                cut[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(data, cut, strict=True) if not m)
        want[i] = (len(data), sum(cut), len(re.findall(b"\1+", bytes(cut))), kept)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket=bucket).collect()}
    assert got == want


@pytest.mark.parametrize(("length", "bucket"), [(24, 3), (24, 4096), (100, 2), (160, 3), (224, 2), (224, 4096)])
def test_suffixes_of_any_length_and_bucket(spark, length, bucket):
    r = random.Random(length)
    hot = "".join(r.choices("abcdefgh ", k=60))  # one gram with very many surroundings, near and far copies of them
    tails = ["".join(r.choices("ab", k=150)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(r.choices("ab", k=r.randint(0, 120))) + hot + r.choice(tails)[: r.randint(0, 150)]
        rows.append((i, t if i % 5 else r.choice(tails) + hot + hot + t))
    rows += [(i, "same text " * 40) for i in range(60, 90)]
    seen, want = set(), {}
    for i, t in rows:
        data, cut = t.encode(), bytearray(len(t))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                cut[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        want[i] = bytes(c for c, m in zip(data, cut, strict=True) if not m)
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), length, bucket).collect()}
    assert got == want


def test_full_batches_of_long_windows(spark):
    r, length, n = random.Random(12), 224, 201
    rows = []
    for k in range(4096):
        context = r.randbytes(n + length - 1)
        rows += [(k // 2, 2 * k + i, 0, (n - 1) << 8 | n, bytearray(context)) for i in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = suffixes._repeats(spark.createDataFrame(rows, "h long, doc long, twin long, run long, context binary"), length).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((g["doc"], g["at"], g["n"]) for g in got) == [(2 * k + 1, 0, n) for k in range(4096)]


def test_refinement_sorts():
    r = np.random.default_rng(1)
    rows = r.integers(0, 2, (500, 16)).astype(np.uint8)
    group = r.integers(0, 5, 500)
    order = suffixes.refine(rows, group.astype(np.int64))
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))


# WARC and media


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é?x=1", "same"), (2, None, "same"), (3, "http://c", None), (4, "u", ""), (5, "u", "one"), (5, "u", "one"), (6, "u", "x" * 300_000)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    records = warc.read_records(index)
    full = {r["page_id"]: bytes(r["payload"]) for r in records.where("record_type = 'response'").collect()}
    assert full == {2: b"same", 4: b"", 5: b"one", 6: b"x" * 300_000}
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolved(records).collect())
    kind = {1: ("revisit", 2), 3: ("revisit", 4)}
    assert [(g[0], g[1], g[2], (g[3], g[4])) for g in got] == [(p, len(h or ""), warc.sha1_base32((h or "").encode()), kind.get(p, ("response", None))) for p, _, h in rows]
    some = index.where("page_id in (1, 6)")
    assert sorted(r["page_id"] for r in warc.read_records(some).collect()) == [1, 6]


def test_ranges_coalesce():
    assert list(warc.ranges([(0, 10), (10, 5), (100, 10), (115, 10)], 5, 50)) == [(0, 15, [0, 1]), (100, 125, [2, 3])]
    assert [r[2] for r in warc.ranges([(0, 40), (40, 40)], 5, 50)] == [[0], [1]]


def test_scores_of_written_numbers_equal_their_features():
    """What arrays give for each written number is what its features give."""
    w, r = pii.train(60, 10), random.Random(4)
    parts = lambda: r.choice(("00" + str(r.randint(0, 10 ** r.randint(1, 12))), str(r.randint(0, 10 ** r.randint(1, 20))), *"()+-./–x", "2001-02-03", "19.5.6", "tel:", "card", "ip", "1.2.3.4", str(r.randint(0, 300)), "\n"))
    seen = 0
    for _ in range(150):
        text = " ".join(parts() for _ in range(r.randint(3, 25)))
        t, tokens = pii.Tokens([text]), pii.tokenize(text)
        written, linked, digits = (np.concatenate([[0], np.cumsum(x)]) for x in (t.number, t.linked, t.digits))
        pairs = [(a, b) for a in range(len(tokens)) for b in range(a + 1, min(len(tokens), a + 20) + 1) if written[b] - written[a] == b - a and linked[b] - linked[a + 1] == b - a - 1 and digits[b] > digits[a]]
        if pairs:
            got = pii._number_scores(t, *np.array(pairs).T, w)
            want = np.array([pii.segment_features(text, tokens, a, b) for a, b in pairs], float) @ w.T
            assert np.allclose(got, want), text
            seen += len(pairs)
    assert seen > 5000


def test_texts_of_numbers_take_no_long(spark):
    r = random.Random(1)
    w = pii.train()
    for text in ("1234567 " * 3000, " ".join(str(r.randint(0, 10 ** r.randint(1, 9))) for _ in range(18_000))):
        start = time.perf_counter()
        pii.field_spans_of([text], [pii.base_spans(text)], w)
        assert time.perf_counter() - start < 20  # some seconds on a busy machine; minutes before


def test_archives_lie_in_the_default_file_system(spark, tmp_path):
    """A folder without a scheme is Spark's to resolve, whatever its default file system is, and goes with delete_archives()."""
    conf = spark._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.shop.link./shelf", f"file://{tmp_path}/there")
    conf.set("fs.viewfs.mounttable.shop.link./tmp", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://shop/")
    try:
        pages = spark.createDataFrame([(k, f"u{k}", "same" if k % 3 else f"own {k}") for k in range(20)], "page_id long, url string, html string")
        index = warc.write_archives(pages, "/shelf/archives")
        assert {r["archive"].rsplit("/", 1)[0] for r in index.collect()} == {f"file:{tmp_path}/there/archives"}
        assert len(list((tmp_path / "there/archives").iterdir())) >= 1
        assert warc.read_records(index).count() == 20
        warc.delete_archives(index)
        assert not (tmp_path / "there/archives").exists()
        with pytest.raises(Exception, match="[Ss]cheme|FileSystem"):
            warc.write_archives(pages, "nowhere://x/archives")
    finally:
        conf.set("fs.defaultFS", was or "file:///")


@pytest.mark.parametrize("n", [1, 64, 4096, 10_000])
def test_media_round_trip(n):
    payload = bytes(i % 251 for i in range(n))
    stored = media.write_container(payload)
    track = media.read_container(stored)[0]
    assert media.payload_of(stored, track) == payload
    assert (track.codec, track.duration, track.n_samples, track.n_keyframes, track.keyframes) == ("raw ", n, n, n, [(len(stored) - n, n)])


def test_media_sync_samples_and_sizes():
    box = lambda k, *p: struct.pack(">I4s", 8 + sum(map(len, p)), k) + b"".join(p)
    full = lambda k, *p: box(k, bytes(4), *p)
    numbers = lambda *x: struct.pack(f">{len(x)}I", *x)
    table = box(b"stbl", full(b"stsd", numbers(1), box(b"avc1", bytes(8))), full(b"stsc", numbers(1, 1, 2, 1)), full(b"stsz", numbers(0, 4, 3, 5, 7, 2)), full(b"stco", numbers(2, 8, 40)), full(b"stss", numbers(3, 1, 3, 4)))
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", numbers(0, 0, 90, 360), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", table))))
    data = box(b"mdat", bytes(60)) + moov
    track = media.read_container(data)[0]
    assert (track.codec, track.timescale, track.duration, track.n_keyframes) == ("avc1", 90, 360, 3)
    assert track.keyframes == [(8, 3), (40, 9)] and track.samples == [(8, 8), (40, 9)]


def test_media_every_track_and_fragments(spark):
    box = lambda k, *p: struct.pack(">I4s", 8 + sum(map(len, p)), k) + b"".join(p)
    full = lambda k, *p: box(k, bytes(4), *p)
    numbers = lambda *x: struct.pack(f">{len(x)}I", *x)

    def track(handler, codec, first, sizes, *sync):
        table = box(b"stbl", full(b"stsd", numbers(1), box(codec, bytes(8))), full(b"stsc", numbers(1, 1, len(sizes), 1)), full(b"stsz", numbers(0, len(sizes), *sizes)), full(b"stco", numbers(1, first)), *sync)
        return box(b"trak", box(b"mdia", full(b"mdhd", numbers(0, 0, 90, 360), bytes(4)), full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", table)))

    payload = bytes(range(60))
    two = box(b"mdat", payload) + box(b"moov", track(b"soun", b"mp4a", 8, [4, 4]), track(b"vide", b"avc1", 20, [3, 5, 7], full(b"stss", numbers(2, 1, 3))))
    broken = box(b"moov", track(b"vide", b"avc1", 8, [])) + box(b"moof", box(b"traf", full(b"trun", numbers(1, 5)))) + box(b"mdat", bytes(5))
    got = {r["k"]: r for r in media.describe(spark.createDataFrame([(0, bytearray(two)), (1, bytearray(broken))], "k long, media binary")).collect()}
    assert (got[0]["codec"], got[0]["n_keyframes"], got[0]["error"]) == ("mp4a", 2, None)
    sound, video = got[0]["tracks"]
    assert (sound["handler"], sound["codec"], sound["payload_sha256"]) == ("soun", "mp4a", got[0]["payload_sha256"])
    assert (video["handler"], video["codec"], video["n_samples"], [tuple(x) for x in video["keyframes"]]) == ("vide", "avc1", 3, [(20, 3), (28, 7)])
    assert video["payload_sha256"] == hashlib.sha256(payload[12:27]).hexdigest()
    assert "fragmented" in got[1]["error"] and got[1]["n_samples"] is None and got[1]["tracks"] is None


def test_boxes_nested_without_end(spark):
    data = b""
    for _ in range(3000):
        data = struct.pack(">I4s", 8 + len(data), b"moov") + data
    got = media.describe(spark.createDataFrame([(0, bytearray(data))], "k long, media binary")).first()
    assert "nested" in got["error"] and got["tracks"] is None and got["media_bytes"] == len(data)


def test_media_malformed(spark):
    good = media.write_container(b"x" * 64)
    rows = [(0, None), (1, b""), (2, good[:-1]), (3, b"\0\0\0\4abcd"), (4, good)]
    got = {r["k"]: r for r in media.describe(spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in rows], "k long, media binary")).collect()}
    assert all(got[i]["error"] and got[i]["payload_bytes"] is None for i in range(4)) and got[4]["error"] is None and got[4]["payload_bytes"] == 64


def test_media_padding(spark):
    rows = [(0, None), (1, "é" * 32), (2, "x" * 65)]
    got = {r["doc_id"]: r for r in media.describe(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[i]["payload_bytes"] for i in range(3)] == [64, 64, 128]
    assert got[2]["payload_sha256"] == hashlib.sha256(b"x" * 65 + bytes(63)).hexdigest() and got[2]["tail_crc32"] == zlib.crc32(b"x" + bytes(63))
    assert got[0]["media_sha256"] == hashlib.sha256(media.write_container(bytes(64))).hexdigest()
