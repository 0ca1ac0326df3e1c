"""The pipeline's stages over a small table, each against a plain reading of what it keeps."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import pii, toxicity
from tests.llm.test_operators import classes, naive_print

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
        assert name == corpus_pipeline.STAGES[-1][0] or frames[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in f.collect()} for f in frames[:-1]]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"]}
    assert set(rows[1]) == set(rows[0]) - toxic
    prints = {k: naive_print(r["text"]) for k, r in rows[1].items()}
    roots = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert set(rows[2]) == set(roots.values())
    items = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = [tuple(x[i : i + 12]) for x in items for i in range(len(x) - 11)]

    def leaks(text):
        t = re.findall(r"[^\W_]+", text.lower())
        return any(sum(p != q for p, q in zip(t[a : a + 12], w, strict=True)) <= 2 for a in range(len(t) - 11) for w in windows if t[a : a + 3] == list(w[:3]) or t[a + 9 : a + 12] == list(w[9:]))

    assert {k for k, r in rows[2].items() if leaks(r["text"])} <= set(rows[2]) - set(rows[3])
    assert len(rows[3]) > 0.7 * len(rows[2])
    assert set(rows[4]) == set(rows[3])
    for k, r in rows[4].items():
        assert r["n_chars"] == len(r["text"])
        base = pii.base_spans(rows[3][k]["text"])
        assert all(rows[3][k]["text"][s:e] not in r["text"] for kind, s, e in base if kind in ("email", "phone"))
        if not re.search(r"[0-9@]", rows[3][k]["text"]):
            assert r["text"] == rows[3][k]["text"]
    assert {r["doc_id"] for r in frames[-1].collect()} == set(rows[4])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x y", "en", None, 3), (3, "", "fr", "s", 0), (4, "long words here " * 9000, "en", "s", 144_000), (5, "mail a@b.com now", None, "s", 16), (6, "日本語 ²½ \u0085 🙂", "ja", "s", 9)]
CLASH = ["score", "predicted", "fingerprint", "component_id", "hash", "window", "spans", "_score", "_gone", "offset"]
#: Which rows each stage keeps of ROWS, by doc_id; the pair of repeated rows is one where a stage keeps one of them.
KEPT = {"toxicity": [None, 1, 1, 2, 3, 4, 5, 6], "near_duplicates": [None, 1, 2, 4, 5, 6], "decontamination": [None, 1, 1, 2, 3, 5, 6], "personal_data": [None, 1, 1, 2, 3, 4, 5, 6], "packing": [None, 1, 1, 2, 3, 4, 5, 6]}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 0, 0), (5, 1, 0), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "long words here " * 5), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_odd_rows(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH})
    got = stage(spark, docs, small)
    rows = got.collect()
    ids = [r["doc_id"] for r in rows] if name != "packing" else [r["doc_id"] for r in rows if r["piece"] == 0]
    assert sorted(ids, key=lambda x: (x is not None, x)) == KEPT[name]
    if name != "packing":
        assert got.columns == docs.columns and all(r[c] == 7 for r in rows for c in CLASH)
        text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows}
        assert text[2] == (None, None) and text[5] == (("mail [EMAIL] now", 16) if name == "personal_data" else ("mail a@b.com now", 16))
    assert stage(spark, docs.limit(0), small).count() == 0
    bare = docs.drop("n_chars")
    assert name == "packing" or stage(spark, bare, small).columns == bare.columns
