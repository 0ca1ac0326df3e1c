"""Nulls in any column, empty and very long texts, repeated rows, clashing columns and empty tables: nothing crashes, and
every row has its result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, langid, media, packing, pii, simhash, suffixes, tokens, toxicity, warc

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "predicted", "fingerprint", "component_id", "n_tokens", "content_digest", "lang_pred", "spans", "media", "hash", "offset", "doc", "kept"]
ROWS = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x y", "en", None, 3), (3, "", "fr", "s", 0), (4, "long words here " * 15_000, "en", "s", 240_000), (5, "12345 !!", None, "s", 8), (6, "日本語 ²½ \u0085 🙂", "ja", "s", 9)]


@pytest.fixture(scope="module")
def frames(spark):
    clash = lambda df: df.withColumns({c: F.lit(7) for c in CLASH})
    return [(clash(spark.createDataFrame(ROWS, SCHEMA)), len(ROWS)), (clash(spark.createDataFrame([], SCHEMA)), 0)]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "long words here long words here long words here long words here"), (None, None), (2, ""), (3, "y")], "item_id long, text string")


def test_toxicity(spark, frames):
    for labels in ([(1, 1), (4, 0), (None, 1), (5, None)], []):
        known = spark.createDataFrame(labels, "doc_id long, toxic int")
        for df, n in frames:
            rows = toxicity.score(df, toxicity.train(df, known, held_out=97)).collect()
            assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)


def test_simhash(frames):
    for df, n in frames:
        rows = simhash.near_duplicates(df).collect()
        assert len(rows) == n
        assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3)} <= {2}
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns and kept.count() == (6 if n else 0)


def test_tokens(frames):
    for df, n in frames:
        rows = tokens.token_counts(df, JSON, RANKS).collect()
        assert len(rows) == n and all(r["n_tokens"] == 0 for r in rows if not r["text"])


def test_decontamination(spark, frames, bench):
    for df, n in frames:
        for b in (bench, bench.limit(0)):
            bad = decontaminate.contaminated(df, b).collect()
            assert {r["doc_id"] for r in bad} == ({4, None} if n and b is bench else set())
            assert decontaminate.decontaminate(df, b).count() == n - 2 * bool(bad)


def test_language(frames):
    for df, n in frames:
        rows = langid.predict(df, langid.train(df, held_out=99)).collect()
        assert len(rows) == n
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 5))


def test_pii(frames):
    w = pii.train(40, 10)
    for df, n in frames:
        rows = pii.find(df, w).collect()
        assert len(rows) == n and all(r["spans"] == "" for r in rows)
        masked = pii.mask(df, w)
        assert masked.columns == df.columns and masked.count() == n


def test_suffixes(frames):
    for df, n in frames:
        rows = suffixes.deduplicate(df).collect()
        assert len(rows) == n
        assert all((r["n_removed"] > 0) == (r["doc_id"] == 4) for r in rows)


def test_packing(frames):
    for df, n in frames:
        rows = packing.packed(df, JSON, RANKS).collect()
        assert len({r["doc_id"] for r in rows}) == (7 if n else 0)
        assert all(r["length"] == 1 for r in rows if r["doc_id"] in (2, 3))
        places = {(r["sequence_id"], r["offset"]) for r in rows}
        assert len(places) == len(rows)


def test_media(frames):
    for df, n in frames:
        rows = media.describe(media.store_texts(df)).collect()
        assert len(rows) == n and all(r["error"] is None and r["payload_bytes"] % 64 == 0 for r in rows)


def test_warc(spark):
    for rows in ([(None, None, None), (None, "u", "x"), (1, "a\r\nb: c", "x"), (1, "u", "y")], []):
        index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
        got = warc.resolved(warc.read_records(index)).collect()
        assert len(got) == len(rows)
        assert sorted(r["record_type"] for r in got) == (["response", "response", "response", "revisit"] if rows else [])
