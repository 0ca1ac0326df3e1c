"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, packing, pii, simhash, toxicity
from plumbline.llm.common import discard, stored
from plumbline.llm.queries import vocabulary


# All stages: rows with a null doc_id or text go through like others; rows that repeat a doc_id share its fate (of repeated
# rows near_duplicates keeps one); an empty table gives an empty one; extra columns stay as they are, whatever their names.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity classifier does not call toxic. It learns from `labels` and the documents
    given; null and empty texts count as texts without any feature, and stay unless most labels are toxic."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each SimHash class, and one row of it. Null and empty texts have
    fingerprint 0 and so are one class; a row with a null doc_id stays only in a class of nulls."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a verified overlap with the benchmark. Null and empty texts have none; null items and
    an empty benchmark match nothing; a doc_id that repeats goes if any of its texts overlaps, null like any other."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text by its kind; n_chars, where there is one, follows. A null text stays null and keeps
    its n_chars; no row goes."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens; a null or empty text is its end token alone,
    and each of repeated rows has a place of its own."""
    return packing.packed(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Classifier, fingerprints, random field and tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between two stages is written to the shared folder, and deleted once the next
    stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
