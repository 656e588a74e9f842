"""Cleans a corpus for training: toxic texts, near copies and contaminated texts go, secrets are blanked, pieces result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterglass.llm import common, dart_minhash, decontamination, secrets, sentencepiece, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't call toxic."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    rest, back = common.set_aside(docs, "score", "predicted")
    return toxicity.score(rest, model).where("predicted = 0").drop("score", "predicted").withColumnsRenamed(back).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near copies; documents without an id stay."""
    classes = dart_minhash.near_duplicates(docs)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of benchmark items."""
    added = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    rest, back = common.set_aside(docs, *added)
    found = decontamination.contamination(rest, common.table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").drop(*added).withColumnsRenamed(back).select(docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret and n_chars to match."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces) of each document."""
    rows = sentencepiece.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("sentencepiece", encode),
]

#: A trained classifier, signatures and a tokenizer are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
