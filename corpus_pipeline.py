"""A pipeline from raw documents to token ids: classify, judge, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes and reads back. The first four return the columns
of their input, whatever their names and however many; rows they drop are gone for the next. Columns that are used: doc_id, text and source of documents, doc_id and quality of labels.

Defined cases: a null or blank text is judged by the classifier like others (its features are 0), and fails the base rules, so it goes with the second stage at the latest;
in the mix a document without words is never taken. A null doc_id is an ordinary value, last in order: of near copies the one with the smallest id stays. Rows that repeat are judged alike; of rows that repeat
an id and its words one stays in the third stage; what the mix takes of rows that repeat an id, source and size is shared among them. A null source is a source of its own. Texts of any length pass whole. Without labels of
both kinds the classifier gives all documents one score. Empty tables give empty tables, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoframe.llm import bpe, mixing, near_dup, quality_model, quality_rules
from cytoframe.llm.common import discard, load, settle


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, accepts."""
    return quality_model.keep_good(docs, load(spark, sf_dir, "labels"))


def judge_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the weakly supervised rules hold for good."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole document."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix."""
    return bpe.encode_documents(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", judge_rules),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
#: A fitted classifier, expectation-maximisation and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{i}")
        if before is not None:
            discard(before)
        before = docs
    return docs
