"""The training-data pipeline over documents: five stages, each of which works on all that its predecessor kept.

quality       documents that the compression classifier rejects go.
line_dedup    lines that three documents or more share go, but for the document with the largest id.
near_dups     one document of each component of n-gram links stays, that with the smallest id. Five words a shingle, 0.8.
decontaminate documents that hold a benchmark passage go.
encode        byte-level BPE: doc_id, ids_sha256, decoded_sha256, n_tokens, n_bytes, round_trip.

Every stage but the last returns the columns of documents, extra ones included, whatever their names.

Defined results: a document with a null text is judged as an empty one and keeps its null; a document that line dedup leaves
without a line keeps its row, with an empty text; documents without words are no copies of each other and all stay. Rows
without an id are rows like others: in line dedup they are one document, below all others; in near_dups each is told
apart by its text. Repeated rows are copies, of which near_dups keeps one; where one id has several texts, each is judged
apart. Ties go to the largest id in line dedup and to the smallest in near_dups, and of one id's texts to the one with the
smaller hash. Without labels that tell good from bad, quality keeps or rejects all by the share of good labels; an empty
benchmark rejects nothing; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_classifier
from quirefold.llm.common import dropped, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, words=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(docs, *byte_bpe.public_vocabulary())


STAGES = [
    ("quality", quality),
    ("line_dedup", dedup_lines),
    ("near_dups", near_dups),
    ("decontaminate", without_benchmarks),
    ("encode", encode),
]

#: SQL can express neither the classifier nor the alignment nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again. A stage's table goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            dropped(*before)
            before = [docs]
    return docs
