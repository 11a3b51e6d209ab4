"""The document pipeline: toxicity, near-duplicates, benchmark leaks, then token ids.

Every stage takes the documents that the stage before kept, whole, and its decisions
take effect: all but the last return the columns of documents, the last one encodes.
Near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more.  Their candidates are found by fingerprints of 128 bits over single distinct
words, where such texts differ in fewer bits than by five-word shingles: up to 15.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, sentencepieces, simhash, toxicity
from lattica.llm.queries import PIECES_FILE
from lattica.session import cut, table

NEAR = simhash.Params(shingle=1, distance=15, bits=128, distinct=True, similarity=0.8, compared=5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't reject."""
    model = toxicity.train(docs, toxicity.grades_of(table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.keep_first(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and decoded_sha256."""
    return sentencepieces.encode(docs, PIECES_FILE)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("sentencepiece", encode)]
#: A model's decisions and a segmentation search aren't SQL; brute-force tests stand for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each one's output written before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
