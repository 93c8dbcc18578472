"""A training corpus from documents: toxic ones go, one of each group of near copies stays, sources are mixed to
target weights, and the whole is packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import mixing, ngram_join, packing, toxicity
from strandex.llm.common import table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(*toxicity.training_texts(docs, table(spark, sf_dir, "labels")))
    score = "score" + "_" * max(map(len, docs.columns))  # longer than any name there is
    scored = toxicity.toxicity(docs, model, out=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is lost: the budget is the smallest that takes each once, and small sources come up to twice. Rows
    stand in the order of epochs and their permuted blocks; within a block, in a pseudo-random one."""
    rows, _ = mixing.mixture(docs, entropy=0.95, repetition=2.0)
    return rows.orderBy("epoch", "turn", F.xxhash64("row.doc_id", "row.text")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("near_copies", no_near_copies), ("mixing", mixed), ("packing", packed)]
#: SQL expresses none of the string kernel, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
