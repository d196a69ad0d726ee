"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as Parquet in the shared
folder and reads them back as the next one's input. All but the last return the columns of documents.

Defined results, for every stage: null texts count as empty and stay null; rows that repeat an id or have none are each
treated by their own text; a table without rows gives none; columns beside doc_id and text are carried along, and
n_chars, where there is one, follows a text that is redacted; without labels no document counts as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageforge.llm import decontaminate, packing, pii, simhash, toxicity
from pageforge.llm.common import forget, materialize, table
from pageforge.llm.queries import vocabulary
from pageforge.storage import scratch


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents, rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, the one with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in a training sequence."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: A classifier, tokenizer and fingerprints can't be written in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # what a stage stored on its way goes with it
            last, docs = docs, keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        forget(last)
    return docs
