"""A corpus pipeline over ``documents``: each stage's result is written as Parquet and read again by the next.

Defined cases, for every stage: an empty table gives an empty one; null and empty texts are rows like others (never rejected, one group of
near copies, no secrets, size 0, so the mix takes none or some of them, no tokens); repeated rows are rows of their own until one
stays of their group; very long texts are read whole; ties (a group's rows with one id and one fingerprint, places of equal size
in the mix) go to one row or by id and a hash of the text; extra columns, whatever they are called, go through to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spatiarc.llm.common import table
from spatiarc.llm.op5_bpe import encode_documents, tokenizer_path
from spatiarc.llm.op6_secrets import redact_documents
from spatiarc.llm.op7_simhash import keep_one_per_group
from spatiarc.llm.op8_toxicity import score_toxicity
from spatiarc.llm.op10_mix import mix
from spatiarc.plans.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not reject."""
    return score_toxicity(docs, table(spark, sf_dir, "labels"), keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one whose doc_id names the group."""
    return keep_one_per_group(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by a mark."""
    return redact_documents(docs, tokenizer_path())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix emits it."""
    return mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of each row."""
    return encode_documents(docs, tokenizer_path(), with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", remove_secrets),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: SQL can express neither the classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
            if i:
                scratch.drop(f"stage{i - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
