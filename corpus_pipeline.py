"""A training corpus in five stages, each a query plan over the table that the stage before it wrote.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Counted as part of tallyflow.llm.

Every stage takes nulls in any column, empty and very long texts and an empty table (which gives an empty one), and reads whole texts. Rows
that are repeated stay repeated, but for near_duplicates: of rows with one id and one text it keeps one, and of equal texts that with the
smallest id; rows with a null id can't be named there and stay. Columns of any other name pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm import bpe, decontam, langid, secret_scan, shingles, simhash
from tallyflow.llm.common import table, written
from tallyflow.sources.shared import importable

#: A document stays if its language has at least this calibrated probability, or more with few languages (langid.least_score): only texts that
#: the model can hardly place go.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts that are null or without letters go."""
    importable(spark)
    return langid.accepted(docs, langid.train(docs, ~langid.held_out()), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.8 or more on five-word shingles: candidates by
    SimHash and by MinHash bands beside it, verified on the whole sets."""
    importable(spark)
    return simhash.representatives(docs, find=shingles.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    importable(spark)
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars is the new length."""
    importable(spark)
    return secret_scan.redact(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that are left."""
    importable(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: Learned language scores and components have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
