"""The emails of the test tables: labelled documents, spam meaning toxic, in order of doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.running import with_sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(spark: SparkSession, sf_dir: str, spam_col: str = "toxic") -> DataFrame:
    """doc_id, body, spam, seq. Positions are taken over ids alone; texts are joined to them afterwards.

    By a merge join whatever their size: what is shuffled then grows with the input and not by a jump."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(spam_col).cast("long").alias("spam")).where("spam IS NOT NULL")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    order = with_sequence(texts.select("doc_id").join(labels, "doc_id"), "doc_id")
    return texts.join(order.hint("merge"), "doc_id").select("doc_id", "body", "spam", "seq")
