"""Streams, splits and folds as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.running import with_sequence


def shuffled(emails: DataFrame, seed: int = 12, id_col: str = "doc_id") -> DataFrame:
    """A reproducible order: seq by md5 of seed and id (ties by id)."""
    return with_sequence(emails.drop("seq").withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))), "_key", id_col).drop("_key")


def windows(emails: DataFrame, size: int) -> DataFrame:
    """slot: the number of the tumbling count window."""
    return emails.withColumn("slot", F.floor(F.col("seq") / size).cast("long"))


def _in_class(emails: DataFrame) -> DataFrame:
    """in_class: 0-based position among the emails of the same class; class_size."""
    ranked = [with_sequence(emails.where(F.col("spam") == c).select("doc_id", "seq"), "seq", name="in_class") for c in (0, 1)]
    both = ranked[0].unionByName(ranked[1])
    sizes = emails.groupBy("spam").agg(F.count("*").alias("class_size"))
    return emails.join(both.select("doc_id", "in_class"), "doc_id").join(F.broadcast(sizes), "spam")


def stratified(emails: DataFrame, share: float = 0.8) -> DataFrame:
    """split: "dev" for the first floor(share n) emails of each class in stream order, else "test"."""
    dev: Column = F.col("in_class") < F.floor(F.lit(share) * F.col("class_size"))
    return _in_class(emails).withColumn("split", F.when(dev, "dev").otherwise("test")).drop("in_class", "class_size")


def folds(emails: DataFrame, k: int = 5) -> DataFrame:
    """slot: the fold, dealt out in turn along the stream."""
    return emails.withColumn("slot", F.pmod("seq", F.lit(k)).cast("long"))
