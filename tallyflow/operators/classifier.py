"""A fitted classifier to keep: train, save, load, score, learn on.

Its state is the table of counters and one row of totals. Both are additive, so learning on is a sum of what was known and what the new
emails add; every update is written to the shared folder, and the classifier before it stays as it is.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import metrics, tokens
from tallyflow.operators import models
from tallyflow.operators.models import Config
from tallyflow.sources.shared import written

_COUNTERS, _TOTALS = "i int, bucket bigint, s bigint, h bigint", "ns bigint, nh bigint, ts bigint, th bigint"


@dataclass(frozen=True)
class Classifier:
    """counters: i, bucket, s, h; totals: ns, nh, ts, th (emails and n-grams of spam and ham), one row."""

    config: Config
    counters: DataFrame
    totals: DataFrame
    hash_mode: str = "xxhash"

    @classmethod
    def empty(cls, spark: SparkSession, config: Config, hash_mode: str = "xxhash") -> Classifier:
        return cls(config, spark.createDataFrame([], _COUNTERS), spark.createDataFrame([(0, 0, 0, 0)], _TOTALS), hash_mode)

    def _cells(self, emails: DataFrame) -> DataFrame:
        rows = emails.withColumns({"slot": F.lit(0).cast("long"), "trains": F.lit(True)})
        return models.units(models.occurrences(rows, self.config.ngram, [self.config], self.hash_mode), [self.config], self.config.classifier)

    def update(self, emails: DataFrame) -> Classifier:
        """The classifier that has also learned the emails (doc_id, body, spam)."""
        emails = emails.select("doc_id", "body", F.col("spam").cast("long").alias("spam"))
        new = models.counters(self._cells(emails)).select("i", "bucket", "s", "h")
        counters = self.counters.unionByName(new).groupBy("i", "bucket").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))
        sizes = emails.withColumns({"slot": F.lit(0).cast("long"), "trains": F.lit(True), "words": tokens.num_words(F.col("body"))})
        added = models.totals(sizes, [self.config.ngram], "split", 1).drop("ngram")
        totals = self.totals.unionByName(added).agg(*(F.sum(c).alias(c) for c in ("ns", "nh", "ts", "th")))
        return replace(self, counters=written(counters, "classifier"), totals=written(totals, "classifier-totals"))

    def predict(self, emails: DataFrame, digits: int | None = 6) -> DataFrame:
        """doc_id, score of each email (doc_id, body)."""
        c = self.config
        cells = self._cells(emails.select("doc_id", "body", F.lit(0).cast("long").alias("spam")))
        known = models.sized(self.counters, max(1, c.num_hashes) << c.log_buckets)
        found = cells.join(known, ["i", "bucket"], "left").withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("s", "h")})
        if c.classifier == "CM":
            found = found.groupBy("doc_id", "ng", "tf").agg(F.min("s").alias("s"), F.min("h").alias("h"))
        ll = found.groupBy("doc_id").agg(F.sum(models.log_ratio(F.col("tf"), F.col("s"), F.col("h"))).alias("ll"))
        grams = tokens.ngram_total(tokens.num_words(F.col("body")), c.ngram)
        docs = emails.select("doc_id", grams.alias("grams")).join(ll, "doc_id", "left").crossJoin(F.broadcast(self.totals))
        score = models.posterior(F.coalesce("ll", F.lit(0.0)), F.col("grams"), F.lit(c.log_buckets), *(F.col(x) for x in ("ns", "nh", "ts", "th")))
        return docs.select("doc_id", (F.round(score, digits) if digits is not None else score).alias("score"))

    def classify(self, emails: DataFrame) -> DataFrame:
        """doc_id, score, is_spam: whether the score is over the configuration's threshold."""
        return self.predict(emails).withColumn("is_spam", metrics.predicted(F.col("score"), self.config.threshold))

    @property
    def num_examples_processed(self) -> int:
        row = self.totals.first()
        return row["ns"] + row["nh"]

    def save(self, path: str) -> None:
        """Into a folder that isn't there yet."""
        spark = self.counters.sparkSession
        self.counters.write.parquet(f"{path}/counters")
        self.totals.write.parquet(f"{path}/totals")
        spark.createDataFrame([(*asdict(self.config).values(), self.hash_mode)], "classifier string, ngram int, log_buckets int, num_hashes int, threshold double, hash_mode string").write.parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        row = spark.read.parquet(f"{path}/config").first().asDict()
        mode = row.pop("hash_mode")
        return cls(Config(**row), spark.read.schema(_COUNTERS).parquet(f"{path}/counters"), spark.read.schema(_TOTALS).parquet(f"{path}/totals"), mode)
