"""Test-then-train on a live stream: a micro-batch is a window.

Each batch is scored on the counters of all batches before it, its scores are appended, and its own counters are written under its
number. Counters are additive but adding twice is not harmless, so a batch owns its folder (`batch=<n>`, overwritten by a retry) and a
batch reads only folders of smaller numbers: results are the same whether a batch runs once or again.

A backlog can come in micro-batches of many windows: rows then have their window's number (`slot`), and each window is scored on the
counters of all windows before it, of its own micro-batch too. A micro-batch's cost hardly depends on its number of windows.

Every COMPACT batches the folders so far are summed into one base, so a batch reads one base and few folders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import hashing, tokens
from tallyflow.operators import replay
from tallyflow.operators.models import Config, posterior, replayed_scores
from tallyflow.sources.shared import discard

COMPACT = 50
_COUNTERS = "i int, bucket bigint, s bigint, h bigint"
_TOTALS = "ns bigint, nh bigint, ts bigint, th bigint"


class StreamingModel:
    """State and output of one configuration under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, config: Config, path: str, hash_mode: str = "xxhash", compact: int = COMPACT):
        self.spark, self.config, self.path, self.hash_mode, self.compact = spark, config, path.rstrip("/"), hash_mode, compact

    def _folders(self, kind: str, batch: int) -> list[str]:
        """Of the latest base below batch, and of the batches since."""
        base = batch // self.compact * self.compact
        names = [f"{kind}-base/batch={base}"] if base else []
        return [f"{self.path}/{n}" for n in [*names, *(f"{kind}/batch={b}" for b in range(base, batch))]]

    def _state(self, kind: str, schema: str, batch: int) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        there = [p for p in self._folders(kind, batch) if (at := fs.Path(p)).getFileSystem(conf).exists(at)]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def counters(self, batch: int) -> DataFrame:
        """i, bucket, s, h of all batches below."""
        return self._state("counters", _COUNTERS, batch).groupBy("i", "bucket").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))

    def totals(self, batch: int) -> DataFrame:
        return self._state("totals", _TOTALS, batch).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ns", "nh", "ts", "th")))

    def process(self, emails: DataFrame, batch: int) -> None:
        """emails: doc_id, body, spam (and slot, where a micro-batch has many windows). For foreachBatch."""
        c = self.config
        if batch and batch % self.compact == 0:
            before = batch - self.compact
            for kind, schema, keys in (("counters", _COUNTERS, ["i", "bucket"]), ("totals", _TOTALS, [])):
                old = f"{self.path}/{kind}-base/batch={before}"
                parts = [*([old] if before else []), *(f"{self.path}/{kind}/batch={b}" for b in range(before, batch))]
                summed = self.spark.read.schema(schema).parquet(*parts).groupBy(*keys).agg(*(F.sum(x).alias(x) for x in [f.split(" ")[0] for f in schema.split(", ")] if x not in keys))
                summed.write.mode("overwrite").parquet(f"{self.path}/{kind}-base/batch={batch}")
        if "slot" in emails.columns:
            return self._windows(emails, batch)
        emails = emails.persist()
        try:
            tf = tokens.ngrams(emails, c.ngram, keep=("doc_id", "spam")).groupBy("doc_id", "spam", "ng").agg(F.count("*").alias("tf"))
            hashes = hashing.sketch_hashes(F.col("ng"), c.num_hashes, self.hash_mode) if c.num_hashes else hashing.feature_hash(F.col("ng"), self.hash_mode)
            cells = tf.select("doc_id", "spam", "ng", "tf", F.posexplode(hashes).alias("i", "hash")).select("doc_id", "spam", "ng", "tf", "i", hashing.bucket(F.col("hash"), c.log_buckets).alias("bucket"))
            seen = cells.join(self.counters(batch), ["i", "bucket"], "left").groupBy("doc_id", "ng", "tf").agg(F.min(F.coalesce("s", F.lit(0))).alias("s"), F.min(F.coalesce("h", F.lit(0))).alias("h"))
            ll = seen.groupBy("doc_id").agg(F.sum(F.col("tf") * (F.ln(F.col("h") + 1) - F.ln(F.col("s") + 1))).alias("ll"))
            grams = tokens.ngram_total(tokens.num_words(F.col("body")), c.ngram)
            docs = emails.select("doc_id", "spam", grams.alias("grams")).join(ll, "doc_id", "left").crossJoin(F.broadcast(self.totals(batch)))
            score = posterior(F.coalesce("ll", F.lit(0.0)), F.col("grams"), F.lit(c.log_buckets), *(F.col(x) for x in ("ns", "nh", "ts", "th")))
            docs.select("doc_id", "spam", F.round(score, 6).alias("score")).write.mode("overwrite").parquet(f"{self.path}/scores/batch={batch}")
            cells.groupBy("i", "bucket").agg(F.sum(F.col("tf") * F.col("spam")).alias("s"), F.sum(F.col("tf") * (1 - F.col("spam"))).alias("h")).write.mode("overwrite").parquet(f"{self.path}/counters/batch={batch}")
            one = lambda spam, what, name: F.coalesce(F.sum(F.when(F.col("spam") == spam, what)), F.lit(0)).cast("long").alias(name)
            emails.select("spam", grams.alias("grams")).agg(one(1, F.lit(1), "ns"), one(0, F.lit(1), "nh"), one(1, F.col("grams"), "ts"), one(0, F.col("grams"), "th")).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        finally:
            emails.unpersist()

    def _windows(self, emails: DataFrame, batch: int) -> None:
        if not replay.fits([self.config], self.hash_mode):
            raise ValueError("counters of this size take a micro-batch a window")
        layout, b = replay.Layout([self.config]), self.config.log_buckets
        base = np.zeros((2, layout.size), np.int64)  # of ham, then spam
        for r in self.counters(batch).toLocalIterator():
            base[:, (r.i << b) + r.bucket] = r.h, r.s
        t = self.totals(batch).first()
        base[:, layout.totals] = [[t.nh, t.th], [t.ns, t.ts]]
        rows = emails.select("doc_id", F.lit(0).cast("long").alias("seq"), F.col("spam").cast("long").alias("spam"), "slot", F.lit(True).alias("trains"), "body")
        parts = replay.parts(rows, layout, "prequential", self.hash_mode, (base[0], base[1]))
        replayed_scores(parts, layout).select("doc_id", "spam", "score", "slot").write.mode("overwrite").parquet(f"{self.path}/scores/batch={batch}")
        discard(parts)
        h, s = replay.counted(emails.select(F.col("spam").cast("long").alias("spam"), "body"), layout, self.hash_mode)
        at = np.flatnonzero((h + s)[: layout.counters])
        found = pd.DataFrame({"i": (at >> b).astype("int32"), "bucket": at & ((1 << b) - 1), "s": s[at], "h": h[at]})
        self.spark.createDataFrame(found, _COUNTERS).write.mode("overwrite").parquet(f"{self.path}/counters/batch={batch}")
        docs, grams = layout.totals
        self.spark.createDataFrame([tuple(int(x) for x in (s[docs], h[docs], s[grams], h[grams]))], _TOTALS).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")

    def windows(self) -> DataFrame:
        """slot, doc_id, spam, score so far, of micro-batches of many windows."""
        return self.spark.read.option("basePath", f"{self.path}/scores").schema("doc_id bigint, spam bigint, score double, slot bigint, batch int").parquet(f"{self.path}/scores/batch=*").drop("batch")

    def scores(self) -> DataFrame:
        """batch, doc_id, spam, score so far."""
        return self.spark.read.option("basePath", f"{self.path}/scores").schema("doc_id bigint, spam bigint, score double, batch int").parquet(f"{self.path}/scores/batch=*")

    def start(self, emails: DataFrame, **trigger):
        """The running query over a streaming DataFrame of doc_id, body, spam."""
        return emails.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
