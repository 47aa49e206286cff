"""Mail corpora in the marked text format, as DataFrames.

A line that begins with `EMAIL> ` is a header; an empty line after a header ends an email; other lines are appended to the body without
a separator. An email that no empty line ends is dropped, text before any header goes to the next email, and of several headers
the last counts. Declaratively: segments are what empty lines separate; a segment closed by one is an email if it holds a header; its
body is all text since the last email. A file is read by its lines, split by split; they are put in order by where their split begins.
An email's text may go on from one split to the next, so a file's lines meet in one task, which sorts them on disk if need be.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.operators import splits
from tallyflow.operators.running import with_sequence
from tallyflow.sources.shared import written

MARK = "EMAIL> "


def parse_lines(lines: DataFrame) -> DataFrame:
    """source, line_no, line -> source, email_no, header, body, is_spam."""
    order = Window.partitionBy("source").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blank, head = F.col("line") == "", F.col("line").startswith(MARK)
    cut = lines.withColumns({"blank": blank, "head": head}).withColumn("seg", F.coalesce(F.sum(F.col("blank").cast("long")).over(before), F.lit(0)))
    text = F.when(~F.col("blank") & ~F.col("head"), F.struct("line_no", "line"))
    segs = cut.groupBy("source", "seg").agg(F.max_by(F.when(F.col("head"), F.col("line")), F.when(F.col("head"), F.col("line_no"))).alias("header"), F.max("blank").alias("closed"), F.sort_array(F.collect_list(text)).alias("text"))
    emits = (F.col("closed") & F.col("header").isNotNull()).cast("long")
    ahead = Window.partitionBy("source").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.withColumn("emits", emits).withColumn("email_no", F.coalesce(F.sum("emits").over(ahead), F.lit(0)))
    joined = F.array_join(F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"])), lambda x: x["line"]), "")
    one = segs.groupBy("source", "email_no").agg(F.max("emits").alias("emits"), F.max(F.when(F.col("emits") == 1, F.col("header"))).alias("header"), joined.alias("body"))
    return one.where("emits = 1").select("source", "email_no", "header", "body", (F.substring("header", 14, 1) == "1").cast("long").alias("is_spam"))


def read_emails(spark: SparkSession, *paths: str) -> DataFrame:
    """Emails of text files; a path that doesn't exist is left out with a warning."""
    found = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.globStatus(at):
            found.append(p)
        else:
            print(f"warning: {p} doesn't exist and is left out")
    if not found:
        return spark.createDataFrame([], "source string, email_no long, header string, body string, is_spam long")
    lines = spark.read.text(found, lineSep="\n").select(F.col("_metadata.file_path").alias("source"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("line_no"), F.col("value").alias("line"))
    return parse_lines(lines)


def load(spark: SparkSession, paths: list[str], seed: int = 12) -> DataFrame:
    """doc_id, source, header, body, spam, seq: the emails of all corpora, in an order shuffled by the seed.

    doc_id numbers the emails by corpus, file and place; each corpus is read once, its time printed, and stays in the shared folder."""
    parts = []
    for no, path in enumerate(paths):
        began = time.perf_counter()
        part = written(read_emails(spark, path).withColumn("corpus", F.lit(no)), "corpus")
        print(f"read {part.count()} emails of {path} in {time.perf_counter() - began:.3f} s")
        parts.append(part)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    numbered = with_sequence(every, "corpus", "source", "email_no", name="doc_id")
    return splits.shuffled(numbered.select("doc_id", "source", "header", "body", F.col("is_spam").alias("spam")), seed)


def profile(emails: DataFrame, *by: str) -> DataFrame:
    """num_emails, num_spam, spam_percent."""
    return emails.groupBy(*by).agg(F.count("*").alias("num_emails"), F.coalesce(F.sum("spam"), F.lit(0)).cast("long").alias("num_spam"), (100 * F.avg("spam")).alias("spam_percent"))
