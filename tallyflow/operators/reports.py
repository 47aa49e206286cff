"""Reports over result tables: the tidy tables behind each plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import metrics

KEYS = ("classifier", "ngram", "log_buckets", "num_hashes")


def config_label(df: DataFrame, name: str = "label") -> DataFrame:
    """A readable name of each row's configuration."""
    fh = F.format_string("FH n=%d b=2^%d", "ngram", "log_buckets")
    cm = F.format_string("CM n=%d b=2^%d d=%d", "ngram", "log_buckets", "num_hashes")
    return df.withColumn(name, F.when(F.col("classifier") == "FH", fh).otherwise(cm))


def configs_of(df: DataFrame) -> DataFrame:
    return df.select(*KEYS).distinct()


def only_configs(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose configuration is among the wanted."""
    return df.join(wanted.select(*KEYS).distinct(), list(KEYS), "left_semi")


def pivot_by_buckets(df: DataFrame, value: str, log_buckets: list[int]) -> DataFrame:
    """classifier, ngram, one column b<log_buckets> with the mean of value. Columns are given, so no pass looks for them."""
    named = df.withColumn("_b", F.concat(F.lit("b"), F.col("log_buckets").cast("string")))
    return named.groupBy("classifier", "ngram").pivot("_b", [f"b{b}" for b in log_buckets]).agg(F.avg(value))


def by_dimension(df: DataFrame, values: list[str]) -> DataFrame:
    """dimension, classifier, level, n, and mean and sample deviation of each value by each of ngram, log_buckets, num_hashes: one
    pass by grouping sets. A deviation of one row is null."""
    sets = [["classifier", d] for d in ("ngram", "log_buckets", "num_hashes")]
    stats = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"std_{v}"))]
    rows = df.groupingSets(sets, "classifier", "ngram", "log_buckets", "num_hashes").agg(F.grouping_id("classifier", "ngram", "log_buckets", "num_hashes").alias("_g"), F.count("*").alias("n"), *stats)
    dimension = F.when(F.col("_g") == 3, "ngram").when(F.col("_g") == 5, "log_buckets").otherwise("num_hashes")
    return rows.select(dimension.alias("dimension"), "classifier", F.coalesce("ngram", "log_buckets", "num_hashes").cast("long").alias("level"), "n", *(c for v in values for c in (f"mean_{v}", f"std_{v}")))


def sizes(df: DataFrame) -> DataFrame:
    """df with buckets, and dimension: counters of a class."""
    b = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("log_buckets"))
    return df.withColumn("buckets", b).withColumn("dimension", b * F.greatest(F.col("num_hashes"), F.lit(1)))


def space_usage(spark: SparkSession, low: int = 8, high: int = 21, depths: tuple[int, ...] = (0, 2, 3, 4, 5), counter_bytes: int = 8) -> DataFrame:
    """classifier, num_hashes, log_buckets, bytes of the two classes' counters."""
    rows = spark.range(low, high + 1).select(F.col("id").cast("int").alias("log_buckets"), F.explode(F.array(*map(F.lit, depths))).alias("num_hashes"))
    size = F.call_function("shiftleft", F.lit(2 * counter_bytes).cast("long"), F.col("log_buckets")) * F.greatest(F.col("num_hashes"), F.lit(1))
    return rows.select(F.when(F.col("num_hashes") == 0, "FH").otherwise("CM").alias("classifier"), "num_hashes", "log_buckets", size.alias("bytes"))


def best_and_worst(df: DataFrame, value: str) -> DataFrame:
    """kind, configuration, value: the best and the worst row, grid order deciding between equals."""
    key = F.struct(F.when(F.col("classifier") == "FH", 0).otherwise(1), "ngram", "log_buckets", "num_hashes")
    row = F.struct(*KEYS, value)
    v = F.round(value, 9)
    one = df.agg(F.min_by(row, F.struct((-v).alias("v"), key.alias("k"))).alias("best"), F.min_by(row, F.struct(v.alias("v"), key.alias("k"))).alias("worst"))
    return one.select(F.explode(F.array(F.struct(F.lit("best").alias("kind"), F.col("best").alias("r")), F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("r")))).alias("x")).select("x.kind", "x.r.*")


def dev_test_gap(evaluated: DataFrame, limit: float = 0.05) -> DataFrame:
    """optimized_for, configuration, gap (test F0.5 less dev F0.5), overfits: whether it is under -limit."""
    gap = F.col("test_f05") - F.col("dev_f05")
    return evaluated.select("optimized_for", *KEYS, gap.alias("gap"), (gap < -limit).alias("overfits"))


def learning_curve_slice(curves: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The curves of the wanted configurations at one window size, in order of examples seen."""
    return only_configs(curves.where(F.col("window") == window), wanted).orderBy(*KEYS, "num_examples")


def baseline_precision(emails: DataFrame) -> DataFrame:
    """baseline_precision: what calling every email spam would have, the share of spam."""
    return emails.agg(F.avg("spam").alias("baseline_precision"))


def curve_auc(points: DataFrame, keys: list[str]) -> DataFrame:
    """Area under thinned ROC points by trapezoids between neighbours in order of the false positive rate."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("fpr", "recall")
    step = (F.col("fpr") - F.lag("fpr", 1, 0.0).over(w)) * (F.col("recall") + F.lag("recall", 1, 0.0).over(w)) / 2
    return points.select(*keys, step.alias("_s")).groupBy(*keys).agg(F.sum("_s").alias("auc"))


def collision_rate(counts: DataFrame) -> DataFrame:
    """distinct n-grams, buckets in use, and the share of n-grams that share a bucket, of (ng, bucket) rows."""
    per = counts.groupBy("bucket").agg(F.count("*").alias("n"))
    one = per.agg(F.sum("n").alias("distinct_ngrams"), F.count("*").alias("used_buckets"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("_shared"))
    return one.select("distinct_ngrams", "used_buckets", metrics.ratio(F.col("_shared"), F.col("distinct_ngrams"), 0.0).alias("collision_rate"))
