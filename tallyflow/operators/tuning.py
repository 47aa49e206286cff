"""Model search and experiments over grids of configurations, as aggregations of one table of predictions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import metrics
from tallyflow.operators import curves, models, replay, splits
from tallyflow.operators.models import CONFIG, Config
from tallyflow.sources.shared import discard, written

METRICS = ("recall_at_fpr_001", "recall_at_fpr_0001", "auc", "recall_at_prec_99", "recall_at_prec_95", "brier_score")
KEYS = list(CONFIG)


def cumulative(preds: DataFrame, keys: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """keys, slot, num_examples, tp, fp, tn, fn and rates after each window, over all windows so far."""
    per = preds.groupBy(*keys, "slot").agg(F.count("*").alias("n"), *metrics.confusion(F.col("spam"), metrics.predicted(F.col("score"), threshold)))
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    so_far = per.select(*keys, "slot", F.sum("n").over(w).cast("long").alias("num_examples"), *(F.sum(c).over(w).cast("long").alias(c) for c in metrics.CONFUSION))
    return metrics.rates(so_far)


def final_metrics(preds: DataFrame, keys: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """keys, tp, fp, tn, fn and rates over all predictions: the last row of `cumulative`."""
    return metrics.rates(preds.groupBy(*keys).agg(*metrics.confusion(F.col("spam"), metrics.predicted(F.col("score"), threshold))))


def folds_and_in_sample(emails: DataFrame, configs: list[Config], k: int = 5, hash_mode: str = "md5") -> tuple[DataFrame, DataFrame]:
    """Predictions for `cross_validation`, and for `tuned` and `chosen_curves`, in one pass over the emails."""
    return models.score_folds_and_in_sample(splits.folds(emails, k), configs, hash_mode)


def cross_validation(emails: DataFrame, configs: list[Config], k: int = 5, hash_mode: str = "md5", preds: DataFrame | None = None) -> DataFrame:
    """Configuration, fold and its metrics. Each fold's model is the total less the fold: nothing is trained twice."""
    preds = preds or models.score(splits.folds(emails, k), configs, "folds", hash_mode=hash_mode)
    return curves.cv_metrics(preds.withColumnRenamed("slot", "fold"), [*KEYS, "fold"])


def averaged(cv: DataFrame) -> DataFrame:
    """Mean of each metric over folds."""
    return cv.groupBy(*KEYS).agg(*(F.avg(m).alias(m) for m in METRICS))


def select_best(avg: DataFrame, digits: int = 9) -> DataFrame:
    """optimized_for, configuration, value: the best of each classifier by each metric (the least Brier score), the first in grid order of equals."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(m).alias("optimized_for"), F.round(1 - F.col(m) if m == "brier_score" else F.col(m), digits).alias("value")) for i, m in enumerate(METRICS))))
    rows = avg.select(*KEYS, each.alias("x")).select(*KEYS, "x.*")
    best = Window.partitionBy("classifier", "optimized_for").orderBy(F.desc("value"), "ngram", "log_buckets", "num_hashes")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "no")


def _in_sample(emails: DataFrame, configs: list[Config], hash_mode: str) -> DataFrame:
    return models.score(emails.withColumn("slot", F.lit(0).cast("long")), configs, "in_sample", hash_mode=hash_mode)


def in_sample(emails: DataFrame, configs: list[Config], hash_mode: str = "md5") -> DataFrame:
    """Predictions for the emails that also train, for `tuned` and `chosen_curves`."""
    return written(_in_sample(emails, configs, hash_mode), "in-sample")


def chosen_curves(emails: DataFrame, chosen: DataFrame, configs: list[Config], hash_mode: str = "md5", preds: DataFrame | None = None) -> DataFrame:
    """optimized_for, configuration and the thinned curve points of each chosen one on the emails that also train."""
    wanted = chosen.select("optimized_for", *KEYS)
    preds = (preds or _in_sample(emails, configs, hash_mode)).join(F.broadcast(wanted.select(*KEYS).distinct()), KEYS, "left_semi")  # a row a metric and classifier
    return wanted.join(curves.curve_points(preds, KEYS), KEYS)


def stream_curves(emails: DataFrame, configs: list[Config], size: int = 1, hash_mode: str = "md5") -> DataFrame:
    """Configuration and the thinned curve points of the whole stream, test-then-train."""
    return curves.curve_points(models.score(splits.windows(emails, size), configs, hash_mode=hash_mode), KEYS)


def held_out(emails: DataFrame, configs: list[Config], threshold: float | Column = 0.5, hash_mode: str = "md5") -> DataFrame:
    """Configuration, tp, fp, tn, fn and rates over the emails that don't train (`trains` false), scored by those that do."""
    preds = models.score(emails.withColumn("slot", F.lit(0).cast("long")), configs, "split", hash_mode=hash_mode)
    return final_metrics(preds, KEYS, threshold)


def tuned(emails: DataFrame, chosen: DataFrame, configs: list[Config], hash_mode: str = "md5", preds: DataFrame | None = None) -> DataFrame:
    """optimized_for, configuration, best threshold and metrics on the emails that also train (in-sample)."""
    preds = preds or _in_sample(emails, configs, hash_mode)
    return chosen.select("optimized_for", *KEYS).join(curves.best_threshold(preds, KEYS), KEYS)


def evaluated(emails: DataFrame, final: DataFrame, configs: list[Config], dev: DataFrame | None = None, hash_mode: str = "md5", reorder: bool = True) -> DataFrame:
    """final's rows with test metrics at their thresholds. Cold start: the model begins empty and learns the test emails one by one; with
    `dev`, it is trained on those and doesn't learn on. The stream goes by doc_id, or by seq (0, 1, ...) if not `reorder`."""
    if dev is None:
        order = splits.with_sequence(emails.drop("seq"), "doc_id") if reorder else emails
        preds = models.score(splits.windows(order, 1), configs, hash_mode=hash_mode)
    else:
        both = emails.withColumn("trains", F.lit(False)).unionByName(dev.withColumn("trains", F.lit(True))).withColumn("slot", F.lit(0).cast("long"))
        preds = models.score(both, configs, "split", hash_mode=hash_mode)
    rates = ("precision", "recall", "f1", "f05", "accuracy")
    given = final.select("optimized_for", *KEYS, "threshold", *(F.col(r).alias(f"dev_{r}") for r in rates))
    scored = preds.join(F.broadcast(given.select("optimized_for", *KEYS, "threshold")), KEYS)
    test = final_metrics(scored, ["optimized_for", *KEYS], F.col("threshold"))
    return given.join(test.select("optimized_for", *KEYS, *(F.col(r).alias(f"test_{r}") for r in (*rates, "fpr", "fnr"))), ["optimized_for", *KEYS])


def learning_curves(emails: DataFrame, configs: list[Config], sizes: list[int], hash_mode: str = "md5", final: DataFrame | None = None) -> DataFrame:
    """window, configuration, step, num_examples and rates for each window size. If counters fit in a worker, all sizes are scored in one
    pass over the texts; else n-grams are taken and hashed once.

    `final` (optimized_for, configuration, threshold; a few rows) gives curves at its thresholds, with these columns."""
    keys = [*KEYS, *(["optimized_for", "threshold"] if final is not None else [])]
    if fits := replay.fits(configs, hash_mode):
        stream = replay.in_order(emails.select("doc_id", "body", "spam", "seq"))
        scored = models.score_windows(stream, configs, sizes, hash_mode)
    else:
        each = emails.withColumns({"slot": F.col("seq"), "trains": F.lit(True)})
        stream, occ = emails, written(models.occurrences(each, max(c.ngram for c in configs), configs, hash_mode), "occurrences")
    out = None
    for size in sizes:
        preds = scored[size] if fits else models.score(splits.windows(stream, size), configs, hash_mode=hash_mode, occ=occ.withColumn("slot", F.floor(F.col("slot") / size).cast("long")))
        if final is not None:
            preds = preds.join(F.broadcast(final.select("optimized_for", *KEYS, "threshold")), KEYS)
        rows = cumulative(preds, keys, 0.5 if final is None else F.col("threshold")).select(F.lit(size).alias("window"), *keys, F.col("slot").alias("step"), "num_examples", *metrics.RATES)
        out = rows if out is None else out.unionByName(rows)
    if fits:
        discard(stream)
    return out


def sweep(emails: DataFrame, configs: list[Config], size: int = 1, hash_mode: str = "md5", preds: DataFrame | None = None) -> DataFrame:
    """Configuration and rates of the whole stream, test-then-train, threshold 0.5."""
    return final_metrics(preds or models.score(splits.windows(emails, size), configs, hash_mode=hash_mode), KEYS)


def calibration(emails: DataFrame, configs: list[Config], size: int = 1, hash_mode: str = "md5", preds: DataFrame | None = None) -> DataFrame:
    """Configuration, brier_score, brier_score_scaled, log_loss of the stream."""
    preds = preds or models.score(splits.windows(emails, size), configs, hash_mode=hash_mode)
    one = preds.groupBy(*KEYS).agg(metrics.brier(F.col("score"), F.col("spam")).alias("brier_score"), metrics.log_loss(F.col("score"), F.col("spam")).alias("log_loss"), F.avg("spam").alias("_rate"))
    return one.select(*KEYS, "brier_score", metrics.brier_skill(F.col("brier_score"), F.col("_rate")).alias("brier_score_scaled"), "log_loss")


def best_by_f05(swept: DataFrame, digits: int = 9) -> DataFrame:
    """The row of largest F0.5 of each classifier, the first in grid order of equals."""
    best = Window.partitionBy("classifier").orderBy(F.desc(F.round("f05", digits)), "ngram", "log_buckets", "num_hashes")
    return swept.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def timing(emails: DataFrame, configs: list[Config], size: int = 200, hash_mode: str = "xxhash") -> DataFrame:
    """Configuration, total_time_s, time_per_email_ms of test-then-train over the stream, one configuration after the other."""
    stream = written(splits.windows(emails, size), "timed")
    n, rows = stream.count(), []
    for c in configs:
        began = time.perf_counter()
        cumulative(models.score(stream, [c], hash_mode=hash_mode), KEYS).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        rows.append((c.classifier, c.ngram, c.log_buckets, c.num_hashes, took, 1000 * took / max(n, 1)))
    return emails.sparkSession.createDataFrame(rows, "classifier string, ngram int, log_buckets int, num_hashes int, total_time_s double, time_per_email_ms double")
