"""All experiments over a labelled corpus, from emails to result tables in CSV.

    python -m tallyflow --out DIR [--seed N] MAIL_FILE ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import metrics
from tallyflow.operators import curves, models, splits, tuning
from tallyflow.operators.models import Config
from tallyflow.sources import corpus
from tallyflow.sources.csvfiles import write_csv
from tallyflow.sources.shared import written

KEYS = tuning.KEYS
#: The search grid: 90 configurations.
SEARCH = models.grid([1, 2, 3], [10, 12, 14, 16, 18, 20], [2, 3, 4, 5])
#: What is timed: 48 configurations.
TIMED = models.grid([1, 2, 3], [10, 12, 14, 16], [2, 3, 4])
CURVE_SIZES = [200, 500, 1000, 2000]


def search(emails: DataFrame, configs: list[Config], out: str | None = None, hash_mode: str = "xxhash", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The tuned configurations with their thresholds, and their evaluation on the test part.

    Development and test parts are shuffled by the seed before folds are dealt out and test emails are streamed. Tables of all steps go to
    `out`, if given."""
    parted = written(splits.stratified(emails), "split")
    dev, test = (splits.shuffled(parted.where(F.col("split") == s).drop("split"), seed) for s in ("dev", "test"))
    cv = written(tuning.cross_validation(dev, configs, hash_mode=hash_mode), "cv")
    chosen = written(tuning.select_best(tuning.averaged(cv)), "chosen")
    learned = tuning.in_sample(dev, configs, hash_mode)
    final = written(tuning.tuned(dev, chosen, configs, hash_mode, learned), "tuned")
    tested = written(tuning.evaluated(test, final, configs, hash_mode=hash_mode, reorder=False), "evaluated")
    if out:
        points = written(tuning.chosen_curves(dev, chosen, configs, hash_mode, learned), "curves")
        write_csv(cv, f"{out}/cv_results.csv", "cv_results")
        write_csv(final.withColumnRenamed("threshold", "best_threshold"), f"{out}/final_configs.csv", "final_configs")
        write_csv(curves.pr_table(points), f"{out}/pr_curve.csv", "pr_curve")
        write_csv(curves.roc_table(points), f"{out}/roc_curve.csv", "roc_curve")
        write_csv(tested, f"{out}/evaluation_results.csv", "evaluation_results")
    return final, tested


def run(emails: DataFrame, out: str, configs: list[Config] = SEARCH, timed: list[Config] = TIMED, sizes: list[int] = CURVE_SIZES, hash_mode: str = "xxhash") -> DataFrame:
    """Writes every result table under `out`; returns the evaluation. emails: doc_id, body, spam, seq."""
    corpus.profile(emails).write.mode("overwrite").csv(f"{out}/corpus_profile.csv", header=True)
    final, tested = search(emails, configs, out, hash_mode)
    few = final.select("optimized_for", *KEYS, "threshold")
    own = [Config(*r) for r in sorted(tuple(r) for r in few.select(*KEYS).distinct().collect())]  # two classifiers by six metrics at most
    write_csv(tuning.learning_curves(emails, own, sizes, hash_mode, few), f"{out}/learning_curves.csv", "learning_curves")
    if timed:
        write_csv(tuning.timing(emails, timed, hash_mode=hash_mode), f"{out}/timing_results.csv", "timing_results")
    stream = written(models.score(splits.windows(emails, 1), configs, hash_mode=hash_mode), "stream-scores")
    write_csv(tuning.sweep(emails, configs, preds=stream), f"{out}/parameter_sweep.csv", "parameter_sweep")
    brier = tuning.calibration(emails, own, preds=stream.join(F.broadcast(few.select(*KEYS).distinct()), KEYS, "left_semi"))
    write_csv(few.join(F.broadcast(brier), KEYS), f"{out}/brier_scores.csv", "brier_scores")
    return tested


def confusion_at_half(preds: DataFrame) -> DataFrame:
    """Confusion counts and rates of all predictions at threshold 0.5."""
    return metrics.rates(preds.agg(*metrics.confusion(F.col("spam"), metrics.predicted(F.col("score")))))
