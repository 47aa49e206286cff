"""CSV sinks and sources of the result tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONFIG = "classifier string, ngram int, log_buckets int, num_hashes int"
_RATES = "{0}precision double, {0}recall double, {0}f1 double, {0}f05 double, {0}accuracy double"
_COUNTS = "threshold double, tp bigint, fp bigint, tn bigint, fn bigint"

# Long names of the classifiers in published result tables.
CLASSIFIERS = {"FeatureHashing": "FH", "CountMin": "CM"}

#: The result tables' columns.
SCHEMAS = {
    "cv_results": f"{_CONFIG}, fold bigint, recall_at_fpr_001 double, recall_at_fpr_0001 double, auc double, recall_at_prec_99 double, recall_at_prec_95 double, brier_score double",
    "pr_curve": f"{_CONFIG}, optimized_for string, {_COUNTS}, precision double, recall double, f1 double, f05 double, accuracy double",
    "roc_curve": f"{_CONFIG}, optimized_for string, {_COUNTS}, tpr double, fpr double, accuracy double",
    "final_configs": f"{_CONFIG}, optimized_for string, best_threshold double, f05 double, precision double, recall double, f1 double, accuracy double",
    "evaluation_results": f"{_CONFIG}, optimized_for string, threshold double, {_RATES.format('test_')}, test_fpr double, test_fnr double, {_RATES.format('dev_')}",
    "learning_curves": f"classifier string, window int, ngram int, log_buckets int, num_hashes int, optimized_for string, threshold double, step bigint, num_examples bigint, accuracy double, precision double, recall double, f1 double, f05 double, fpr double, fnr double",
    "timing_results": f"{_CONFIG}, total_time_s double, time_per_email_ms double",
    "parameter_sweep": f"{_CONFIG}, precision double, recall double, f1 double, f05 double, accuracy double, fpr double, fnr double",
    "brier_scores": f"{_CONFIG}, optimized_for string, threshold double, brier_score double, brier_score_scaled double, log_loss double",
}


def write_csv(df: DataFrame, path: str, table: str | None = None) -> None:
    """With a header; of a known table its columns in their order (those that df has not are null)."""
    if table:
        have = {c.lower() for c in df.columns}
        fields = [f.strip().split(" ") for f in SCHEMAS[table].split(",")]
        df = df.selectExpr(*(n if n in have else f"cast(null AS {t}) AS {n}" for n, t in fields))
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The table, or None with a warning if nothing is at the path. Long names of classifiers become short ones."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        print(f"warning: {path} doesn't exist and is left out")
        return None
    rows = spark.read.schema(SCHEMAS[table]).csv(path, header=True)
    short = F.coalesce(*(F.when(F.col("classifier") == long, F.lit(s)) for long, s in CLASSIFIERS.items()), F.col("classifier"))
    return rows.withColumn("classifier", short)
