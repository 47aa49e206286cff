"""ROC and precision-recall sweeps, threshold search.

In tie mode "row" every prediction is a point, ties in order of doc_id; in "group" every distinct score is. Predictions: key
columns, doc_id, spam, score (rounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import metrics
from tallyflow.operators.running import ranked_running
from tallyflow.sources.shared import written

#: The threshold grid 0.10, 0.11, ... 0.89.
THRESHOLDS = [i / 100 for i in range(10, 90)]


def roc_points(preds: DataFrame, keys: list[str], tie_mode: str = "row") -> DataFrame:
    """keys, doc_id, spam, score, rn, tp, fp, positives, negatives, tpr, fpr, precision. Rates are null where a class is empty.

    Predictions, a short row for each email, are written once: several sums are taken of them."""
    preds = written(preds.select(*keys, "doc_id", "spam", "score"), "predictions")
    sizes = preds.groupBy(*keys).agg(F.sum("spam").alias("positives"), F.sum(1 - F.col("spam")).alias("negatives"))
    if tie_mode == "row":
        points = ranked_running(preds.select(*keys, "doc_id", "spam", "score", (1 - F.col("spam")).alias("ham")), keys, "score", "doc_id", ["spam", "ham"])
    else:
        w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        by = preds.groupBy(*keys, "score").agg(F.max("doc_id").alias("doc_id"), F.sum("spam").alias("spam"), F.sum(1 - F.col("spam")).alias("ham"))
        points = by.withColumns({"rn": F.row_number().over(w).cast("long"), "cum_spam": F.sum("spam").over(w), "cum_ham": F.sum("ham").over(w)})
    points = points.join(F.broadcast(sizes), keys) if keys else points.crossJoin(F.broadcast(sizes))
    tp, fp = F.col("cum_spam"), F.col("cum_ham")
    rate = lambda a, b: a / F.when(F.col(b) == 0, None).otherwise(F.col(b))
    return points.select(*keys, "doc_id", "spam", "ham", "score", "rn", tp.alias("tp"), fp.alias("fp"), "positives", "negatives", rate(tp, "positives").alias("tpr"), rate(fp, "negatives").alias("fpr"), (tp / (tp + fp)).alias("precision"))


def cv_metrics(preds: DataFrame, keys: list[str], tie_mode: str = "row") -> DataFrame:
    """keys, auc, recall_at_fpr_001, recall_at_fpr_0001, recall_at_prec_99, recall_at_prec_95, brier_score.

    AUC by trapezoids from (0, 0); recall at a false positive rate is that of the first point that reaches it; with one class only all but
    the Brier score are 0."""
    preds = written(preds.select(*keys, "doc_id", "spam", "score"), "predictions")
    p = roc_points(preds, keys, tie_mode)
    tpr, fpr = F.col("tpr"), F.col("fpr")
    back_t, back_f = (F.col("tp") - F.col("spam")) / F.nullif(F.col("positives"), F.lit(0)), (F.col("fp") - F.col("ham")) / F.nullif(F.col("negatives"), F.lit(0))
    at = lambda t: F.coalesce(F.min(F.when(fpr >= t, tpr)), F.max(tpr), F.lit(0.0))
    over = lambda t: F.coalesce(F.max(F.when((F.col("precision") >= t) & fpr.isNotNull(), tpr)), F.lit(0.0))
    one = p.groupBy(*keys).agg(
        F.coalesce(F.sum((fpr - back_f) * (tpr + back_t) / 2), F.lit(0.0)).alias("auc"),
        at(0.01).alias("recall_at_fpr_001"),
        at(0.001).alias("recall_at_fpr_0001"),
        over(0.99).alias("recall_at_prec_99"),
        over(0.95).alias("recall_at_prec_95"),
        F.max(F.when(fpr.isNotNull() & tpr.isNotNull(), 1)).alias("_both"),
    )
    one = one.withColumns({c: F.when(F.col("_both") == 1, F.col(c)).otherwise(0.0) for c in one.columns if c not in keys and c != "_both"}).drop("_both")
    b = preds.groupBy(*keys).agg(metrics.brier(F.col("score"), F.col("spam")).alias("brier_score"))
    return one.join(b, keys) if keys else one.crossJoin(b)


def curve_points(preds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold, tp, fp, tn, fn and rates at the first and last prediction and wherever the next one's class differs.

    The next class is looked up within spans of ties, and across them through one row a span."""
    p = roc_points(preds, keys)
    w = Window.partitionBy(*keys, "score", "_span").orderBy("rn")
    cut = p.withColumn("_span", F.floor(F.col("doc_id") / (1 << 16)))
    heads = cut.groupBy(*keys, "score", "_span").agg(F.min_by("spam", "rn").alias("_head"))
    heads = heads.withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy(F.desc("score"), "_span"))).drop("_head")
    cut = cut.join(heads, [*keys, "score", "_span"]).withColumn("_next", F.coalesce(F.lead("spam").over(w), "_next_head"))
    kept = cut.where((F.col("rn") == 1) | F.col("_next").isNull() | (F.col("_next") != F.col("spam"))).where("positives > 0 AND negatives > 0")
    kept = kept.select(*keys, "rn", F.col("score").alias("threshold"), "tp", "fp", (F.col("negatives") - F.col("fp")).alias("tn"), (F.col("positives") - F.col("tp")).alias("fn"))
    return metrics.rates(kept)


_RATES = frozenset(metrics.RATES)


def pr_table(points: DataFrame) -> DataFrame:
    """Curve points with the columns of a precision-recall table."""
    return points.select(*(c for c in points.columns if c not in _RATES), "precision", "recall", "f1", "f05", "accuracy")


def roc_table(points: DataFrame) -> DataFrame:
    """Curve points with the columns of a ROC table."""
    return points.select(*(c for c in points.columns if c not in _RATES), F.col("recall").alias("tpr"), "fpr", "accuracy")


def threshold_metrics(preds: DataFrame, keys: list[str], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """keys, threshold, tp, fp, tn, fn and rates of every threshold: predictions are counted by how many thresholds they exceed."""
    passed = F.size(F.filter(F.array(*map(F.lit, sorted(thresholds))), lambda t: F.col("score") > t))
    counts = preds.groupBy(*keys, passed.alias("passed")).agg(F.sum("spam").alias("s"), F.sum(1 - F.col("spam")).alias("h"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(t).alias("threshold")) for i, t in enumerate(sorted(thresholds), 1))))
    rows = counts.select(*keys, "passed", "s", "h", each.alias("x"))
    on = F.col("passed") >= F.col("x.no")
    count = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0)).cast("long")
    return metrics.rates(rows.groupBy(*keys, F.col("x.threshold").alias("threshold")).agg(count(on, "s").alias("tp"), count(on, "h").alias("fp"), count(~on, "h").alias("tn"), count(~on, "s").alias("fn")))


def best_threshold(preds: DataFrame, keys: list[str], thresholds: list[float] = THRESHOLDS, digits: int = 9) -> DataFrame:
    """The threshold of largest F0.5 (rounded), the lowest of equals, with its metrics."""
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("f05", digits)), "threshold")
    return threshold_metrics(preds, keys, thresholds).withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
