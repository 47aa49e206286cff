"""Classification and calibration metrics as aggregate and scalar expressions, with the zero-denominator results fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFUSION = ("tp", "fp", "tn", "fn")
RATES = ("accuracy", "precision", "recall", "f1", "f05", "fpr", "fnr")


def predicted(score: Column, threshold: float | Column = 0.5) -> Column:
    """Whether a score is classified as spam: strictly over the threshold."""
    return score > threshold


def confusion(spam: Column, pred: Column) -> list[Column]:
    """Aggregates tp, fp, tn, fn."""
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    s = spam == 1
    return [count(s & pred, "tp"), count(~s & pred, "fp"), count(~s & ~pred, "tn"), count(s & ~pred, "fn")]


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, None).otherwise(b)).cast("double")


def fbeta(precision: Column, recall: Column, tp: Column, beta: float) -> Column:
    """0 without true positives."""
    b = beta * beta
    return F.when(tp == 0, F.lit(0.0)).otherwise((1 + b) * precision * recall / F.when(tp == 0, None).otherwise(b * precision + recall))


def rates(df: DataFrame, digits: int | None = None) -> DataFrame:
    """df with accuracy, precision, recall, f1, f05, fpr, fnr from its tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in CONFUSION)
    p, r = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    made = {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, 0.0),
        "precision": p,
        "recall": r,
        "f1": fbeta(p, r, tp, 1.0),
        "f05": fbeta(p, r, tp, 0.5),
        "fpr": ratio(fp, fp + tn, 0.0),
        "fnr": ratio(fn, tp + fn, 0.0),
    }
    return df.withColumns({k: F.round(v, digits) if digits is not None else v for k, v in made.items()})


def brier(score: Column, spam: Column) -> Column:
    return F.avg((score - spam) * (score - spam))


def log_loss(score: Column, spam: Column) -> Column:
    p = F.greatest(F.lit(1e-15), F.least(score, F.lit(1 - 1e-15)))
    return F.avg(-(spam * F.ln(p) + (1 - spam) * F.ln(1 - p)))


def brier_skill(brier_score: Column, rate: Column) -> Column:
    """1 - brier / (rate (1 - rate)); null if there is one class only."""
    base = rate * (1 - rate)
    return 1 - brier_score / F.when(base == 0, None).otherwise(base)
