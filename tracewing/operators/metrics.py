"""Model quality as plain aggregates, one row per split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running_totals

LABEL, PREDICTION, PROBABILITY = "label", "prediction", "probability"
TINY = 2.220446049250313e-16  # double epsilon: keeps log() away from 0


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient in double, 0 where the divisor is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def confusion_matrix(df: DataFrame, group: Sequence[str], label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    yes, said = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*group).agg(
        F.count_if(yes & said).alias("true_positives"),
        F.count_if(~yes & said).alias("false_positives"),
        F.count_if(yes & ~said).alias("false_negatives"),
        F.count_if(~yes & ~said).alias("true_negatives"),
        F.count(F.lit(1)).alias("example_count"),
    )


def classification_metrics(
    df: DataFrame,
    group: Sequence[str],
    label: str = LABEL,
    prediction: str = PREDICTION,
    probability: str | None = None,
) -> DataFrame:
    """Accuracy, precision, recall, F1 and, with a probability column, log loss: one map-side combined pass."""
    yes, said = F.col(label) == 1, F.col(prediction) == 1
    aggregates = [
        F.count(F.lit(1)).alias("example_count"),
        F.count_if(yes & said).alias("true_positives"),
        F.count_if(~yes & said).alias("false_positives"),
        F.count_if(yes & ~said).alias("false_negatives"),
        F.count_if(~yes & ~said).alias("true_negatives"),
    ]
    if probability:
        p = F.greatest(F.least(F.col(probability), F.lit(1 - TINY)), F.lit(TINY))
        aggregates.append((-F.avg(F.when(yes, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))
    counted = df.where(F.col(label).isNotNull()).groupBy(*group).agg(*aggregates)
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    return counted.withColumns(
        {
            "accuracy_score": _ratio(tp + tn, F.col("example_count")),
            "precision_score": _ratio(tp, tp + fp),
            "recall_score": _ratio(tp, tp + fn),
            "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def ranking_metrics(df: DataFrame, group: Sequence[str], label: str = LABEL, probability: str = PROBABILITY) -> DataFrame:
    """Exact areas under the ROC and the precision-recall curve.

    Rows are first counted per distinct score; only those are ordered, over
    ranges of scores.  The curve's corner before a score follows from the
    totals before it, so no row looks at another one.
    """
    yes = F.col(label) == 1
    known = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    scores = known.groupBy(*group, F.col(probability).alias("_score")).agg(
        F.count_if(yes).cast("double").alias("_pos"), F.count_if(~yes).cast("double").alias("_neg")
    )
    along = running_totals(scores, group, "_score", {"_tp": "_pos", "_fp": "_neg"}, descending=True)
    tp, fp, pos, neg = (F.col(c) for c in ("_tp", "_fp", "_pos", "_neg"))
    precision_before = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    precision_after = (tp + pos) / (tp + pos + fp + neg)
    areas = along.groupBy(*group).agg(
        F.sum(neg * (tp + pos / 2)).alias("_roc"),
        F.sum(pos * (precision_before + precision_after) / 2).alias("_pr"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
    )
    p, n = F.col("_p"), F.col("_n")
    return areas.select(
        *group,
        F.when((p > 0) & (n > 0), F.col("_roc") / (p * n)).alias("roc_auc"),
        F.when(p > 0, F.col("_pr") / p).alias("precision_recall_auc"),
    )


def regression_metrics(df: DataFrame, group: Sequence[str], label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """Errors and R2 of a regressor in one pass."""
    y, error = F.col(label).cast("double"), F.col(prediction).cast("double") - F.col(label)
    sums = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("example_count"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.avg(error * error).alias("mean_squared_error"),
        F.max(F.abs(error)).alias("max_error"),
        F.sum(y).alias("sum_on_target"),
        F.avg(y).alias("mean_on_target"),
        F.var_pop(y).alias("_variance"),
    )
    mse, variance = F.col("mean_squared_error"), F.col("_variance")
    return sums.withColumns(
        {
            "root_mean_squared_error": F.sqrt(mse),
            "r2_score": F.when(variance > 0, 1 - mse / variance),
        }
    ).drop("_variance")
