"""Top-k accuracy, balanced accuracy, F1 and confusion counts for any number of datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.functions.vectors import argmax, rank_of


def with_prediction(preds: DataFrame, logits: str = "logits", truth: str = "y_true") -> DataFrame:
    """Adds ``y_pred`` (first largest logit) and ``true_rank`` of the true class; no explode."""
    return preds.withColumn("y_pred", argmax(F.col(logits))).withColumn(
        "true_rank", rank_of(F.col(logits), F.col(truth))
    )


def topk_classes(preds: DataFrame, k: int, keep: Sequence[str], logits: str = "logits") -> DataFrame:
    """The ``k`` best classes per sample, best first: ``place`` 1.., ``class_id``, ``logit``."""
    ranked = F.sort_array(
        F.transform(logits, lambda x, i: F.struct((-x).alias("down"), i.alias("class_id")))
    )
    best = F.posexplode(F.slice(ranked, 1, k)).alias("_pos", "_best")
    return preds.select(*keep, best).select(
        *keep,
        (F.col("_pos") + 1).alias("place"),
        F.col("_best.class_id").alias("class_id"),
        (-F.col("_best.down")).alias("logit"),
    )


def topk_accuracy(preds: DataFrame, by: Sequence[str] = ("dataset",), logits: str = "logits") -> DataFrame:
    """``acc1`` and ``acc5`` per dataset; ``acc5`` only where there are at least five classes."""
    ranked = with_prediction(preds, logits).withColumn("_classes", F.size(logits))
    hit = lambda k: F.avg((F.col("true_rank") <= k).cast("double"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        hit(1).alias("acc1"),
        F.when(F.max("_classes") >= 5, hit(5)).alias("acc5"),
    )


def confusion(preds: DataFrame, by: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Counts per (true class, predicted class); everything below works on this small table."""
    return preds.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def balanced_accuracy(
    preds: DataFrame, by: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Mean recall over the classes that occur in the truth."""
    recall = preds.groupBy(*by, truth).agg(
        F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("recall")
    )
    return recall.groupBy(*by).agg(F.avg("recall").alias("mean_per_class_recall"))


def per_class_scores(
    preds: DataFrame, by: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Precision, recall and F1 per class seen in truth or prediction; 0/0 counts as 0."""
    counts = confusion(preds, by, truth, pred)
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col(truth).alias("class_id"),
                    F.col("n").alias("true_n"),
                    F.lit(0).cast("bigint").alias("pred_n"),
                    F.when(F.col(truth) == F.col(pred), F.col("n"))
                    .otherwise(F.lit(0).cast("bigint"))
                    .alias("hit_n"),
                ),
                F.struct(
                    F.col(pred).alias("class_id"),
                    F.lit(0).cast("bigint").alias("true_n"),
                    F.col("n").alias("pred_n"),
                    F.lit(0).cast("bigint").alias("hit_n"),
                ),
            )
        ),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    sums = sides.groupBy(*by, "class_id").agg(
        F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"), F.sum("hit_n").alias("hit_n")
    )
    return sums.select(
        "*",
        ratio(F.col("hit_n"), F.col("pred_n")).alias("precision"),
        ratio(F.col("hit_n"), F.col("true_n")).alias("recall"),
        ratio(2 * F.col("hit_n"), F.col("true_n") + F.col("pred_n")).alias("f1"),
    )


def macro_scores(
    preds: DataFrame,
    by: Sequence[str] = (),
    classes: str = "truth",
    truth: str = "y_true",
    pred: str = "y_pred",
) -> DataFrame:
    """Accuracy, macro recall and macro F1.

    Averaged over the classes that occur in the truth, or with ``classes="union"`` over
    those that occur in truth or prediction.
    """
    if classes not in ("truth", "union"):
        raise ValueError("classes must be 'truth' or 'union'")
    scores = per_class_scores(preds, by, truth, pred)
    counted = (F.col("true_n") > 0) if classes == "truth" else F.lit(True)
    return scores.groupBy(*by).agg(
        F.try_divide(F.sum("hit_n").cast("double"), F.sum("true_n").cast("double")).alias("acc_avg"),
        F.avg(F.when(counted, F.col("recall"))).alias("recall_macro"),
        F.avg(F.when(counted, F.col("f1"))).alias("f1_macro"),
    )
