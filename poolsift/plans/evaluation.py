"""Predictions of many datasets to result lines and a leaderboard."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.operators.metrics.classification import (
    balanced_accuracy,
    macro_scores,
    topk_accuracy,
    with_prediction,
)
from poolsift.operators.metrics.groupwise import fairness_metrics, worst_group, worst_year_region
from poolsift.operators.metrics.retrieval import both_ways, jaccard_by_size, retrieval_recall_from_scores
from poolsift.operators.metrics.rollup import groups_table, latest_results, metric_family, score_rollup, with_main_metric
from poolsift.session import saved
from poolsift.sources.storage import entries
from poolsift.sources.tables import append_results, read_results


def classification_metrics(preds: DataFrame) -> DataFrame:
    """``dataset, metrics`` for all datasets of a table with ``logits, y_true, y_pred``."""
    top = topk_accuracy(preds, ["dataset"])
    recall = balanced_accuracy(preds, ["dataset"])
    return top.join(recall, "dataset").select(
        "dataset",
        F.map_filter(
            F.create_map(
                F.lit("acc1"), F.col("acc1"),
                F.lit("acc5"), F.col("acc5"),
                F.lit("mean_per_class_recall"), F.col("mean_per_class_recall"),
            ),
            lambda _, value: value.isNotNull(),
        ).alias("metrics"),
    )


def retrieval_metrics(scores: DataFrame) -> DataFrame:
    """Recall both ways from a table of scores (``image_id, text_id, score, is_match``)."""
    return both_ways(
        retrieval_recall_from_scores(scores, "image_id", "text_id"),
        retrieval_recall_from_scores(scores, "text_id", "image_id"),
    )


def _correct():
    return F.col("y_pred") == F.col("y_true")


def _top5():
    return F.col("true_rank") <= 5


#: Metric jobs by family, each from a table with predictions to a metric table.
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "classification": classification_metrics,
    "face": fairness_metrics,
    "association": jaccard_by_size,
    "retrieval": retrieval_metrics,
    "wilds/iwildcam": macro_scores,
    "wilds/camelyon17": lambda preds: worst_group(preds, "slide", _correct()),
    "wilds/fmow": lambda preds: worst_year_region(preds, _correct()),
    "fairness/dollar_street": lambda preds: worst_group(preds, "income_ds", _top5()),
    "fairness/geode": lambda preds: worst_group(preds, "region", _correct()),
}


def evaluate(
    preds: DataFrame, family: str, predict: Callable[[DataFrame], DataFrame] | None = with_prediction
) -> DataFrame:
    """Run one registered metric job.

    ``predict`` turns scores into ``y_pred`` (and ``true_rank``); pass ``None`` for tables that
    have their predictions already, as the face, association and retrieval families do.
    """
    if family not in METRICS:
        raise ValueError(f"unknown metric family {family!r}; choose from {sorted(METRICS)}")
    return METRICS[family](predict(preds) if predict else preds)


def evaluate_to(preds: DataFrame, tasks: DataFrame, path: str, predict: Callable[[DataFrame], DataFrame] | None = with_prediction) -> DataFrame:
    """Result lines of the datasets of ``preds`` that have none in the folder ``path``; returns the lines added.

    ``tasks`` is the registry (``key, name, main_metric``). Datasets with a line of a registered key are skipped, so a run that broke off
    goes on where it stopped. Datasets of the classification family are scored in one pass, others one at a time (a registry
    has a few dozen). ``main_metric`` is the metric that the task names.
    """
    spark = preds.sparkSession
    named = tasks.select(F.col("name").alias("dataset"), "key", F.coalesce("main_metric", F.lit("acc1")).alias("_metric"))
    named = named.withColumn("_family", metric_family(F.col("key")))
    if entries(path):
        known = read_results(spark, path).join(tasks.select("key"), "key", "left_semi").select("dataset").distinct()
        named = named.join(known, "dataset", "left_anti")
    open_ = named.join(preds.select("dataset").distinct(), "dataset", "left_semi").collect()  # a row per task
    at_once = [r.dataset for r in open_ if r._family == "classification"]
    parts = []
    if at_once:
        parts.append(evaluate(preds.where(F.col("dataset").isin(at_once)), "classification", predict))
    for row in open_:
        if row._family in METRICS and row._family != "classification":
            found = evaluate(preds.where(F.col("dataset") == row.dataset), row._family, predict)
            numbers = [f.name for f in found.schema.fields if isinstance(f.dataType, T.NumericType)]
            pairs = [x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))]
            parts.append(found.select(F.lit(row.dataset).alias("dataset"), F.create_map(*pairs).alias("metrics")))
    schema = "dataset string, metrics map<string,double>"
    scored = reduce(DataFrame.unionAll, parts, spark.createDataFrame([], schema))
    main = F.create_map(F.lit("main_metric"), F.try_element_at("metrics", F.col("_metric")))
    lines = scored.join(named, "dataset").select("key", "dataset", F.map_concat(F.map_filter("metrics", lambda k, _: k != "main_metric"), main).alias("metrics"))
    lines = saved(lines, "result-lines")
    append_results(lines, path)
    return lines


def leaderboard(results: DataFrame, tasks: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Group means and overall mean from appended result lines."""
    scored = with_main_metric(latest_results(results), tasks)
    if groups is None:
        groups = groups_table(results.sparkSession)
    return score_rollup(scored, groups)
