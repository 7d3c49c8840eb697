"""From result lines to leaderboard numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.operators.captions import last_wins

# The dataset groups of the published leaderboard.
DATASET_GROUPS = {
    "ImageNet dist. shifts": (
        "ImageNet Sketch",
        "ImageNet v2",
        "ImageNet-A",
        "ImageNet-O",
        "ImageNet-R",
        "ObjectNet",
    ),
    "VTAB": (
        "Caltech-101",
        "CIFAR-100",
        "CLEVR Counts",
        "CLEVR Distance",
        "Describable Textures",
        "EuroSAT",
        "KITTI Vehicle Distance",
        "Oxford Flowers-102",
        "Oxford-IIIT Pet",
        "PatchCamelyon",
        "RESISC45",
        "SVHN",
        "SUN397",
    ),
    "Retrieval": ("Flickr", "MSCOCO", "WinoGAViL"),
}
HEADLINE = "ImageNet 1k"
AVERAGE = "Average"
EXPECTED_DATASETS = 38


def groups_table(spark: SparkSession, groups: Mapping[str, Sequence[str]] = DATASET_GROUPS) -> DataFrame:
    """``group, dataset``, one row per membership."""
    rows = [(g, d) for g, members in groups.items() for d in members]
    return spark.createDataFrame(rows, "group string, dataset string")


def known(value: Column) -> Column:
    """NaN as NULL, so that averages skip it."""
    return F.when(~F.isnan(value), value)


def flatten_results(results: DataFrame) -> DataFrame:
    """One row per metric: ``key, dataset, metric, value``."""
    return results.select("key", "dataset", F.explode_outer("metrics").alias("metric", "value"))


def latest_results(results: DataFrame, order: str = "seq") -> DataFrame:
    """The last result line per dataset."""
    return last_wins(results, ["dataset"], [order])


def with_main_metric(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Result lines with ``main_metric``, the value of the metric their task names (``acc1`` if none)."""
    named = tasks.select(F.col("name").alias("dataset"), F.col("main_metric").alias("_metric"))
    chosen = F.try_element_at("metrics", F.coalesce("_metric", F.lit("acc1")))
    return results.join(named, "dataset", "left").withColumn("main_metric", chosen).drop("_metric")


def avg_main_metric(scores: DataFrame, metric: str = "main_metric") -> DataFrame:
    """One row: datasets with a number and their mean."""
    value = known(F.col(metric).cast("double"))
    return scores.agg(F.count(value).alias("datasets"), F.avg(value).alias("average"))


def score_rollup(
    scores: DataFrame, groups: DataFrame, headline: str = HEADLINE, expected: int = EXPECTED_DATASETS
) -> DataFrame:
    """``name, score, datasets``: headline dataset, mean per group, mean over all datasets.

    ``scores`` has one row ``dataset, main_metric`` per dataset; those without a number are
    left out. ``complete`` tells, in the row of the overall mean, whether as many datasets as
    expected have one. A dataset in no group still counts in the average.
    """
    usable = scores.select("dataset", known(F.col("main_metric").cast("double")).alias("score")).filter(
        "score IS NOT NULL"
    )
    membership = (
        groups.select(F.col("group").alias("name"), "dataset")
        .distinct()
        .groupBy("dataset")
        .agg(F.collect_set("name").alias("_groups"))
    )
    own = F.when(F.col("dataset") == headline, F.array(F.lit(headline))).otherwise(
        F.array().cast("array<string>")
    )
    names = F.concat(F.coalesce("_groups", F.array().cast("array<string>")), own, F.array(F.lit(AVERAGE)))
    return (
        usable.join(membership, "dataset", "left")
        .select(F.explode(names).alias("name"), "score")
        .groupBy("name")
        .agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("datasets"))
        .withColumn("complete", F.when(F.col("name") == AVERAGE, F.col("datasets") == expected))
    )


def leaderboard_pivot(results: DataFrame, datasets: Sequence[str], run: str = "run") -> DataFrame:
    """One row per run and one column per dataset with its main metric."""
    table = results.groupBy(run).pivot("dataset", list(datasets))
    return table.agg(F.first("main_metric", ignorenulls=True))


def task_join(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results with registry fields and the score above chance."""
    return results.join(
        tasks.select(F.col("name").alias("dataset"), "size", "num_classes", "random_score", "tags"),
        "dataset",
    ).withColumn("above_chance", F.col("main_metric") - F.col("random_score"))


def metric_family(key: Column) -> Column:
    """Which metric job a task key belongs to: a name of the registry, or ``none``."""
    known_fairness = key.isin("fairness/fairface", "fairness/utkface")
    return (
        F.when(key.startswith("retrieval/"), "retrieval")
        .when(key.isin("wilds/iwildcam", "wilds/camelyon17", "wilds/fmow"), key)
        .when(key.startswith("wilds/"), "none")
        .when(known_fairness, "face")
        .when(key.isin("fairness/dollar_street", "fairness/geode"), key)
        .when(key.startswith("fairness/"), "none")
        .when(key == "misc/winogavil", "association")
        .when(key.startswith("misc/"), "none")
        .otherwise("classification")
    )
