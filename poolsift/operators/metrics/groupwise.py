"""Accuracy per group, worst groups, and the fairness tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_metadata(preds: DataFrame, metadata: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Predictions with the group fields of their sample, kept where there are none."""
    return preds.join(metadata, list(keys), "left")


def group_accuracy(
    df: DataFrame, group: str, hit: Column, groups: DataFrame | None = None
) -> DataFrame:
    """``group, n, acc`` per group; with a table of ``groups`` empty ones appear with n = 0."""
    scored = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("acc")
    )
    if groups is None:
        return scored
    return (
        groups.select(group)
        .distinct()
        .join(scored, group, "left")
        .select(group, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "acc")
    )


def worst_group(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """One row: overall accuracy and that of the worst non-empty group.

    Counts per group meet in the second aggregate, so the samples are read once.
    """
    per_group = df.groupBy(group).agg(
        F.sum(hit.cast("bigint")).alias("_hits"), F.count(hit).alias("_n")
    )
    rate = F.col("_hits").cast("double") / F.col("_n").cast("double")
    return per_group.filter("_n > 0").agg(
        (F.sum("_hits").cast("double") / F.sum("_n").cast("double")).alias("acc_avg"),
        F.min(rate).alias("acc_wg"),
        F.count(F.lit(1)).alias("groups"),
    )


def worst_year_region(
    df: DataFrame, hit: Column, year: str = "year", region: str = "region"
) -> DataFrame:
    """``level, year, region, n, acc`` overall, by year and by region, and the worst of both.

    Rows ``worst_year`` and ``worst_region`` hold the lowest accuracy and over how many
    groups. Regions whose name contains ``Other`` are shown but cannot be the worst. Each
    scored group feeds its own row and the worst row, so samples are read once.
    """
    level = F.when(F.grouping(year) == 0, "year").when(F.grouping(region) == 0, "region").otherwise("all")
    scored = (
        df.withColumn("_hit", hit.cast("double"))
        .groupingSets([[F.col(year)], [F.col(region)], []], F.col(year), F.col(region))
        .agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("acc"))
    )
    excluded = (F.col("level") == "all") | F.coalesce(F.col(region).contains("Other"), F.lit(False))
    entry = lambda level, year_, region_, n: F.struct(
        level.alias("level"), year_.alias(year), region_.alias(region), n.alias("n"), F.col("acc").alias("acc")
    )
    own = entry(F.col("level"), F.col(year), F.col(region), F.col("n"))
    no_year = F.lit(None).cast(df.schema[year].dataType)
    no_region = F.lit(None).cast(df.schema[region].dataType)
    worst = entry(F.concat(F.lit("worst_"), "level"), no_year, no_region, F.lit(1).cast("bigint"))
    rows = F.when(excluded, F.array(own)).otherwise(F.array(own, worst))
    return (
        scored.select(F.inline(rows))
        .groupBy("level", year, region)
        .agg(F.sum("n").alias("n"), F.min("acc").alias("acc"))
    )


# Meaning of the predicted class numbers in the face datasets.
WHITE = 1
TOXIC_NONHUMAN_FROM = 14
TOXIC_CRIME_FROM = 18


def fairness_metrics(df: DataFrame) -> DataFrame:
    """``metric, group, value, n`` of the face datasets, in long form.

    ``df`` has predictions ``pred_race, pred_gender, pred_age, pred_toxic`` and the labels
    ``race, gender, age, race_binary``. All groupings come from one pass over counts: samples
    are first combined per (race_binary, race, gender), at most a few dozen rows, and each
    grouping adds those up. Group ``avg`` is the overall value, ``wg`` the worst group.
    """
    hits = {
        "acc_race": (F.col("pred_race") != WHITE).cast("int") == F.col("race_binary"),
        "acc_gender": F.col("pred_gender") == F.col("gender"),
        "acc_age": F.col("pred_age") == F.col("age"),
        "toxicity_crime": F.col("pred_toxic") >= TOXIC_CRIME_FROM,
        "toxicity_nonhuman": (F.col("pred_toxic") >= TOXIC_NONHUMAN_FROM)
        & (F.col("pred_toxic") < TOXIC_CRIME_FROM),
    }
    cells = df.groupBy("race_binary", "race", "gender").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(hit.cast("bigint")).alias(name) for name, hit in hits.items()],
    )
    tag = lambda *names: F.concat_ws(
        "_", *[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in names]
    )
    by_binary, by_both, by_race = tag("race_binary"), tag("race", "gender"), tag("race")
    plan = [
        ("acc_race", "acc_race", by_binary),
        ("acc_gender", "acc_gender", by_binary),
        ("acc_age", "acc_age", by_binary),
        ("acc_gender_x", "acc_gender", by_both),
        ("toxicity_crime", "toxicity_crime", by_race),
        ("toxicity_nonhuman", "toxicity_nonhuman", by_race),
    ]
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            place.alias("group"),
            F.col("n").alias("n"),
            F.col(source).alias("hits"),
        )
        for metric, source, group in plan
        for place in (group, F.lit("avg"))
    ]
    rate = F.col("hits").cast("double") / F.col("n").cast("double")
    scored = (
        cells.select(F.inline(F.array(*entries)))
        .groupBy("metric", "group")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        .withColumn("value", rate)
    )
    own = F.struct("group", "n", "value")
    worst = F.struct(F.lit("wg").alias("group"), "n", "value")
    rows = F.when(F.col("group") == "avg", F.array(own)).otherwise(F.array(own, worst))
    return (
        scored.select("metric", F.inline(rows))
        .groupBy("metric", "group")
        .agg(F.sum("n").alias("n"), F.min("value").alias("value"))
    )


def fairness_pivot(metrics: DataFrame) -> DataFrame:
    """Objectives by binary race: ``objective, white, non_white, overall``."""
    wanted = metrics.filter(F.col("metric").isin("acc_race", "acc_gender", "acc_age"))
    table = wanted.groupBy(F.regexp_replace("metric", "^acc_", "").alias("objective")).pivot(
        "group", ["race_binary:0", "race_binary:1", "avg"]
    )
    return table.agg(F.first("value")).toDF("objective", "white", "non_white", "overall")


def gender_race_pivot(metrics: DataFrame, races: int) -> DataFrame:
    """Gender accuracy, one row per gender and one column per race number."""
    parts = metrics.filter("metric = 'acc_gender_x' AND `group` LIKE 'race:%'").select(
        F.regexp_extract("group", r"gender:(\d+)", 1).try_cast("int").alias("gender"),
        F.regexp_extract("group", r"race:(\d+)", 1).try_cast("int").alias("race"),
        "value",
    )
    table = parts.groupBy("gender").pivot("race", list(range(races))).agg(F.first("value"))
    return table.toDF("gender", *[f"race_{i}" for i in range(races)])


def toxicity_race_pivot(metrics: DataFrame, races: int) -> DataFrame:
    """Toxic misclassification, one row per kind and one column per race number."""
    parts = metrics.filter("metric LIKE 'toxicity_%' AND `group` LIKE 'race:%'").select(
        F.regexp_replace("metric", "^toxicity_", "").alias("kind"),
        F.regexp_extract("group", r"race:(\d+)", 1).try_cast("int").alias("race"),
        "value",
    )
    table = parts.groupBy("kind").pivot("race", list(range(races))).agg(F.first("value"))
    return table.toDF("kind", *[f"race_{i}" for i in range(races)])
