"""Evaluation metrics and leaderboard roll-ups."""

from pyspark.sql import functions as F

from checks.base import check, sql_view
from checks.views import (
    association_items,
    faces,
    groups,
    preds,
    results,
    table,
    tasks,
)
from poolsift.operators.captions import last_wins
from poolsift.operators.metrics import classification, groupwise, retrieval, rollup

def hit():
    return F.col("y_pred") == F.col("y_true")


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def predicted(spark, sf):
    return classification.with_prediction(preds(spark, sf))


@check(
    "topk_accuracy",
    """
    SELECT dataset, count(*) AS n, round(avg(CAST(true_rank <= 1 AS DOUBLE)), 6) AS acc1,
        round(CASE WHEN max(len(logits)) >= 5 THEN avg(CAST(true_rank <= 5 AS DOUBLE)) END, 6) AS acc5
    FROM ranked GROUP BY dataset
    """,
)
def topk_accuracy(spark, sf):
    return rounded(classification.topk_accuracy(preds(spark, sf)), "acc1", "acc5")


@check(
    "topk_classes",
    """
    SELECT sample_id, CAST(place AS INTEGER) AS place, CAST(class_id AS INTEGER) AS class_id, round(logit, 5) AS logit FROM (
        SELECT sample_id, class_id, logit, row_number() OVER (PARTITION BY sample_id ORDER BY logit DESC, class_id) AS place
        FROM (SELECT sample_id, unnest(logits) AS logit, unnest(range(len(logits))) AS class_id FROM preds)) WHERE place <= 5
    """,
)
def topk_classes(spark, sf):
    rows = classification.topk_classes(preds(spark, sf), 5, ["sample_id"])
    return rows.withColumn("logit", F.round("logit", 5))


@check(
    "balanced_accuracy",
    """
    SELECT dataset, round(avg(recall), 6) AS mean_per_class_recall FROM (
        SELECT dataset, y_true, avg(CAST(y_true = y_pred AS DOUBLE)) AS recall FROM preds GROUP BY 1, 2) GROUP BY dataset
    """,
)
def balanced_accuracy(spark, sf):
    return rounded(classification.balanced_accuracy(predicted(spark, sf), ["dataset"]), "mean_per_class_recall")


@check(
    "f1_macro",
    """
    WITH t AS (SELECT dataset, y_true AS c, count(*) AS tn, count(*) FILTER (y_true = y_pred) AS hn FROM preds GROUP BY 1, 2),
    p AS (SELECT dataset, y_pred AS c, count(*) AS pn FROM preds GROUP BY 1, 2)
    SELECT t.dataset, round(sum(hn)::DOUBLE / sum(tn), 6) AS acc_avg, round(avg(hn::DOUBLE / tn), 6) AS recall_macro,
        round(avg(2::DOUBLE * hn / (tn + coalesce(pn, 0))), 6) AS f1_macro
    FROM t LEFT JOIN p ON t.dataset = p.dataset AND t.c = p.c GROUP BY t.dataset
    """,
)
def f1_macro(spark, sf):
    rows = classification.macro_scores(predicted(spark, sf), ["dataset"])
    return rounded(rows, "acc_avg", "recall_macro", "f1_macro")


@check("confusion_counts", "SELECT dataset, y_true, y_pred, count(*) AS n FROM preds GROUP BY 1, 2, 3")
def confusion_counts(spark, sf):
    return classification.confusion(predicted(spark, sf), ["dataset"])


@check(
    "group_accuracy",
    """
    SELECT s.source, count(p.sample_id) AS n, round(avg(CAST(y_true = y_pred AS DOUBLE)), 6) AS acc
    FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN preds p ON s.source = p.source GROUP BY s.source
    """,
)
def group_accuracy(spark, sf):
    every = table(spark, sf, "documents").select("source").distinct()
    return rounded(groupwise.group_accuracy(predicted(spark, sf), "source", hit(), every), "acc")


@check(
    "worst_group",
    """
    SELECT round(sum(h)::DOUBLE / sum(n), 6) AS acc_avg, round(min(h::DOUBLE / n), 6) AS acc_wg, count(*) AS groups
    FROM (SELECT source, count(*) AS n, count(*) FILTER (y_true = y_pred) AS h FROM preds GROUP BY source)
    """,
)
def worst_group(spark, sf):
    return rounded(groupwise.worst_group(predicted(spark, sf), "source", hit()), "acc_avg", "acc_wg")


@check(
    "worst_group_top5",
    """
    SELECT round(sum(h)::DOUBLE / sum(n), 6) AS acc_avg, round(min(h::DOUBLE / n), 6) AS acc_wg, count(*) AS groups
    FROM (SELECT region, count(*) AS n, count(*) FILTER (true_rank <= 5) AS h FROM ranked GROUP BY region)
    """,
)
def worst_group_top5(spark, sf):
    rows = groupwise.worst_group(predicted(spark, sf), "region", F.col("true_rank") <= 5)
    return rounded(rows, "acc_avg", "acc_wg")


@check(
    "worst_year_region",
    """
    WITH s AS (
        SELECT CASE WHEN grouping(year) = 0 THEN 'year' WHEN grouping(region) = 0 THEN 'region' ELSE 'all' END AS level,
            CAST(year AS INTEGER) AS year, region, count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS acc
        FROM preds GROUP BY GROUPING SETS ((year), (region), ()))
    SELECT level, year, region, n, round(acc, 6) AS acc FROM s
    UNION ALL SELECT 'worst_' || level, NULL, NULL, count(*), round(min(acc), 6) FROM s
    WHERE level <> 'all' AND NOT (region IS NOT NULL AND contains(region, 'Other')) GROUP BY level
    """,
)
def worst_year_region(spark, sf):
    return rounded(groupwise.worst_year_region(predicted(spark, sf), hit()), "acc")


sql_view(
    "face_metrics",
    """
    WITH h AS (SELECT *, CAST(CAST(pred_race <> 1 AS INTEGER) = race_binary AS DOUBLE) AS acc_race, CAST(pred_gender = gender AS DOUBLE) AS acc_gender,
            CAST(pred_age = age AS DOUBLE) AS acc_age, CAST(pred_toxic >= 18 AS DOUBLE) AS crime,
            CAST(pred_toxic >= 14 AND pred_toxic < 18 AS DOUBLE) AS nonhuman FROM faces),
    long AS (
        SELECT 'acc_race' AS metric, 'race_binary:' || race_binary AS grp, acc_race AS v FROM h
        UNION ALL SELECT 'acc_gender', 'race_binary:' || race_binary, acc_gender FROM h
        UNION ALL SELECT 'acc_age', 'race_binary:' || race_binary, acc_age FROM h
        UNION ALL SELECT 'acc_gender_x', 'race:' || race || '_gender:' || gender, acc_gender FROM h
        UNION ALL SELECT 'toxicity_crime', 'race:' || race, crime FROM h
        UNION ALL SELECT 'toxicity_nonhuman', 'race:' || race, nonhuman FROM h),
    g AS (SELECT metric, grp, count(*) AS n, avg(v) AS value FROM long GROUP BY 1, 2)
    SELECT metric, grp, n, value FROM g
    UNION ALL SELECT metric, 'avg', count(*), avg(v) FROM long GROUP BY metric
    UNION ALL SELECT metric, 'wg', CAST(sum(n) AS BIGINT), min(value) FROM g GROUP BY metric
    """,
)


def _faces(spark, sf):
    return groupwise.fairness_metrics(faces(predicted(spark, sf)))


@check("fairness_metrics", "SELECT metric, grp, n, round(value, 6) AS value FROM face_metrics")
def fairness_metrics(spark, sf):
    return rounded(_faces(spark, sf).withColumnRenamed("group", "grp"), "value").select("metric", "grp", "n", "value")


@check(
    "fairness_pivot",
    """
    SELECT replace(metric, 'acc_', '') AS objective, round(max(CASE WHEN grp = 'race_binary:0' THEN value END), 6) AS white,
        round(max(CASE WHEN grp = 'race_binary:1' THEN value END), 6) AS non_white, round(max(CASE WHEN grp = 'avg' THEN value END), 6) AS overall
    FROM face_metrics WHERE metric IN ('acc_race', 'acc_gender', 'acc_age') GROUP BY metric
    """,
)
def fairness_pivot(spark, sf):
    return rounded(groupwise.fairness_pivot(_faces(spark, sf)), "white", "non_white", "overall")


RACES = 7
RACE_COLUMNS = ", ".join(
    f"round(max(CASE WHEN grp LIKE 'race:{i}%' THEN value END), 6) AS race_{i}" for i in range(RACES)
)


@check(
    "gender_race_pivot",
    f"""
    SELECT CAST(regexp_extract(grp, 'gender:(\\d+)', 1) AS INTEGER) AS gender, {RACE_COLUMNS}
    FROM face_metrics WHERE metric = 'acc_gender_x' AND grp LIKE 'race:%' GROUP BY 1
    """,
)
def gender_race_pivot(spark, sf):
    rows = groupwise.gender_race_pivot(_faces(spark, sf), RACES)
    return rounded(rows, *rows.columns[1:])


@check(
    "toxicity_race_pivot",
    f"""
    SELECT replace(metric, 'toxicity_', '') AS kind, {RACE_COLUMNS}
    FROM face_metrics WHERE metric LIKE 'toxicity%' AND grp LIKE 'race:%' GROUP BY metric
    """,
)
def toxicity_race_pivot(spark, sf):
    rows = groupwise.toxicity_race_pivot(_faces(spark, sf), RACES)
    return rounded(rows, *rows.columns[1:])


@check(
    "jaccard_by_size",
    """
    SELECT round(avg(jaccard), 6) AS avg_jaccard_score, round(avg(jaccard) FILTER (candidates_n = 5), 6) AS jaccard_score_5,
        round(avg(jaccard) FILTER (candidates_n = 6), 6) AS jaccard_score_6, round(avg(jaccard) FILTER (candidates_n = 10), 6) AS jaccard_score_10,
        round(avg(jaccard) FILTER (candidates_n = 12), 6) AS jaccard_score_12, round(avg(jaccard) FILTER (candidates_n <= 6), 6) AS jaccard_score_5_6,
        round(avg(jaccard) FILTER (candidates_n >= 10), 6) AS jaccard_score_10_12 FROM association_jaccard
    """,
)
def jaccard_by_size(spark, sf):
    rows = retrieval.jaccard_by_size(association_items(spark, sf))
    return rounded(rows, *rows.columns)


@check(
    "topn_assoc",
    "SELECT item_id, CAST(pos AS INTEGER) AS candidate, is_true AS y_true, (n_true = 0 OR rank_no <= n_true) AS y_pred FROM association_rows",
)
def topn_assoc(spark, sf):
    rows = retrieval.topn_associations(association_items(spark, sf))
    zipped = F.explode(F.arrays_zip("candidates", "y_true", "y_pred")).alias("z")
    return rows.select("item_id", zipped).select(
        "item_id", F.col("z.candidates").alias("candidate"), F.col("z.y_true"), F.col("z.y_pred")
    )


@check(
    "results_flatten",
    """
    SELECT key, dataset, 'acc1' AS metric, acc1 AS value FROM results UNION ALL SELECT key, dataset, 'acc5', acc5 FROM results
    """,
)
def results_flatten(spark, sf):
    return rollup.flatten_results(results(spark, sf))


@check("last_wins", "SELECT dataset, seq, key, acc5 FROM latest")
def latest(spark, sf):
    return last_wins(results(spark, sf), ["dataset"], ["seq"]).select(
        "dataset", "seq", "key", F.col("metrics")["acc5"].alias("acc5")
    )


def scored(spark, sf):
    return rollup.with_main_metric(rollup.latest_results(results(spark, sf)), tasks(spark, sf))


@check("main_metric", "SELECT dataset, main_metric FROM scored")
def main_metric(spark, sf):
    return scored(spark, sf).select("dataset", "main_metric")


@check(
    "score_rollup",
    """
    SELECT name, round(avg(main_metric), 6) AS score, count(*) AS datasets,
        CASE WHEN name = 'Average' THEN count(*) = 25 END AS complete
    FROM (SELECT r_name AS name, s.main_metric FROM scored s JOIN tasks t ON s.dataset = t.name
          UNION ALL SELECT dataset, main_metric FROM scored WHERE dataset = 'NATION_7'
          UNION ALL SELECT 'Average', main_metric FROM scored) WHERE main_metric IS NOT NULL GROUP BY name
    """,
)
def score_rollup(spark, sf):
    rows = rollup.score_rollup(scored(spark, sf), groups(spark, sf), headline="NATION_7", expected=25)
    return rounded(rows, "score")


@check(
    "avg_main_metric",
    "SELECT count(main_metric) AS datasets, round(avg(main_metric), 6) AS average FROM scored",
)
def avg_main_metric(spark, sf):
    return rounded(rollup.avg_main_metric(scored(spark, sf)), "average")


NATIONS = [f"NATION_{i}" for i in range(25)]
NATION_COLUMNS = ", ".join(
    f"round(max(CASE WHEN dataset = '{n}' THEN acc5 END), 6) AS {n}" for n in NATIONS
)


@check(
    "leaderboard_pivot",
    f"""
    SELECT run, {NATION_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY run, dataset ORDER BY seq DESC) AS place FROM results) WHERE place = 1 GROUP BY run
    """,
)
def leaderboard_pivot(spark, sf):
    rows = last_wins(results(spark, sf), ["run", "dataset"], ["seq"])
    table_ = rollup.leaderboard_pivot(rows.withColumn("main_metric", F.col("metrics")["acc5"]), NATIONS)
    return rounded(table_, *NATIONS)


@check(
    "task_registry_join",
    """
    SELECT s.dataset, t.size, t.num_classes, round(s.main_metric - t.random_score, 6) AS above_chance, r_name AS tag
    FROM scored s JOIN tasks t ON s.dataset = t.name
    """,
)
def task_registry_join(spark, sf):
    rows = rollup.task_join(scored(spark, sf), tasks(spark, sf))
    return rounded(rows.select("dataset", "size", "num_classes", "above_chance", F.col("tags")[0].alias("tag")), "above_chance")


#: A task key for every branch of the router.
TASK_KEYS = [
    "imagenet1k", "vtab/svhn", "retrieval/flickr", "wilds/iwildcam", "wilds/camelyon17", "wilds/fmow", "wilds/rxrx1",
    "fairness/fairface", "fairness/utkface", "fairness/geode", "fairness/dollar_street", "fairness/other", "misc/winogavil", "misc/other",
]


@check(
    "metric_route",
    f"""
    SELECT key, CASE WHEN key LIKE 'retrieval/%' THEN 'retrieval'
        WHEN key IN ('wilds/iwildcam', 'wilds/camelyon17', 'wilds/fmow', 'fairness/geode', 'fairness/dollar_street') THEN key
        WHEN key IN ('fairness/fairface', 'fairness/utkface') THEN 'face' WHEN key = 'misc/winogavil' THEN 'association'
        WHEN split_part(key, '/', 1) IN ('wilds', 'fairness', 'misc') THEN 'none' ELSE 'classification' END AS family, n
    FROM (SELECT ({TASK_KEYS})[user_id % {len(TASK_KEYS)} + 1] AS key, count(*) AS n FROM events GROUP BY 1)
    """,
)
def metric_route(spark, sf):
    names = F.array(*[F.lit(k) for k in TASK_KEYS])
    place = (F.col("user_id") % len(TASK_KEYS) + 1).cast("int")
    keys = table(spark, sf, "events").select(F.element_at(names, place).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(
        "key", rollup.metric_family(F.col("key")).alias("family"), "n"
    )
