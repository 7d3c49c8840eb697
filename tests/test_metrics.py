import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.operators import captions
from poolsift.operators.metrics import classification as C
from poolsift.operators.metrics import groupwise as G
from poolsift.operators.metrics import retrieval as R
from poolsift.operators.metrics import rollup
from poolsift.plans import evaluation

PREDS = "dataset string, sample_id long, logits array<double>, y_true int"


def make_preds(spark, seed=0, n=200, classes=7):
    rng = np.random.default_rng(seed)
    logits, truth = rng.normal(size=(n, classes)).round(1), rng.integers(classes, size=n)
    rows = [("d", i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(logits, truth))]
    return spark.createDataFrame(rows, PREDS), logits, truth


def test_accuracy_against_numpy(spark):
    df, logits, truth = make_preds(spark)
    pred = logits.argmax(1)
    order = np.argsort(-logits, axis=1, kind="stable")
    row = C.topk_accuracy(df).first()
    assert row.acc1 == pytest.approx((pred == truth).mean())
    assert row.acc5 == pytest.approx((order[:, :5] == truth[:, None]).any(1).mean())
    recall = np.mean([(pred[truth == c] == c).mean() for c in np.unique(truth)])
    ranked = C.with_prediction(df)
    assert C.balanced_accuracy(ranked).first()[0] == pytest.approx(recall)
    f1 = np.mean([2 * ((pred == c) & (truth == c)).sum() / max(1, (pred == c).sum() + (truth == c).sum()) for c in np.unique(truth)])
    scores = C.macro_scores(ranked).first()
    assert (scores.f1_macro, scores.recall_macro) == (pytest.approx(f1), pytest.approx(recall))
    best = C.topk_classes(df, 3, ["sample_id"]).filter("sample_id = 5").orderBy("place").collect()
    assert [r.class_id for r in best] == order[5, :3].tolist()


def test_few_classes_have_no_top5(spark):
    df, _, _ = make_preds(spark, classes=4)
    assert C.topk_accuracy(df).first().acc5 is None
    metrics = evaluation.evaluate(df, "classification").first().metrics
    assert set(metrics) == {"acc1", "mean_per_class_recall"}
    with pytest.raises(ValueError):
        evaluation.evaluate(df, "nope")


def test_absent_class_counts_only_in_the_union(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int").unionAll(
        spark.createDataFrame([(0, 2)], "y_true int, y_pred int")
    )
    truth, union = C.macro_scores(df).first(), C.macro_scores(df, classes="union").first()
    assert truth.f1_macro == pytest.approx((0.5 + 2 / 3) / 2)
    assert union.f1_macro == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_groups_empty_and_worst(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "g string, ok int")
    groups = spark.createDataFrame([("a",), ("b",), ("empty",)], "g string")
    hit = F.col("ok") == 1
    got = {r.g: (r.n, r.acc) for r in G.group_accuracy(df, "g", hit, groups).collect()}
    assert got == {"a": (2, 0.5), "b": (1, 1.0), "empty": (0, None)}
    worst = G.worst_group(df, "g", hit).first()
    assert (worst.acc_avg, worst.acc_wg) == (pytest.approx(2 / 3), 0.5)


def test_other_region_cannot_be_worst(spark):
    rows = [(2002, "Asia", 1), (2002, "Asia", 0), (2003, "Other", 0), (2003, "Europe", 1)]
    df = spark.createDataFrame(rows, "year int, region string, ok int")
    got = {(r.level, r.year, r.region): r.acc for r in G.worst_year_region(df, F.col("ok") == 1).collect()}
    assert got["worst_region", None, None] == 0.5 and got["worst_year", None, None] == 0.5
    assert got["region", None, "Other"] == 0.0 and got["all", None, None] == 0.5


def test_associations(spark):
    items = spark.createDataFrame(
        [
            (1, ["a", "b", "c", "d", "e"], ["a", "b"], [0.9, 0.1, 0.8, 0.0, 0.2]),
            (2, ["a", "b"], ["z"], [0.1, 0.2]),  # no right one: everything predicted
            (3, ["a", "b", "c"], ["c"], [0.5, 0.5, 0.5]),  # equal scores: the later one
        ],
        "item_id int, candidates array<string>, associations array<string>, scores array<double>",
    )
    got = {r.item_id: (r.y_pred, r.jaccard) for r in R.item_jaccard(items).collect()}
    assert got[1] == ([True, False, True, False, False], pytest.approx(1 / 3))
    assert got[2] == ([True, True], 0.0)
    assert got[3] == ([False, False, True], 1.0)
    row = R.jaccard_by_size(items).first()
    assert row.jaccard_score_5 == pytest.approx(1 / 3) and row.jaccard_score_10_12 is None


def test_fairness_tables(spark):
    rng = np.random.default_rng(1)
    rows = [[int(x) for x in r] for r in np.stack([rng.integers(0, k, 300) for k in (7, 2, 9, 24, 7, 2, 9)], 1)]
    columns = "pred_race int, pred_gender int, pred_age int, pred_toxic int, race int, gender int, age int"
    df = spark.createDataFrame(rows, columns).withColumn("race_binary", (F.col("race") != 1).cast("int"))
    pdf = df.toPandas()
    got = {(r.metric, r.group): (r.n, r.value) for r in G.fairness_metrics(df).collect()}
    ok = ((pdf.pred_race != 1).astype(int) == pdf.race_binary).groupby(pdf.race_binary).mean()
    assert got["acc_race", "race_binary:0"][1] == pytest.approx(ok[0])
    assert got["acc_race", "wg"][1] == pytest.approx(ok.min())
    crime = (pdf.pred_toxic >= 18).groupby(pdf.race).mean()
    assert got["toxicity_crime", "race:3"][1] == pytest.approx(crime[3])
    both = (pdf.pred_gender == pdf.gender).groupby([pdf.race, pdf.gender]).mean()
    assert got["acc_gender_x", "race:2_gender:1"][1] == pytest.approx(both[2, 1])
    assert got["acc_age", "avg"] == (300, pytest.approx((pdf.pred_age == pdf.age).mean()))
    table = {r.objective: r for r in G.fairness_pivot(G.fairness_metrics(df)).collect()}
    assert table["race"].white == pytest.approx(ok[0]) and set(table) == {"race", "gender", "age"}


def test_leaderboard(spark):
    lines = [
        ("k1", "A", {"acc1": 0.1}, 1), ("k1", "A", {"acc1": 0.5, "f1": 0.9}, 2),
        ("k2", "B", {"f1": 0.3}, 3), ("k3", "C", {"acc1": float("nan")}, 4), ("k4", "D", {"acc1": 0.7}, 5),
    ]
    results = spark.createDataFrame(lines, "key string, dataset string, metrics map<string,double>, seq long")
    tasks = spark.createDataFrame([("A", None), ("B", "f1")], "name string, main_metric string")
    groups = spark.createDataFrame([("G", "A"), ("G", "B"), ("H", "A"), ("E", "Z")], "group string, dataset string")
    scored = rollup.with_main_metric(rollup.latest_results(results), tasks)
    got = {r.name: (r.score, r.datasets, r.complete) for r in rollup.score_rollup(scored, groups, "D", 3).collect()}
    assert got == {
        "G": (pytest.approx(0.4), 2, None), "H": (0.5, 1, None), "D": (0.7, 1, None),
        "Average": (pytest.approx(0.5), 3, True),
    }
    average = rollup.avg_main_metric(scored).first()
    assert (average.datasets, average.average) == (3, pytest.approx(0.5))
    assert evaluation.leaderboard(results, tasks).filter("name = 'Average'").first().complete is False
    families = ["retrieval/x", "wilds/fmow", "fairness/fairface", "fairness/geode", "fairness/x", "misc/winogavil", "misc/y", "vtab/z"]
    keys = spark.createDataFrame([(k,) for k in families], "key string")
    assert [r[0] for r in keys.select(rollup.metric_family(F.col("key"))).collect()] == [
        "retrieval", "wilds/fmow", "face", "fairness/geode", "none", "association", "none", "classification",
    ]
    assert rollup.groups_table(spark).groupBy("group").count().count() == 3


def test_captions(spark):
    images = spark.createDataFrame([("d/1.jpg",), ("d/2.png",), ("d/3.jpg",)], "path string")
    rows = [("x/1.png", "old", "u1", 1), ("1.jpeg", "new", "u2", 2), ("", "none", "u3", 3), ("3.jpg", None, "u4", 4)]
    table = spark.createDataFrame(rows, "filename string, caption string, uid string, seq int")
    side = spark.createDataFrame([("d/1.txt", " alt "), ("e/2.txt", "elsewhere")], "path string, alt_text string")
    got = {r.stem: (r.alt_text, r.caption, r.status) for r in captions.match_captions(images, table, side).collect()}
    assert got == {"1": ("alt", "new", "matched"), "2": ("", None, "no_caption_match"), "3": ("", None, "matched")}
    fresh = spark.createDataFrame([("3.jpg", "a", 1), ("3.jpg", "b", 2)], "filename string, new_caption string, seq int")
    merged = {r.filename: r.new_caption for r in captions.merge_captions(table, fresh).collect()}
    assert merged["3.jpg"] == "b" and merged["1.jpeg"] is None
    left = captions.remaining_work(table, captions.merge_captions(table, fresh), "filename", "new_caption")
    assert {r.filename for r in left.collect()} == {"x/1.png", "1.jpeg", ""}
    stats = captions.processing_stats(spark.createDataFrame([("succeeded",), ("failed",)], "status string"))
    assert stats.first().success_rate == 0.5 and captions.processing_stats(spark.createDataFrame([], "status string")).first().success_rate == 0.0


def test_result_does_not_depend_on_partitions(spark):
    df, _, _ = make_preds(spark, n=500)
    one = C.topk_accuracy(df.coalesce(1)).first()
    many = C.topk_accuracy(df.repartition(8)).first()
    assert round(one.acc1, 6) == round(many.acc1, 6) and round(one.acc5, 6) == round(many.acc5, 6)
