"""Command-line jobs over small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.__main__ import main
from poolsift.operators.filters import basic_filter, clip_top_fraction
from poolsift.operators.metrics import rollup
from poolsift.plans import curation
from poolsift.plans.captions import refine_captions
from poolsift.plans.evaluation import METRICS, evaluate
from poolsift.sources import tables
from poolsift.sources.subset_files import read_subset


@pytest.fixture
def metadata(spark, tmp_path):
    folder = tmp_path / "meta"
    folder.mkdir()
    for stem, start in (("a", 0), ("b", 40)):
        rows = spark.range(start, start + 40).selectExpr(
            "md5(cast(id AS string)) AS uid", "concat('a small car ', id) AS text", "'en' AS lang",
            "cast(100 + id * 5 AS int) AS original_width", "300 AS original_height",
            "id / 80 AS clip_b32_similarity_score", "(id * 7 % 80) / 80 AS clip_l14_similarity_score",
        )
        rows.toPandas().to_parquet(folder / f"{stem}.parquet")
        rng = np.random.default_rng(start)
        np.savez(folder / f"{stem}.npz", l14_img=rng.normal(size=(40, 4)).astype(np.float16))
    return str(folder)


def test_curate_cluster_and_image_filter(spark, metadata, tmp_path):
    out = lambda name: str(tmp_path / name)
    pool = tables.scan_pool(spark, metadata)
    main(["curate", "--metadata_dir", metadata, "--save_path", out("basic"), "--name", "basic_filter"])
    want = sorted(r.uid for r in basic_filter(pool).collect())
    assert sorted(r.uid for r in spark.read.parquet(out("basic")).collect()) == want != []
    main(["curate", "--metadata_dir", metadata, "--save_path", out("top"), "--name", "clip_score", "--arch", "l14", "--fraction", "0.3", "--subset_file"])
    top = sorted(r.uid for r in clip_top_fraction(pool, "l14", 0.3).collect())
    assert sorted(r.uid for r in read_subset(spark, out("top")).collect()) == top
    main(["cluster", "--metadata_dir", metadata, "--save_path", out("cents"), "--num_clusters", "6", "--iterations", "3", "--sample_ratio", "0.5"])
    assert spark.read.parquet(out("cents")).count() == 6
    vectors = curation.pool_with_vectors(spark, metadata, ["uid"])
    vectors.limit(2).select("vec").write.parquet(out("targets"))
    main(["curate", "--metadata_dir", metadata, "--save_path", out("img"), "--name", "image_based", "--centroids", out("cents"), "--targets", out("targets")])
    assert 2 <= spark.read.parquet(out("img")).count() < 80
    with pytest.raises(ValueError):
        main(["curate", "--metadata_dir", metadata, "--save_path", out("x"), "--name", "clip_score"])


def test_profile_join_and_leaderboard(spark, metadata, tmp_path, capsys):
    (tmp_path / "terms.txt").write_text("car\ntruck\n")
    main(["profile", "--metadata_dir", metadata, "--keywords", str(tmp_path / "terms.txt"), "--save_path", str(tmp_path / "hits")])
    assert "[3, 5)" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 80
    shards = tmp_path / "shards"
    shards.mkdir()
    spark.range(10).selectExpr("md5(cast(id * 10 AS string)) AS uid", "id AS key").toPandas().to_parquet(shards / "00000.parquet")
    main(["join", "--shards_dir", str(shards), "--metadata_dir", metadata, "--save_path", str(tmp_path / "joined")])
    assert "80.0" in capsys.readouterr().out
    lines = [{"key": "k", "dataset": "ImageNet 1k", "metrics": {"acc1": 0.6, "main_metric": 0.6}}]
    (tmp_path / "results.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "tasks.yml").write_text("imagenet1k:\n  name: ImageNet 1k\n")
    main(["leaderboard", "--results", str(tmp_path / "results.jsonl"), "--tasks", str(tmp_path / "tasks.yml")])
    assert "ImageNet 1k" in capsys.readouterr().out


def test_metric_families(spark):
    rows = [("d", i, [float(i % 3 == c) for c in range(3)], i % 2, i % 4) for i in range(40)]
    preds = spark.createDataFrame(rows, "dataset string, sample_id long, logits array<double>, y_true int, slide int")
    preds = preds.selectExpr("*", "slide AS income_ds", "cast(slide AS string) AS region", "2000 + slide AS year")
    for family in ("classification", "wilds/iwildcam", "wilds/camelyon17", "wilds/fmow", "fairness/dollar_street", "fairness/geode"):
        assert evaluate(preds, family).count() >= 1


def test_every_route_is_in_the_registry(spark):
    from checks.metrics import TASK_KEYS

    keys = spark.createDataFrame([(k,) for k in TASK_KEYS], "key string")
    routes = {r.family for r in keys.select(rollup.metric_family(F.col("key")).alias("family")).collect()}
    assert routes - {"none"} <= set(METRICS)
    scores = spark.createDataFrame([(i, j, float(i == j), i == j) for i in range(4) for j in range(4)], "image_id int, text_id int, score double, is_match boolean")
    assert evaluate(scores, "retrieval", None).count() >= 1


def test_curate_with_a_detector(spark, tmp_path, monkeypatch):
    (tmp_path / "own_detector.py").write_text("def make():\n    return lambda texts: ['en'] * len(texts)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_detector.py"))
    rows = [(f"{i:032x}", "a good long caption here" if i % 2 else "no", 300, 300) for i in range(10)]
    pool = spark.createDataFrame(rows, "uid string, text string, original_width int, original_height int")
    pool.write.parquet(str(tmp_path / "pool"))
    main(["curate", "--name", "basic_filter", "--metadata_dir", str(tmp_path / "pool"), "--save_path", str(tmp_path / "out"),
          "--detector", "own_detector:make"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "tasks.yml").write_text("a:\n  name: A\nb:\n  name: B\n  main_metric: mean_per_class_recall\nfairness/geode:\n  name: G\nc:\n  name: C\n")
    rows = [(d, i, [float((i + shift) % 3 == c) for c in range(3)], i % 3, "x" if i % 2 else "y") for d, shift in (("A", 0), ("B", 1), ("G", 0)) for i in range(12)]
    preds = spark.createDataFrame(rows, "dataset string, sample_id long, logits array<double>, y_true int, region string")
    folder = str(tmp_path / "results")
    preds.where("dataset = 'A'").write.parquet(str(tmp_path / "some"))
    preds.write.parquet(str(tmp_path / "all"))
    job = lambda name: main(["evaluate", "--predictions", str(tmp_path / name), "--tasks", str(tmp_path / "tasks.yml"), "--results", folder])
    job("some")
    job("all")
    job("all")
    lines = {r.dataset: r for r in tables.read_results(spark, folder).collect()}
    assert tables.read_results(spark, folder).count() == 3 and set(lines) == {"A", "B", "G"}
    assert lines["A"].key == "a" and lines["A"].metrics["main_metric"] == lines["A"].metrics["acc1"] == 1.0
    assert lines["B"].metrics["main_metric"] == lines["B"].metrics["mean_per_class_recall"] == 0.0
    assert lines["G"].key == "fairness/geode" and lines["G"].metrics


def test_captions_are_matched_refined_and_resumed(spark, tmp_path):
    images = tmp_path / "images"
    (images / "sub").mkdir(parents=True)
    for name in ("a.jpg", "b.jpg", "sub/c.png", "none.jpg"):
        (images / name).write_bytes(b"x")
    (images / "a.txt").write_text(" alt of a\n")
    rows = [("a.jpg", "first", "u1"), ("a.jpg", "last", "u2"), ("b.jpg", "of b", "u3"), ("c.png", "of c", "u4"), ("z.jpg", "no image", "u5")]
    spark.createDataFrame(rows, "filename string, caption string, uid string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    seen = []

    def captioner(failing):
        def run(df):
            seen.append(sorted((r.filename, r.caption, r.alt_text) for r in df.collect()))
            text = F.when(~F.col("filename").isin(failing), F.concat("caption", F.lit("!")))
            return df.select("filename", text.alias("new_caption"))

        return run

    out = str(tmp_path / "out")
    job = lambda failing, resume: refine_captions(spark, str(images), str(tmp_path / "rows"), out, captioner(failing), resume).first()
    first = job(["b.jpg"], False)
    assert (first.total, first.succeeded, first.failed, first.no_caption_match) == (4, 2, 1, 1)
    assert [r.filename for r in spark.read.json(f"{out}/failed").collect()] == ["b.jpg"]
    again = job([], True)
    assert seen == [[("a.jpg", "last", "alt of a"), ("b.jpg", "of b", ""), ("c.png", "of c", "")], [("b.jpg", "of b", "")]]
    assert (again.total, again.succeeded, again.failed) == (2, 1, 0)
    merged = {(r.filename, r.caption): r.new_caption for r in spark.read.parquet(f"{out}/captions").collect()}
    assert merged == {("a.jpg", "first"): "last!", ("a.jpg", "last"): "last!", ("b.jpg", "of b"): "of b!", ("c.png", "of c"): "of c!", ("z.jpg", "no image"): None}
