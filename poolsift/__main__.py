"""Jobs from the command line: ``spark-submit -m poolsift <job> ...`` or ``python -m poolsift``."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import replace

from pyspark.sql import SparkSession

from poolsift.operators.clustering import train_kmeans
from poolsift.operators.filters import FILTERS, FilterInputs, FilterSpec
from poolsift.plans import curation
from poolsift.plans.captions import refine_captions
from poolsift.plans.evaluation import evaluate_to, leaderboard
from poolsift.plans.resharding import reshard
from poolsift.session import build_session
from poolsift.sources import tables
from poolsift.sources.subset_files import read_subset
from poolsift.sources.vector_files import attach_vectors, detect_language, write_vectors

POOL_COLUMNS = [
    "uid",
    "text",
    "lang",
    "original_width",
    "original_height",
    "clip_b32_similarity_score",
    "clip_l14_similarity_score",
]


def named_function(name: str):
    """The object that ``module:name`` stands for."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def curate(spark: SparkSession, args: argparse.Namespace) -> None:
    spec = FilterSpec(args.name, args.arch, args.threshold, args.fraction)
    table = lambda path: spark.read.parquet(path) if path else None
    side = FilterInputs(
        lexicon=table(args.lexicon),
        entities=tables.read_entity_ids(spark, args.entities) if args.entities else None,
        centroids=table(args.centroids),
        targets=table(args.targets),
        lang=args.lang,
        second_lang=args.second_lang or ("second_lang" if args.second_detector else args.lang),
    )
    if args.name.startswith("image_based"):
        # vectors are read for the rows that are left when they are needed
        side = replace(side, attach=lambda rows: attach_vectors(rows, args.embedding_key))
        columns = [args.lang if c == "lang" else c for c in POOL_COLUMNS if c != "lang" or not args.detector]
        pool = curation.pool_positions(spark, args.metadata_dir, columns, args.embedding_key)
    else:
        pool = tables.scan_pool(spark, args.metadata_dir)
    for detector, column in ((args.detector, args.lang), (args.second_detector, args.second_lang)):
        if detector:
            pool = detect_language(pool, named_function(detector), output=column or "second_lang")
    write = curation.curate_to_subset_file if args.subset_file else curation.curate_to
    write(pool, spec, args.save_path, side)


def cluster(spark: SparkSession, args: argparse.Namespace) -> None:
    pool = curation.pool_positions(
        spark, args.metadata_dir, ["uid", "text", "lang"], args.embedding_key
    )
    rows = curation.training_rows(
        pool, not args.disable_caption_filtering, args.sample_ratio, args.seed
    )
    if args.sample_ratio > 0:
        rows = rows.sortWithinPartitions("vector_path", "row_idx")  # drawn rows come in any order
    vectors = attach_vectors(rows, args.embedding_key)
    keys = ["uid", "draw"] if args.sample_ratio > 0 else ["uid"]
    centroids = train_kmeans(vectors, args.num_clusters, args.iterations, args.seed, keys=keys)
    write_vectors(centroids, args.save_path)


def reshard_job(spark: SparkSession, args: argparse.Namespace) -> None:
    boxes = tables.read_boxes(spark, args.boxes) if args.boxes else None
    index = spark.read.parquet(args.index) if args.index else None
    subset = (
        read_subset(spark, args.subset_file)
        if args.subset_file
        else tables.scan_pool(spark, args.subset, ["uid"])
    )
    report = reshard(
        spark,
        args.input_dir,
        subset,
        args.output_dir,
        args.shard_size,
        args.max_bytes,
        args.shuffle_seed,
        boxes,
        index,
        overwrite=args.overwrite,
        first_shard=args.first_shard,
        num_shards=args.num_shards,
    )
    print(report)


def profile(spark: SparkSession, args: argparse.Namespace) -> None:
    terms = [r.value for r in tables.read_lines(spark, args.keywords).collect()]
    pool = tables.scan_pool(spark, args.metadata_dir)
    for name, hist in curation.profile_to(pool, terms, args.save_path).items():
        print(name)
        hist.show(truncate=False)


def join(spark: SparkSession, args: argparse.Namespace) -> None:
    curation.join_shards_to(args.shards_dir, args.metadata_dir, args.save_path, spark).show()


def scores(spark: SparkSession, args: argparse.Namespace) -> None:
    tasks = tables.read_tasks(spark, args.tasks)
    leaderboard(tables.read_results(spark, args.results), tasks).orderBy("name").show(truncate=False)


def evaluate_job(spark: SparkSession, args: argparse.Namespace) -> None:
    added = evaluate_to(spark.read.parquet(args.predictions), tables.read_tasks(spark, args.tasks), args.results)
    print(f"{added.count()} result lines added")


def captions_job(spark: SparkSession, args: argparse.Namespace) -> None:
    make = named_function(args.captioner)
    refine_captions(spark, args.image_dir, args.captions, args.output_dir, make, args.resume).show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="poolsift", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name, run, *required):
        sub = jobs.add_parser(name)
        sub.set_defaults(run=run)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    sub = job("curate", curate, "metadata_dir", "save_path")
    sub.add_argument("--name", required=True, choices=sorted(FILTERS))
    sub.add_argument("--arch")
    sub.add_argument("--threshold", type=float)
    sub.add_argument("--fraction", type=float)
    sub.add_argument("--lang", default="lang", help="language column")
    sub.add_argument("--second_lang", help="language column of the second detector")
    sub.add_argument("--detector", help="module:factory of a language detector, where the pool has no language column")
    sub.add_argument("--second_detector", help="module:factory of the second detector")
    for option in ("lexicon", "entities", "centroids", "targets"):
        sub.add_argument(f"--{option}")
    sub.add_argument("--embedding_key", default="l14_img")
    sub.add_argument("--subset_file", action="store_true", help="packed records instead of parquet")

    sub = job("cluster", cluster, "metadata_dir", "save_path")
    sub.add_argument("--num_clusters", type=int, default=100_000)
    sub.add_argument("--iterations", type=int, default=20)
    sub.add_argument("--sample_ratio", type=float, default=-1.0)
    sub.add_argument("--seed", type=int, default=0)
    sub.add_argument("--embedding_key", default="l14_img")
    sub.add_argument("--disable_caption_filtering", action="store_true")

    sub = job("reshard", reshard_job, "input_dir", "output_dir")
    which = sub.add_mutually_exclusive_group(required=True)
    which.add_argument("--subset", help="parquet folder with uid")
    which.add_argument("--subset_file", help="packed records")
    sub.add_argument("--shard_size", type=int, default=10_000)
    sub.add_argument("--max_bytes", type=float)
    sub.add_argument("--shuffle_seed", type=int)
    sub.add_argument("--boxes")
    sub.add_argument("--overwrite", action="store_true", help="clear the output folder first")
    sub.add_argument("--first_shard", type=int, default=0)
    sub.add_argument("--num_shards", type=int, help="input shards to take, by the number in their names")
    sub.add_argument("--index", help="index of an earlier run over the same shards")

    job("profile", profile, "metadata_dir", "keywords", "save_path")
    job("join", join, "shards_dir", "metadata_dir", "save_path")
    job("leaderboard", scores, "results", "tasks")
    job("evaluate", evaluate_job, "predictions", "tasks", "results")
    sub = job("captions", captions_job, "image_dir", "captions", "output_dir")
    sub.add_argument("--captioner", required=True, help="module:function from a table of images to filename, new_caption")
    sub.add_argument("--resume", action="store_true", help="leave out files that have a new caption already")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(build_session(f"poolsift-{args.job}"), args)


if __name__ == "__main__":
    main()
