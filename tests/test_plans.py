"""What the optimiser makes of the main queries."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from poolsift.operators import filters, nearest, tiles
from poolsift.plans import curation
from poolsift.sources import vector_files

QUERIES = entry_module.queries()


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_score_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "cast(id AS string) uid", "id / 100 AS clip_l14_similarity_score", "repeat('x', 10) AS text", "'en' AS lang"
    )
    rows.write.parquet(str(tmp_path / "pool"))
    df = filters.clip_top_fraction(spark.read.parquet(str(tmp_path / "pool")), "l14", 0.3).select("uid")
    plan = plan_of(df)
    assert "GreaterThanOrEqual(clip_l14_similarity_score" in plan
    assert re.search(r"ReadSchema: struct<uid:string,clip_l14_similarity_score:double>", plan)


def test_language_and_size_reach_the_scan(spark, tmp_path):
    rows = spark.range(100).selectExpr(
        "cast(id AS string) uid", "id / 100 AS clip_b32_similarity_score", "repeat('x y ', 10) AS text",
        "'en' AS lang", "cast(id AS int) AS original_width", "cast(id * 3 AS int) AS original_height", "'u' AS url",
    )
    rows.write.parquet(str(tmp_path / "pool"))
    pool = spark.read.parquet(str(tmp_path / "pool"))
    plan = plan_of(filters.laion_style_filter(pool).select("uid"))
    assert "EqualTo(lang,en)" in plan
    assert "text" not in re.search(r"ReadSchema: (.*)", plan).group(1)
    plan = plan_of(filters.basic_filter(pool).select("uid"))
    assert "GreaterThanOrEqual(original_width,200)" in plan
    assert "GreaterThanOrEqual(original_height,200)" in plan
    assert "url" not in re.search(r"ReadSchema: (.*)", plan).group(1)


@pytest.mark.parametrize("name", ["no_filter", "rows_per_source", "shard_offsets", "meta_semi", "shard_assign"])
def test_texts_are_not_read_when_not_needed(spark, name):
    schemas = re.findall(r"ReadSchema: (.*)", plan_of(QUERIES[name](spark, SMALL)))
    assert schemas and not any("text:" in s for s in schemas)


JOINS = (
    "image_cluster_filter text_entity_filter subset_expand shard_meta_join score_hist balanced_buckets shard_assign"
    " member_islands caption_match score_rollup worst_year_region fairness_metrics text_retrieval sample_with_replacement"
    " mix_sources retrieval_recall"
).split()


@pytest.mark.parametrize("name", JOINS)
def test_no_cross_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_counts_of_a_subset_are_shuffled_once(spark):
    df = QUERIES["subset_expand"](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_vectors_meet_their_rows_without_a_shuffle(spark, tmp_path):
    vectors = spark.range(200).selectExpr("id AS uid", "'a small car' AS text", "'en' AS lang", "array(cast(id AS float), 1f) AS vec")
    vector_files.write_with_vectors(vectors.repartition(3), str(tmp_path / "pool"))
    pool = curation.pool_positions(spark, str(tmp_path / "pool"), ["uid", "text", "lang"])
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "centroid_id int, centroid array<double>")
    placed = nearest.nearest(vector_files.attach_vectors(filters.caption_filter(pool)), centroids)
    plan = plan_of(placed.select("uid", "centroid_id"))
    assert "Exchange" not in plan and "Join" not in plan and "BroadcastExchange" not in plan
    # the filter is below the step that reads vectors, and reaches the scan
    assert plan.index("EqualTo(lang,en)") < plan.index("MapInArrow", plan.index("EqualTo(lang,en)"))
    assert placed.count() == 200


def test_candidates_are_counted_without_a_shuffle_of_vectors(spark):
    def side(n, parts):
        return spark.range(n).selectExpr("id", "array(sin(id), cos(id * 3)) AS vec").repartition(parts)

    sizes = []
    for parts in (2, 7):
        asked, given = (tiles.write_tiles(side(n, parts), "id", "vec") for n in (60, 40))
        best = nearest.best_of_pairs(asked, given, spark.range(60).selectExpr("id AS query_id", "id % 40 AS candidate_id"))
        ahead = nearest.count_ahead(asked, given, best)
        assert "vec" not in plan_of(ahead)
        sizes.append(ahead.count())
    assert sizes == [60, 60]
