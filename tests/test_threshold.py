import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsift.operators import filters, threshold

NAN = float("nan")
INF = float("inf")


def scores(spark, values):
    rows = [(f"{i:032x}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "uid string, clip_l14_similarity_score double")
    return df.repartition(5)


def expected(values, fraction):
    raw = np.array([NAN if v is None else v for v in values], dtype=float)
    return float(-np.sort(-raw)[int(len(values) * fraction)])


@pytest.mark.parametrize(
    "values, fraction",
    [
        ([0.1, NAN, 0.5, 0.3], 0.5),
        ([i / 10 for i in range(10)], 0.3),
        ([0.9, 0.5, 0.5, 0.5], 0.25),
        ([None, None, 0.2, NAN], 0.1),
        ([INF, 5.0, 4.0, -INF, 0.0], 0.5),
        ([-1e308, 1e308, 3e307, -2e307], 0.6),
        ([5e-324 * k for k in range(50)], 0.5),
        ([1e-310, 2e-310, 2e-310, 3e-310], 0.4),
        ([0.25] * 30, 0.9),
        ([-0.7, -0.71, -0.72], 0.0),
    ],
)
def test_small_cases(spark, values, fraction):
    got = threshold.score_threshold(scores(spark, values), "clip_l14_similarity_score", fraction)
    want = expected(values, fraction)
    assert got == want or (math.isnan(got) and math.isnan(want))


@pytest.mark.parametrize("seed", range(4))
def test_random_pools_match_a_full_sort(spark, seed):
    rng = np.random.default_rng(seed)
    values = [
        rng.normal(0.2, 0.1, 3000),
        np.round(rng.random(3000), 2),  # heavy ties
        0.3 + rng.random(3000) * 1e-12,  # everything in one bucket
        rng.lognormal(0, 8, 3000),  # far outside the usual range
    ][seed].tolist()
    values[::50] = [NAN] * len(values[::50])
    for fraction in (0.0, 0.29, 0.3, 0.97, 0.999):
        got = threshold.score_threshold(scores(spark, values), "clip_l14_similarity_score", fraction)
        want = expected(values, fraction)
        assert got == want or (math.isnan(got) and math.isnan(want))


def test_float_columns_compare_as_double(spark):
    df = scores(spark, [0.1, 0.2, 0.3]).withColumn(
        "clip_l14_similarity_score", F.col("clip_l14_similarity_score").cast("float")
    )
    got = threshold.score_threshold(df, "clip_l14_similarity_score", 0.5)
    assert got == float(np.float32(0.2))
    assert filters.clip_threshold(df, "l14", got).count() == 2


def test_rank_and_bad_fractions(spark):
    df = scores(spark, [0.5, 0.4, 0.3])
    assert threshold.score_at_rank(df, "clip_l14_similarity_score", 1) == 0.4
    for fraction in (1.0, 1.5, -0.1, NAN):
        with pytest.raises(ValueError):
            threshold.score_threshold(df, "clip_l14_similarity_score", fraction)
    with pytest.raises(ValueError):
        threshold.score_threshold(df.limit(0), "clip_l14_similarity_score", 0.5)


def test_missing_and_nan_scores_fail(spark):
    kept = filters.clip_threshold(scores(spark, [NAN, None, 0.4]), "l14", 0.3)
    assert [r.clip_l14_similarity_score for r in kept.collect()] == [0.4]
    assert filters.clip_threshold(scores(spark, [NAN, 0.4]), "l14", NAN).count() == 0


def test_top_fraction_keeps_ties_and_grows(spark):
    assert filters.clip_top_fraction(scores(spark, [0.9, 0.5, 0.5, 0.5]), "l14", 0.25).count() == 4
    rng = np.random.default_rng(1)
    df = scores(spark, rng.random(500).tolist())
    before = set()
    for fraction in (0.1, 0.29, 0.5):
        kept = {r.uid for r in filters.clip_top_fraction(df, "l14", fraction).collect()}
        assert len(kept) >= int(500 * fraction) + 1 and before <= kept
        before = kept
