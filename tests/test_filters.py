import pytest
from pyspark.sql import functions as F

from poolsift.operators import filters, profile
from poolsift.operators.filters import FilterInputs, FilterSpec, apply_filter

POOL = (
    "uid string, text string, lang string, original_width int, original_height int,"
    " clip_b32_similarity_score double, clip_l14_similarity_score double"
)


def pool(spark, *rows):
    full = [(f"{i:032x}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, POOL)


def kept(df):
    return sorted(int(r.uid, 16) for r in df.select("uid").collect())


def test_basic_filter_edges(spark):
    good = ("one two three", "en", 300, 300, 0.5, 0.5)
    df = pool(
        spark,
        good,
        ("one two", "en", 300, 300, 0.5, 0.5),  # two words
        ("a b c", "en", 300, 300, 0.5, 0.5),  # five characters
        ("one two three", "fr", 300, 300, 0.5, 0.5),
        ("one two three", None, 300, 300, 0.5, 0.5),
        ("one two three", "en", None, 300, 0.5, 0.5),
        ("one two three", "en", 199, 300, 0.5, 0.5),
        ("one two three", "en", 200, 600, 0.5, 0.5),  # aspect exactly 3
        ("one two three", "en", 200, 601, 0.5, 0.5),
        ("one two three", "en", 0, 0, 0.5, 0.5),
        ("one two three", "en", 0, 500, 0.5, 0.5),
        (None, "en", 300, 300, 0.5, 0.5),
    )
    assert kept(filters.basic_filter(df)) == [0, 7]
    # The caption filter asks for two words only and looks at no image.
    assert kept(filters.caption_filter(df)) == [0, 1, 5, 6, 7, 8, 9, 10]


def test_laion_style(spark):
    rows = [("t", "en", 1, 1, s, 0.0) for s in (0.28, 0.2799, None, float("nan"))]
    df = pool(spark, *rows, ("t", "de", 1, 1, 0.9, 0.0))
    assert kept(apply_filter(df, FilterSpec("laion2b"))) == [0]


def test_text_entity_keeps_multiplicity(spark):
    df = pool(
        spark,
        ("a dog and a dog", "en", 1, 1, 0.0, 0.0),
        ("a cat", "en", 1, 1, 0.0, 0.0),
        ("ein dog", "de", 1, 1, 0.0, 0.0),
        ("Dog", "en", 1, 1, 0.0, 0.0),
        (None, "en", 1, 1, 0.0, 0.0),
    )
    df = df.unionAll(df.filter("text LIKE 'a dog%'"))  # the same id twice
    lexicon = spark.createDataFrame([("dog", 1), ("cat", 2), ("a", 3)], "word string, synset_offset int")
    entities = spark.createDataFrame([(1,), (1,), (9,)], "synset_offset int")
    side = FilterInputs(lexicon=lexicon, entities=entities)
    assert kept(apply_filter(df, FilterSpec("text_based"), side)) == [0, 0]
    with pytest.raises(ValueError):
        apply_filter(df, FilterSpec("text_based"))


@pytest.mark.parametrize(
    "options",
    [
        dict(name="nope"),
        dict(name="laion2b", threshold=0.3),
        dict(name="basic_filter", arch="b32"),
        dict(name="clip_score", arch="b32"),
        dict(name="clip_score", threshold=0.3),
        dict(name="clip_score", arch="b32", threshold=0.3, fraction=0.3),
        dict(name="clip_score", arch="b16", threshold=0.3),
        dict(name="image_based", fraction=0.3),
    ],
)
def test_bad_options_fail_early(options):
    with pytest.raises(ValueError):
        FilterSpec(**options)


def test_cluster_and_clip_is_the_intersection(spark):
    rows = [(f"some words {i}", "en", 1, 1, i / 40, (i * 7 % 40) / 40) for i in range(40)]
    df = pool(spark, *rows).withColumn(
        "vec", F.array(*[F.sin(F.conv("uid", 16, 10).cast("double") * k) for k in (1.0, 2.0, 3.0)])
    )
    centroids = spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "centroid_id int, centroid array<double>")
    targets = spark.createDataFrame([([0.0, 1.0, 0.0],)], "vec array<double>")
    side = FilterInputs(centroids=centroids, targets=targets)
    both = apply_filter(df, FilterSpec("image_based_intersect_clip_score", arch="l14", fraction=0.4), side)
    left = apply_filter(df, FilterSpec("clip_score", arch="l14", fraction=0.4))
    right = apply_filter(df, FilterSpec("image_based"), side)
    assert kept(both) == sorted(set(kept(left)) & set(kept(right))) != []


def test_histograms(spark):
    texts = [None, "a b", "a b c", " ".join("x" * 19), " ".join("x" * 20), " ".join("x" * 500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r.bin, r.n) for r in profile.length_hist(df).collect()]
    assert got == [("[0, 3)", 2), ("[3, 5)", 1), ("[5, 7)", 0), ("[7, 10)", 0), ("[10, 15)", 0), ("[15, 20)", 1), (">20", 2)]
    values = [-0.1, 0.0, 0.1, 0.3, 1.0, 1.1, float("nan"), None, 0.30000000000000004]
    hist = profile.score_hist(spark.createDataFrame([(v,) for v in values], "s double"), "s").collect()
    assert [r.n for r in hist] == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1]
    assert hist[0].bin == "(0.0, 0.1]" and abs(sum(r.share for r in hist) - 1) < 1e-12


def test_high_score_count_coerces(spark):
    df = spark.createDataFrame([("0.5",), ("0.28",), ("bad",), (None,), ("NaN",)], "s string")
    row = filters.high_score_count(df, "s").first()
    assert (row.total, row.kept) == (5, 1)
