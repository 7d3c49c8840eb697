"""Named filters, thresholds and profiles."""

from pyspark.sql import functions as F

from checks.base import check
from checks.views import centroids, entities, lexicon, pool, pool_emb, sql_words, table, targets
from poolsift.operators import filters, profile, subsets
from poolsift.operators.threshold import score_threshold
from poolsift.plans.curation import curate
from poolsift.session import run_dir
from poolsift.sources.tables import scan_pool as scan_pool_files

ENGLISH_WORDS = f"len({sql_words('text')})"
BASIC_SQL = f"""
    lang = 'en' AND {ENGLISH_WORDS} > 2 AND length(text) > 5 AND original_width IS NOT NULL
    AND least(original_width, original_height) >= 200
    AND greatest(original_width, original_height) <= 3.0 * least(original_width, original_height)
"""
CAPTION_SQL = f"lang = 'en' AND {ENGLISH_WORDS} > 1 AND length(text) > 5"
KEYWORDS = ("the", "elle", "dem")


@check("scan_pool", "SELECT uid, original_width, original_height, clip_l14_similarity_score FROM pool")
def scan_pool(spark, sf):
    """Two folders of several files, read as one pool."""
    folder = run_dir(spark, "pool")
    rows = pool(spark, sf)
    rows.where("lang = 'en'").repartition(3).write.parquet(f"{folder}/a")
    rows.where("lang IS DISTINCT FROM 'en'").repartition(2).write.parquet(f"{folder}/b")
    return scan_pool_files(spark, f"{folder}/a::{folder}/b", ["uid", "original_width", "original_height", "clip_l14_similarity_score"])


@check("no_filter", "SELECT uid FROM pool")
def no_filter(spark, sf):
    return filters.apply_filter(pool(spark, sf), filters.FilterSpec("no_filter")).select("uid")


@check("basic_filter", f"SELECT uid FROM pool WHERE {BASIC_SQL}")
def basic_filter(spark, sf):
    return filters.apply_filter(pool(spark, sf), filters.FilterSpec("basic_filter")).select("uid")


@check("subset_sorted", f"SELECT uid FROM pool WHERE {BASIC_SQL} ORDER BY uid")
def subset_sorted(spark, sf):
    return curate(pool(spark, sf), filters.FilterSpec("basic_filter"))


@check("caption_filter", f"SELECT uid FROM pool WHERE {CAPTION_SQL}")
def caption_filter(spark, sf):
    return filters.caption_filter(pool(spark, sf)).select("uid")


@check("clip_threshold", "SELECT uid FROM pool WHERE clip_b32_similarity_score >= 0.25")
def clip_threshold(spark, sf):
    spec = filters.FilterSpec("clip_score", arch="b32", threshold=0.25)
    return filters.apply_filter(pool(spark, sf), spec).select("uid")


THRESHOLD_SQL = """
    SELECT clip_l14_similarity_score AS s FROM (
        SELECT clip_l14_similarity_score, row_number() OVER (ORDER BY clip_l14_similarity_score DESC NULLS LAST) - 1 AS place,
            count(*) OVER () AS n FROM pool) WHERE place = floor(n * 0.3::DOUBLE)
"""


@check("score_threshold", f"SELECT s AS threshold FROM ({THRESHOLD_SQL})")
def threshold(spark, sf):
    value = score_threshold(pool(spark, sf), "clip_l14_similarity_score", 0.3)
    return spark.range(1).select(F.lit(value).alias("threshold"))


@check("clip_top_fraction", f"SELECT uid FROM pool WHERE clip_l14_similarity_score >= ({THRESHOLD_SQL})")
def clip_top_fraction(spark, sf):
    spec = filters.FilterSpec("clip_score", arch="l14", fraction=0.3)
    return filters.apply_filter(pool(spark, sf), spec).select("uid")


@check("laion_style_filter", "SELECT uid FROM pool WHERE clip_b32_similarity_score >= 0.28 AND lang = 'en'")
def laion_style_filter(spark, sf):
    return filters.apply_filter(pool(spark, sf), filters.FilterSpec("laion2b")).select("uid")


@check(
    "text_entity_filter",
    f"""
    SELECT uid FROM pool WHERE lang = 'en' AND list_has_any({sql_words('text')},
        (SELECT list(word) FROM lexicon WHERE synset_offset IN (SELECT synset_offset FROM entities)))
    """,
)
def text_entity_filter(spark, sf):
    side = filters.FilterInputs(lexicon=lexicon(spark, sf), entities=entities(spark, sf))
    return filters.apply_filter(pool(spark, sf), filters.FilterSpec("text_based"), side).select("uid")


@check(
    "image_cluster_filter",
    f"""
    SELECT uid FROM pool WHERE {CAPTION_SQL}
        AND uid IN (SELECT uid FROM assigned WHERE centroid_id IN (SELECT centroid_id FROM target_centroids))
    """,
)
def image_cluster_filter(spark, sf):
    side = filters.FilterInputs(centroids=centroids(spark, sf), targets=targets(spark, sf))
    return filters.apply_filter(pool_emb(spark, sf), filters.FilterSpec("image_based"), side).select("uid")


@check(
    "cluster_and_clip",
    f"""
    SELECT uid FROM pool WHERE {CAPTION_SQL} AND clip_l14_similarity_score >= (SELECT clip_l14_similarity_score FROM (
            SELECT clip_l14_similarity_score, row_number() OVER (ORDER BY clip_l14_similarity_score DESC NULLS LAST) - 1 AS place,
                count(*) OVER () AS n FROM pool) WHERE place = floor(n * 0.3::DOUBLE))
        AND uid IN (SELECT uid FROM assigned WHERE centroid_id IN (SELECT centroid_id FROM target_centroids))
    """,
)
def cluster_and_clip(spark, sf):
    """The threshold is one of the whole pool; only rows that pass it get their vectors."""
    spec = filters.FilterSpec("image_based_intersect_clip_score", arch="l14", fraction=0.3)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    side = filters.FilterInputs(
        centroids=centroids(spark, sf), targets=targets(spark, sf), attach=lambda rows: rows.join(vectors, "doc_id")
    )
    return filters.apply_filter(pool(spark, sf), spec, side).select("uid")


@check(
    "keyword_filter",
    rf"""
    SELECT uid FROM pool
    WHERE regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({"|".join(KEYWORDS)})($|[^\p{{L}}\p{{N}}_])')
    """,
)
def keyword_filter(spark, sf):
    return filters.keyword_filter(pool(spark, sf), KEYWORDS).select("uid")


@check(
    "high_score_count",
    "SELECT count(*) AS total, count(*) FILTER (clip_l14_similarity_score > 0.28) AS kept FROM pool",
)
def high_score_count(spark, sf):
    return filters.high_score_count(pool(spark, sf), "clip_l14_similarity_score")


@check(
    "length_hist",
    f"""
    SELECT b.bin_id, b.bin, count(w.n) AS n, round(count(w.n)::DOUBLE / nullif(sum(count(w.n)) OVER (), 0), 6) AS share
    FROM (VALUES (0, '[0, 3)', 0, 3), (1, '[3, 5)', 3, 5), (2, '[5, 7)', 5, 7), (3, '[7, 10)', 7, 10), (4, '[10, 15)', 10, 15),
        (5, '[15, 20)', 15, 20), (6, '>20', 20, 2000000000)) b(bin_id, bin, low, high)
    LEFT JOIN (SELECT len({sql_words("coalesce(text, '')")}) AS n FROM documents) w ON w.n >= b.low AND w.n < b.high
    GROUP BY 1, 2
    """,
)
def length_hist(spark, sf):
    return profile.length_hist(table(spark, sf, "documents")).withColumn("share", F.round("share", 6))


@check(
    "score_hist",
    """
    SELECT CAST(b.bin_id AS INTEGER) AS bin_id, b.bin, count(s.s) AS n,
        round(count(s.s)::DOUBLE / nullif(sum(count(s.s)) OVER (), 0), 6) AS share
    FROM (SELECT i AS bin_id, printf('(%.1f, %.1f]', low, high) AS bin, low, high FROM (
            SELECT unnest(range(10)) AS i, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS low,
                unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS high)) b
    LEFT JOIN (SELECT clip_b32_similarity_score AS s FROM pool) s ON s.s > b.low AND s.s <= b.high
    GROUP BY 1, 2
    """,
)
def score_hist(spark, sf):
    return profile.score_hist(pool(spark, sf), "clip_b32_similarity_score").withColumn("share", F.round("share", 6))


@check("rows_per_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def rows_per_source(spark, sf):
    return profile.rows_per_source(table(spark, sf, "documents"))


@check(
    "intersect_filters",
    f"SELECT uid FROM pool WHERE {BASIC_SQL} INTERSECT SELECT uid FROM pool WHERE clip_l14_similarity_score >= ({THRESHOLD_SQL})",
)
def intersect_filters(spark, sf):
    rows = pool(spark, sf)
    return subsets.intersect_subsets(
        filters.basic_filter(rows), filters.clip_top_fraction(rows, "l14", 0.3)
    )
