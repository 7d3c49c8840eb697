"""The named pool filters. Each keeps whole rows of the pool, so they compose."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.functions.images import size_ok
from poolsift.functions.text import has_words, matches_keywords, number_or_null, words
from poolsift.operators.nearest import centroid_tiles, covered_centroids, nearest
from poolsift.operators.sizing import broadcast_if_small, fetch_if_small
from poolsift.operators.threshold import at_least, score_threshold

# Fixed values of the published filters.
SCORE_COLUMNS = {"b32": "clip_b32_similarity_score", "l14": "clip_l14_similarity_score"}
LAION_SCORE = 0.28
ENGLISH = "en"


@dataclass(frozen=True)
class FilterSpec:
    """A filter by name with its options; wrong combinations fail before any job runs."""

    name: str
    arch: str | None = None
    threshold: float | None = None
    fraction: float | None = None

    def __post_init__(self) -> None:
        if self.name not in FILTERS:
            raise ValueError(f"unknown filter {self.name!r}; choose from {sorted(FILTERS)}")
        scored = "clip_score" in self.name
        given = [o for o in ("arch", "threshold", "fraction") if getattr(self, o) is not None]
        if given and not scored:
            raise ValueError(f"{self.name} takes no {', '.join(given)}")
        if scored:
            if (self.threshold is None) == (self.fraction is None):
                raise ValueError("give either threshold or fraction")
            if self.arch not in SCORE_COLUMNS:
                raise ValueError(f"arch must be one of {sorted(SCORE_COLUMNS)}")


@dataclass(frozen=True)
class FilterInputs:
    """Side tables and columns that some filters need besides the pool."""

    lexicon: DataFrame | None = None  # word, synset_offset
    entities: DataFrame | None = None  # synset_offset
    centroids: DataFrame | None = None  # centroid_id, centroid
    targets: DataFrame | None = None  # vec
    lang: str = "lang"
    second_lang: str = "lang"
    vec: str = "vec"
    keys: Sequence[str] = field(default_factory=lambda: ("uid",))
    attach: Callable[[DataFrame], DataFrame] | None = None  # adds the vectors to rows that passed; else the pool has them

    def need(self, *names: str) -> None:
        absent = [n for n in names if getattr(self, n) is None]
        if absent:
            raise ValueError(f"this filter needs the inputs {absent}")


def is_english(lang: Column) -> Column:
    """A bare comparison, so that it is pushed down; a filter drops NULL by itself."""
    return lang == ENGLISH


def no_filter(pool: DataFrame) -> DataFrame:
    return pool


def basic_filter(pool: DataFrame, lang: str = "lang") -> DataFrame:
    """English, more than 2 words and 5 characters, short side >= 200, aspect ratio <= 3.

    Cheap column comparisons come first; the word test only sees what they leave.
    """
    return pool.filter(
        is_english(F.col(lang))
        & size_ok(F.col("original_width"), F.col("original_height"), 200, 3.0)
        & (F.length("text") > 5)
        & has_words(F.col("text"), 3)
    )


def caption_filter(pool: DataFrame, lang: str = "lang") -> DataFrame:
    """English, more than 1 word and 5 characters (looser than :func:`basic_filter`)."""
    return pool.filter(
        is_english(F.col(lang)) & (F.length("text") > 5) & has_words(F.col("text"), 2)
    )


def clip_threshold(pool: DataFrame, arch: str, threshold: float) -> DataFrame:
    """Similarity score at or above ``threshold``; missing and NaN scores go."""
    return pool.filter(at_least(F.col(SCORE_COLUMNS[arch]), threshold))


def clip_top_fraction(pool: DataFrame, arch: str, fraction: float) -> DataFrame:
    """Top ``fraction`` of the whole pool by score, ties at the border kept.

    The threshold is a plain literal in the second scan, so parquet statistics can
    skip row groups that lie wholly below it.
    """
    return clip_threshold(pool, arch, score_threshold(pool, SCORE_COLUMNS[arch], fraction))


def clip_score(pool: DataFrame, arch: str, threshold: float | None, fraction: float | None) -> DataFrame:
    if threshold is None:
        return clip_top_fraction(pool, arch, fraction)
    return clip_threshold(pool, arch, threshold)


def laion_style_filter(pool: DataFrame, lang: str = "lang") -> DataFrame:
    """B/32 score at least 0.28 and English according to the second detector."""
    return clip_threshold(pool, "b32", LAION_SCORE).filter(is_english(F.col(lang)))


def text_entity_filter(
    pool: DataFrame, lexicon: DataFrame, entities: DataFrame, lang: str = "lang"
) -> DataFrame:
    """English, and the first sense of at least one word is in ``entities``.

    The words of the lexicon that lead to an entity are measured. A list that is small goes to
    the tasks, and the test is part of the scan: nothing is shuffled. A longer one is joined
    with the distinct words of each caption, and the ids and digests that hit with the rows.
    """
    leading = lexicon.select("word", "synset_offset").join(
        entities.select("synset_offset").distinct(), "synset_offset", "left_semi"
    )
    hits = leading.select(F.col("word").alias("_word")).filter("_word IS NOT NULL").distinct()
    english = pool.filter(is_english(F.col(lang)))
    listed = fetch_if_small(hits)
    if listed is not None:
        shipped = pool.sparkSession.sparkContext.broadcast(listed.column("_word").combine_chunks())
        return english.filter(_holds_any(shipped)(words(F.col("text"))))
    # only ids, digests and words are shuffled; rows equal in id and text share their answer
    keyed = english.withColumn("_digest", F.md5("text"))
    spoken = keyed.select("uid", "_digest", F.explode(F.array_distinct(words(F.col("text")))).alias("_word"))
    found = spoken.join(hits, "_word", "left_semi").select(F.col("uid").alias("_uid"), F.col("_digest").alias("_found")).distinct()
    same = F.col("uid").eqNullSafe(F.col("_uid")) & (F.col("_digest") == F.col("_found"))
    return keyed.join(found, same, "left_semi").drop("_digest")


def _holds_any(listed: Broadcast):
    """Whether a list of words holds one of the shipped words; false for null."""

    @F.arrow_udf(T.BooleanType())
    def holds(lists: pa.Array) -> pa.Array:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        hit = pc.is_in(lists.flatten(), value_set=listed.value).to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        found = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(sizes)
        return pa.array(found[ends] > found[ends - sizes])

    return holds


def image_cluster_filter(
    pool: DataFrame,
    centroids: DataFrame,
    targets: DataFrame,
    lang: str = "lang",
    vec: str = "vec",
    keys: Sequence[str] = ("uid",),
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Caption filter, then nearest centroid is nearest to some target embedding as well.

    ``attach`` adds the vectors to the rows that the caption filter leaves, where the pool does not hold them.
    """
    ready = centroid_tiles(centroids)
    wanted = broadcast_if_small(covered_centroids(targets, ready, vec))
    kept = caption_filter(pool, lang)
    placed = nearest(attach(kept) if attach else kept, ready, vec=vec, keys=keys)
    return placed.join(wanted, "centroid_id", "left_semi").drop("centroid_id", "score")


def cluster_and_clip(
    pool: DataFrame,
    centroids: DataFrame,
    targets: DataFrame,
    arch: str,
    threshold: float | None = None,
    fraction: float | None = None,
    lang: str = "lang",
    vec: str = "vec",
    keys: Sequence[str] = ("uid",),
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Score filter first (a fraction is still taken of the unfiltered pool), clusters after."""
    scored = clip_score(pool, arch, threshold, fraction)
    return image_cluster_filter(scored, centroids, targets, lang, vec, keys, attach)


def keyword_filter(pool: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Rows whose caption holds any of the keywords as a whole word, in any case."""
    return pool.filter(matches_keywords(F.col(text), terms))


def high_score_count(df: DataFrame, score: str, above: float = LAION_SCORE) -> DataFrame:
    """One row: all rows, and rows whose score is a number strictly above ``above``."""
    value = number_or_null(F.col(score).cast("string"))
    high = (value > above) & ~F.isnan(value)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(high, F.lit(False))).alias("kept")
    )


Filter = Callable[[DataFrame, FilterSpec, FilterInputs], DataFrame]


def _text_based(pool: DataFrame, spec: FilterSpec, side: FilterInputs) -> DataFrame:
    side.need("lexicon", "entities")
    return text_entity_filter(pool, side.lexicon, side.entities, side.lang)


def _image_based(pool: DataFrame, spec: FilterSpec, side: FilterInputs) -> DataFrame:
    side.need("centroids", "targets")
    return image_cluster_filter(
        pool, side.centroids, side.targets, side.lang, side.vec, side.keys, side.attach
    )


def _image_and_score(pool: DataFrame, spec: FilterSpec, side: FilterInputs) -> DataFrame:
    side.need("centroids", "targets")
    return cluster_and_clip(
        pool,
        side.centroids,
        side.targets,
        spec.arch,
        spec.threshold,
        spec.fraction,
        side.lang,
        side.vec,
        side.keys,
        side.attach,
    )


#: Filters by name; add to it to make a filter available to ``plans.curation``.
FILTERS: dict[str, Filter] = {
    "no_filter": lambda pool, spec, side: no_filter(pool),
    "basic_filter": lambda pool, spec, side: basic_filter(pool, side.lang),
    "clip_score": lambda pool, spec, side: clip_score(
        pool, spec.arch, spec.threshold, spec.fraction
    ),
    "laion2b": lambda pool, spec, side: laion_style_filter(pool, side.second_lang),
    "text_based": _text_based,
    "image_based": _image_based,
    "image_based_intersect_clip_score": _image_and_score,
}


def apply_filter(pool: DataFrame, spec: FilterSpec, side: FilterInputs | None = None) -> DataFrame:
    """Rows of ``pool`` that pass the named filter."""
    return FILTERS[spec.name](pool, spec, side or FilterInputs())
