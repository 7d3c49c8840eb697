"""Retrieval recall and association (set overlap) scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.operators.nearest import GRID_BYTES, best_of_pairs, count_ahead
from poolsift.operators.tiles import Tiles, write_tiles


def recall_of_tiles(queries: Tiles, candidates: Tiles, pairs: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: queries with a right answer and the share of them with one among the best k, per k."""
    ahead = count_ahead(queries, candidates, best_of_pairs(queries, candidates, pairs))
    hits = [F.avg((F.col("ahead") < k).cast("double")).alias(f"recall_{k}") for k in ks]
    return ahead.agg(F.count(F.lit(1)).alias("queries"), *hits)


def retrieval_recall(
    queries: DataFrame,
    candidates: DataFrame,
    pairs: DataFrame,
    ks: Sequence[int] = (1, 5, 10),
    tile_bytes: int = GRID_BYTES,
) -> DataFrame:
    """The same of two tables of ``id, vec`` (ids unique), each read once.

    ``pairs`` lists the right answers only (``query_id, candidate_id``). A query counts as hit when fewer than k candidates
    score above its best right answer; the score matrix itself is never written down, and no vector is shuffled.
    """
    asked, given = (write_tiles(side, "id", "vec", tile_bytes=tile_bytes) for side in (queries, candidates))
    return recall_of_tiles(asked, given, pairs, ks)


def retrieval_both_ways(
    images: DataFrame, texts: DataFrame, pairs: DataFrame, ks: Sequence[int] = (1, 5, 10), tile_bytes: int = GRID_BYTES
) -> DataFrame:
    """One row with both directions (see :func:`both_ways`); ``pairs`` is ``image, text``. Each side becomes tiles once."""
    pictures, captions = (write_tiles(side, "id", "vec", tile_bytes=tile_bytes) for side in (images, texts))
    to_text = recall_of_tiles(pictures, captions, pairs.select(F.col("image").alias("query_id"), F.col("text").alias("candidate_id")), ks)
    to_image = recall_of_tiles(captions, pictures, pairs.select(F.col("text").alias("query_id"), F.col("image").alias("candidate_id")), ks)
    return both_ways(to_text, to_image)


def retrieval_recall_from_scores(
    scores: DataFrame, query: str, candidate: str, ks: Sequence[int] = (1, 5, 10)
) -> DataFrame:
    """The same from a given table of scores (``score, is_match``), in two plain aggregations.

    Only the best right answer per query goes back to the scores, so no query is sorted.
    """
    best = (
        scores.filter("is_match").groupBy(query).agg(F.max("score").alias("_best"))
    )
    ahead = (
        scores.join(best, query)
        .groupBy(query)
        .agg(F.count_if(F.col("score") > F.col("_best")).alias("ahead"))
    )
    hits = [F.avg((F.col("ahead") < k).cast("double")).alias(f"recall_{k}") for k in ks]
    return ahead.agg(F.count(F.lit(1)).alias("queries"), *hits)


def both_ways(image_to_text: DataFrame, text_to_image: DataFrame) -> DataFrame:
    """One row with both directions and the mean of their recall at 1."""
    figures = [c for c in image_to_text.columns if c != "queries"]
    tagged = image_to_text.withColumn("_way", F.lit("text")).unionByName(
        text_to_image.withColumn("_way", F.lit("image"))
    )
    both = tagged.agg(
        *[
            F.max(F.when(F.col("_way") == way, F.col(c))).alias(f"{way}_retrieval_{c}")
            for way in ("text", "image")
            for c in figures
        ]
    )
    mean = 0.5 * (F.col("text_retrieval_recall_1") + F.col("image_retrieval_recall_1"))
    return both.withColumn("mean_recall_1", mean)


def topn_associations(items: DataFrame) -> DataFrame:
    """Items with ``y_true`` and ``y_pred``, one flag per candidate.

    ``items`` has ``candidates, associations, scores`` (arrays). As many best-scored
    candidates are predicted as there are right ones, the later one on equal scores.
    With no right one at all every candidate is predicted.
    """
    truth = F.transform("candidates", lambda c: F.array_contains("associations", c))
    flagged = items.withColumn("y_true", truth).withColumn(
        "_n", F.size(F.filter("y_true", lambda t: t))
    )
    ranked = F.reverse(
        F.sort_array(F.transform("scores", lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    )
    chosen = F.transform(F.slice(ranked, F.lit(1), F.col("_n")), lambda r: r["i"])
    with_choice = flagged.withColumn("_chosen", chosen)
    pred = F.transform(
        "candidates", lambda c, i: (F.col("_n") == 0) | F.array_contains("_chosen", i)
    )
    return with_choice.withColumn("y_pred", pred).drop("_n", "_chosen")


def item_jaccard(items: DataFrame) -> DataFrame:
    """Items with ``candidates_n`` and ``jaccard`` of predicted and right candidates (0/0 is 0)."""
    scored = topn_associations(items)
    pairs = F.zip_with("y_true", "y_pred", lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    both = F.size(F.filter(pairs, lambda r: r["t"] & r["p"]))
    either = F.size(F.filter(pairs, lambda r: r["t"] | r["p"]))
    return scored.withColumn("candidates_n", F.size("candidates")).withColumn(
        "jaccard", F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(0.0))
    )


def jaccard_by_size(items: DataFrame) -> DataFrame:
    """One row: mean Jaccard overall and by number of candidates."""
    scored = item_jaccard(items)
    n, j = F.col("candidates_n"), F.col("jaccard")
    means = {
        "avg_jaccard_score": F.avg(j),
        "jaccard_score_5": F.avg(F.when(n == 5, j)),
        "jaccard_score_6": F.avg(F.when(n == 6, j)),
        "jaccard_score_10": F.avg(F.when(n == 10, j)),
        "jaccard_score_12": F.avg(F.when(n == 12, j)),
        "jaccard_score_5_6": F.avg(F.when(n <= 6, j)),
        "jaccard_score_10_12": F.avg(F.when(n >= 10, j)),
    }
    return scored.agg(*[value.alias(name) for name, value in means.items()])
