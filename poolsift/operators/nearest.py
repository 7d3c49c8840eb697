"""Brute-force similarity of many vectors against a set of reference vectors.

The many vectors stay where they are: each Arrow batch meets the tiles of the reference (see
:mod:`poolsift.operators.tiles`) in matrix products inside the task, so no pairs are formed, nothing is shuffled and
neither side passes through the driver. The best match so far is held per batch, and tiles whose vectors are
too short to beat it are skipped; with one tile (100,000 x 768 doubles are ten) the work is a single product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from poolsift.operators.tiles import TILE_BYTES, Tiles, to_matrix, write_tiles

#: Rows per matrix product; bounds the similarity matrix held by a task.
PRODUCT_CELLS = 1 << 24
#: Relative difference below which two scores are the same score.
TIE = 1e-12
#: Bytes of a tile, and tiles in a strip, where two tables of tiles meet.
GRID_BYTES = 8 << 20
STRIP = 64


def _products(matrix: np.ndarray, reference: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, PRODUCT_CELLS // max(1, len(reference)))
    for start in range(0, len(matrix), step):
        rows = slice(start, start + step)
        yield rows, matrix[rows] @ reference.T


def best_in_tiles(matrix: np.ndarray, tiles: Tiles, metric: str, read) -> tuple[np.ndarray, np.ndarray]:
    """Best reference id and its score per row; the lowest id wins a tie. ``read`` is the task's tile reader."""
    kind = np.int64 if isinstance(tiles.id_type, T.IntegralType) else object
    best, score = np.zeros(len(matrix), kind), np.full(len(matrix), -np.inf)
    lengths = np.linalg.norm(matrix, axis=1)
    for tile in tiles.tiles:
        wanted = np.flatnonzero(tile.reach(lengths, metric) >= score)
        if not len(wanted):
            continue
        ids, reference, _ = read(tile)
        half = 0.5 * np.einsum("ij,ij->i", reference, reference) if metric == "l2" else 0.0
        part = matrix if len(wanted) == len(matrix) else matrix[wanted]
        for rows, product in _products(part, reference):
            product = product - half if metric == "l2" else product
            top = product.argmax(axis=1)
            found = np.take_along_axis(product, top[:, None], axis=1)[:, 0]
            at = wanted[rows]
            better = found > score[at]
            same = np.flatnonzero(found == score[at])
            better[same] = ids[top[same]] < best[at[same]]
            best[at[better]] = ids[top[better]]
            score[at[better]] = found[better]
    return best, score


def _match(tiles: Tiles, metric: str, vec: str) -> Column:
    """Struct of the best id and its score; null without a usable vector."""
    kind = T.StructType([T.StructField("id", tiles.id_type), T.StructField("score", T.DoubleType())])
    open_ = []  # the task's tile reader, from its first batch on

    @F.arrow_udf(kind)
    def match(vectors: pa.Array) -> pa.Array:
        if not open_:
            open_.append(tiles.reader())
        matrix, usable = to_matrix(vectors, tiles.dim)
        best, score = best_in_tiles(matrix, tiles, metric, open_[0])
        at = np.cumsum(usable) - 1
        id_kind = to_arrow_type(tiles.id_type)
        places = pa.array(at, mask=~usable)  # null where there is no vector
        ids = pa.array(best.tolist(), id_kind).take(places)
        return pa.StructArray.from_arrays(
            [ids, pa.array(score).take(places)], fields=[pa.field("id", id_kind), pa.field("score", pa.float64())], mask=pa.array(~usable)
        )

    return match(F.col(vec))


def best_of(points: DataFrame, tiles: Tiles, vec: str, metric: str, output: str) -> DataFrame:
    """``points`` with a struct ``output`` of the best id and its score; null without a usable vector."""
    return points.withColumn(output, _match(tiles, metric, vec))


def centroid_tiles(centroids: DataFrame, tile_bytes: int = TILE_BYTES) -> Tiles:
    """Centroids made ready once for several calls of :func:`nearest`."""
    return write_tiles(centroids, "centroid_id", "centroid", tile_bytes=tile_bytes)


def nearest(
    points: DataFrame,
    centroids: DataFrame | Tiles,
    vec: str = "vec",
    keys: Sequence[str] = ("uid",),
    metric: str = "dot",
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """``points`` with ``centroid_id`` and ``score`` of the best centroid.

    ``metric`` is ``"dot"`` (largest inner product) or ``"l2"`` (smallest distance; the
    score is then ``x.c - |c|^2/2``, which orders centroids the same way). Points without
    a usable vector are dropped. Rows are never joined back; ``keys`` are not needed and kept for callers.
    """
    if metric not in ("dot", "l2"):
        raise ValueError("metric must be 'dot' or 'l2'")
    tiles = centroids if isinstance(centroids, Tiles) else centroid_tiles(centroids, tile_bytes)
    return (
        best_of(points, tiles, vec, metric, "_match")
        .filter("_match IS NOT NULL")
        .select(*points.columns, F.col("_match.id").alias("centroid_id"), F.col("_match.score").alias("score"))
    )


def covered_centroids(
    targets: DataFrame, centroids: DataFrame | Tiles, vec: str = "vec", tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """Distinct ``centroid_id`` that are nearest to at least one target vector."""
    placed = nearest(targets.select(vec), centroids, vec, keys=(), tile_bytes=tile_bytes)
    return placed.select("centroid_id").distinct()


def scores_against(
    points: DataFrame,
    reference: DataFrame,
    id_col: str,
    reference_vec: str,
    vec: str = "vec",
    scale: float = 1.0,
    output: str = "logits",
) -> DataFrame:
    """``points`` with an array of scaled inner products, one per reference id in id order.

    The array grows with the reference, which must therefore fit one tile (a class list).
    """
    tiles = write_tiles(reference, id_col, reference_vec)
    if tiles.rows * tiles.dim * 8 > TILE_BYTES:
        raise ValueError("too many reference vectors for one score array; use nearest()")
    open_ = []

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vectors: pa.Array) -> pa.Array:
        if not open_:
            read = tiles.reader()
            parts = [read(tile)[:2] for tile in tiles.tiles]
            order = np.argsort(np.concatenate([ids for ids, _ in parts]), kind="stable")
            open_.append(np.concatenate([matrix for _, matrix in parts])[order])
        rows, usable = to_matrix(vectors, tiles.dim)
        values = scale * (rows @ open_[0].T)
        width = values.shape[1]
        ends = np.concatenate([[0], np.cumsum(np.where(usable, width, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(values.ravel()), mask=pa.array(~usable)
        )

    return points.withColumn(output, score(F.col(vec)))


def index_of(tiles: Tiles, spark: SparkSession, name: str) -> DataFrame:
    """``name`` (the id), ``{name}_tile`` and ``{name}_row`` of every vector; read from the tiles by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = tiles.reader()
        for batch in batches:
            for place in batch.column(0).to_pylist():
                ids = read(tiles.tiles[place])[2].column(0)
                columns = [ids, pa.array(np.full(len(ids), place, np.int32)), pa.array(np.arange(len(ids), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [name, f"{name}_tile", f"{name}_row"])

    fields = [(name, tiles.id_type), (f"{name}_tile", T.IntegerType()), (f"{name}_row", T.IntegerType())]
    places = spark.range(len(tiles.tiles), numPartitions=min(len(tiles.tiles), 1024))
    return places.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def best_of_pairs(queries: Tiles, candidates: Tiles, pairs: DataFrame) -> DataFrame:
    """``tile, row, best``: the greatest score of each query with the candidates that ``pairs`` gives it.

    ``pairs`` has ``query_id, candidate_id``. Ids alone are joined; a pair of tiles is opened by the task that has its pairs.
    """
    spark = pairs.sparkSession
    placed = pairs.join(index_of(candidates, spark, "candidate_id"), "candidate_id").join(index_of(queries, spark, "query_id"), "query_id")
    cells = placed.select("query_id_tile", "candidate_id_tile", "query_id_row", "candidate_id_row")
    if len(queries.tiles) * len(candidates.tiles) > 1:  # pairs of the same tiles next to one another in a task
        cells = cells.sortWithinPartitions("query_id_tile", "candidate_id_tile")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_query, read_candidate = queries.reader(), candidates.reader()
        for batch in batches:
            tile, other, row, place = (c.to_numpy() for c in batch.columns)
            out = np.empty(len(tile))
            cell = tile.astype(np.int64) * len(candidates.tiles) + other
            order = np.argsort(cell, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                if len(at):
                    left = read_query(queries.tiles[tile[at[0]]])[1]
                    right = read_candidate(candidates.tiles[other[at[0]]])[1]
                    out[at] = np.einsum("ij,ij->i", left[row[at]], right[place[at]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["tile", "row", "score"])

    return cells.mapInArrow(score, "tile int, row int, score double").groupBy("tile", "row").agg(F.max("score").alias("best"))


def count_ahead(queries: Tiles, candidates: Tiles, best: DataFrame) -> DataFrame:
    """``tile, row, ahead``: how many candidates score above the ``best`` (``tile, row, best``) of each query.

    This is what ranks the best right answer among all candidates without forming a single pair. The
    tiles of both sides make a grid; a task takes the queries of one tile and a strip of candidate tiles, and gives a count per
    query. So what is moved depends on the tiles, not on the number of tasks. Scores within ``TIE`` of
    ``best`` count as equal, because the order of a sum is free.
    """
    strips = -(-len(candidates.tiles) // STRIP)
    bars = best.groupBy("tile").agg(F.collect_list("row").alias("rows"), F.collect_list("best").alias("bests"))
    if strips > 1:
        bars = bars.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
        bars = bars.repartition(min(strips * len(queries.tiles), 1 << 16), "tile", "strip")
    else:
        bars = bars.withColumn("strip", F.lit(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_query, read_candidate = queries.reader(), candidates.reader()
        for batch in batches:
            for i, (tile, strip) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                rows = batch.column(1)[i].values.to_numpy()
                bar = _bar(batch.column(2)[i].values.to_numpy())
                matrix = read_query(queries.tiles[tile])[1][rows]
                lengths = np.linalg.norm(matrix, axis=1)
                total = np.zeros(len(rows), dtype=np.int64)
                for other in candidates.tiles[strip * STRIP : (strip + 1) * STRIP]:
                    wanted = np.flatnonzero(other.reach(lengths, "dot") > bar)
                    if len(wanted):
                        reference = read_candidate(other)[1]
                        for part, product in _products(matrix[wanted], reference):
                            total[wanted[part]] += (product > bar[wanted[part], None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), tile, np.int32)), pa.array(rows), pa.array(total)], ["tile", "row", "ahead"]
                )

    counted = bars.select("tile", "rows", "bests", "strip").mapInArrow(count, "tile int, row int, ahead bigint")
    return counted if strips == 1 else counted.groupBy("tile", "row").agg(F.sum("ahead").alias("ahead"))


def _bar(best: np.ndarray) -> np.ndarray:
    return best + TIE * np.maximum(1.0, np.abs(best))
