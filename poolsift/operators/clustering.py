"""k-means over an embedding column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.functions.ids import seeded_hex
from poolsift.functions.vectors import l2_normalize, norm
from poolsift.operators.layout import coarse_hex, hex_bucket, ordinals
from poolsift.operators.nearest import best_in_tiles, best_of, centroid_tiles, nearest
from poolsift.operators.sizing import fetch_if_small
from poolsift.operators.tiles import TILE_BYTES, Tiles, to_matrix, write_tiles
from poolsift.session import run_dir
from poolsift.sources.storage import drop_dir

#: Per-cluster sums a task holds before it sends them on.
PARTIAL_BYTES = 1 << 28

_PARTIAL = T.StructType(
    [
        T.StructField("centroid_id", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.ArrayType(T.DoubleType())),
    ]
)


def assign(points: DataFrame, centroids: DataFrame, vec: str = "vec", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Nearest centroid by inner product (what the filters use)."""
    return nearest(points, centroids, vec=vec, keys=keys, metric="dot")


def kmeans_step(
    points: DataFrame,
    centroids: DataFrame | Tiles,
    vec: str = "vec",
    keys: Sequence[str] = ("uid",),
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """One Lloyd step in L2: ``centroid_id, n, centroid`` of the clusters that got points.

    Each task adds up its points per cluster before the shuffle, so what is moved is at
    most one vector per cluster and task, however large a cluster is.
    """
    tiles = centroids if isinstance(centroids, Tiles) else centroid_tiles(centroids, tile_bytes)
    partial = points.select(vec).mapInArrow(_summed_by_match(tiles), _PARTIAL)
    together = partial.repartition("centroid_id").sortWithinPartitions("centroid_id")
    return together.mapInArrow(_means, "centroid_id int, n long, centroid array<double>")


def _totals(labels: np.ndarray, rows: np.ndarray, sums: dict[int, list]) -> None:
    order = np.argsort(labels, kind="stable")
    ids, starts = np.unique(labels[order], return_index=True)
    if not len(ids):
        return
    added = np.add.reduceat(rows[order], starts, axis=0)
    sizes = np.diff(np.append(starts, len(labels)))
    for i, n, total in zip(ids.tolist(), sizes.tolist(), added):
        held = sums.get(i)
        if held is None:
            sums[i] = [n, total]
        else:
            held[0] += n
            held[1] += total


def _partial_batch(sums: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """The sums as rows; empties the dictionary."""
    names = [f.name for f in _PARTIAL]
    items = sorted(sums.items())
    sums.clear()
    for start in range(0, len(items), 1024):
        some = items[start : start + 1024]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in some], pa.int32()),
                pa.array([held[0] for _, held in some], pa.int64()),
                pa.array([held[1] for _, held in some], pa.list_(pa.float64())),
            ],
            names=names,
        )


def _summed_by_match(tiles: Tiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = tiles.reader()
        sums: dict[int, list] = {}
        for batch in batches:
            rows, _ = to_matrix(batch.column(0), tiles.dim)
            labels, _ = best_in_tiles(rows, tiles, "l2", read)
            _totals(labels, rows, sums)
            if len(sums) * tiles.dim * 8 > PARTIAL_BYTES:
                yield from _partial_batch(sums)
        yield from _partial_batch(sums)

    return run


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means from partial sums sorted by cluster; holds one cluster at a time."""
    current, n, total = None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([current], pa.int32()),
                pa.array([n], pa.int64()),
                pa.array([total / n], pa.list_(pa.float64())),
            ],
            names=["centroid_id", "n", "centroid"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        dim = len(batch.column(2)[0])
        parts, _ = to_matrix(batch.column(2), dim)
        for part_id, part_n, part in zip(ids, sizes, parts):
            if part_id != current:
                if current is not None:
                    yield row()
                current, n, total = part_id, 0, np.zeros(dim)
            n += part_n
            total += part
    if current is not None:
        yield row()


def seed_centroids(
    points: DataFrame, k: int, seed: int, vec: str = "vec", keys: Sequence[str] = ("uid",)
) -> DataFrame:
    """``k`` points drawn by a seeded hash of their keys, numbered 0..k-1.

    The draw is the k smallest hashes; a cut-off a little above k/N on the hash
    leaves all but a few of the other points out of the numbering.
    """
    usable = points.filter(F.col(vec).isNotNull()).select(
        F.col(vec).cast("array<double>").alias("centroid"),
        seeded_hex(seed, *[F.col(c) for c in keys]).alias("_draw"),
    )
    n = usable.count()
    if k > n:
        raise ValueError(f"{k} clusters need at least as many points; there are {n}")
    share = min(1.0, (k + 6 * k**0.5 + 20) / n)
    cut = format(min(int(share * 16**12), 16**12 - 1), "012x") + "f" * 20
    drawn = usable.filter(F.col("_draw") <= cut)
    if drawn.count() < k:  # practically never; then the cut-off is dropped
        drawn = usable
    numbered = ordinals(drawn, hex_bucket(F.col("_draw"), 8), ["_draw"], output="_rank", coarse=coarse_hex)
    return numbered.filter(F.col("_rank") < k).select(
        F.col("_rank").cast("int").alias("centroid_id"), "centroid"
    )


def train_kmeans(
    points: DataFrame,
    k: int,
    iterations: int = 20,
    seed: int = 0,
    vec: str = "vec",
    keys: Sequence[str] = ("uid",),
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """``centroid_id, centroid`` after ``iterations`` Lloyd steps in L2 over all points.

    The points are written to the shared folder once and every step reads them there, so
    what made them is not worked out again. Starts from a seeded draw of points. A cluster that loses all its points keeps its
    centroid. The centroids of each step are written in the shared folder, so the
    lineage does not grow and a lost executor costs one step at most; those of the step before are deleted. Once no
    centroid moves, further steps would change nothing and are left out.
    """
    slim = points.select(*keys, vec)
    points, points_dir = _written(slim, "kmeans-points")
    centroids, folder = _written(seed_centroids(points, k, seed, vec, keys), "centroids")
    for _ in range(iterations):
        tiles = centroid_tiles(centroids, tile_bytes)
        moved = kmeans_step(points, tiles, vec, keys)
        joined = centroids.alias("old").join(moved.alias("new"), "centroid_id", "left")
        stays = F.col("new.centroid").isNull() | (F.col("new.centroid") == F.col("old.centroid"))
        following, next_folder = _written(joined.select("centroid_id", F.coalesce("new.centroid", "old.centroid").alias("centroid"), stays.alias("_stays")), "centroids")
        tiles.drop()
        drop_dir(folder)
        centroids, folder = following.drop("_stays"), next_folder
        if following.where("NOT _stays").isEmpty():
            break
    drop_dir(points_dir)
    return centroids


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a folder of its own and read from there, and the folder."""
    folder = run_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def inertia(points: DataFrame, centroids: DataFrame, vec: str = "vec", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """One row: points and the sum of squared distances to the nearest centroid."""
    squared = F.aggregate(
        F.col(vec), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    placed = nearest(points, centroids, vec, keys, "l2")
    return placed.agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(squared - 2 * F.col("score")).alias("inertia"),
    )


def centroid_sizes(assigned: DataFrame) -> DataFrame:
    """Number of points per centroid."""
    return assigned.groupBy("centroid_id").agg(F.count(F.lit(1)).alias("size"))


def class_prototypes(
    vectors: DataFrame, by: Sequence[str], vec: str = "vec", output: str = "prototype"
) -> DataFrame:
    """Mean of the (already normalised) template vectors per class, scaled to length one.

    ``by`` is the class, or (objective, class): each objective keeps its own classes, so
    no padding of unequal class counts is needed. Sums are taken per position with
    map-side combine; the arrays that are put together again have one entry per dimension.
    """
    means = (
        vectors.select(*by, F.posexplode(vec).alias("pos", "x"))
        .groupBy(*by, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_parts"))
        .select(*by, F.col("_parts.x").alias("_mean"))
        .withColumn("_norm", norm(F.col("_mean")))
    )
    return means.select(*by, l2_normalize(F.col("_mean"), F.col("_norm")).alias(output))


def predict_objectives(
    points: DataFrame, prototypes: DataFrame, vec: str = "vec", output: str = "pred_{}"
) -> DataFrame:
    """``points`` with the best class of every objective, one column each.

    ``prototypes`` is ``objective, class_id, prototype``. An objective's class of the largest inner
    product wins (lowest class on ties), so objectives may differ in their number of classes,
    which has no limit. Points without a usable vector get null. Every objective is a column, so their names must be few.
    """
    held = prototypes.persist()  # worked out once for all objectives
    try:
        names = fetch_if_small(held.select("objective").distinct())
        if names is None:
            raise ValueError("too many objectives for a column each")
        result = points
        for objective in sorted(names.column(0).to_pylist()):
            own = held.filter(F.col("objective") == F.lit(objective))
            tiles = write_tiles(own, "class_id", "prototype")
            result = best_of(result, tiles, vec, "dot", "_best")
            result = result.withColumn(output.format(objective), F.col("_best.id")).drop("_best")
        return result
    finally:
        held.unpersist()
