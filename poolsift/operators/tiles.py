"""Vectors in the shared folder, in tiles that any task can read.

A tile is an Arrow file with ids, vectors and the columns that belong to them, in id order. Tasks write the tiles of their own
rows, so nothing is shuffled and no vector passes through the driver, which holds a line per tile: its place, its
rows and the least and greatest length of its vectors. Where the shared folder is a mounted file system, tiles are mapped
into memory: all Python workers of a machine share one copy, and the system drops it under pressure. On an
object store a task keeps the last few tiles it read.

The lengths bound every product (``x.c <= |x| |c|``), so tiles that cannot change a result are never opened.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.session import run_dir
from poolsift.sources.storage import atomic_output, drop_dir, locate

#: Bytes of the vectors of one tile.
TILE_BYTES = 64 << 20
#: Tiles a task keeps open.
HELD = 4

_LISTED = "name string, rows bigint, least int, most int, low double, high double"


def to_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array as doubles, and a mask of the rows that are usable.

    NULL vectors and vectors of another length are masked out.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    usable = lengths == dim
    if not usable.all():
        vectors = vectors.filter(pa.array(usable))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(-1, dim), usable


@dataclass(frozen=True)
class Tile:
    name: str
    rows: int
    low: float
    high: float

    def reach(self, lengths: np.ndarray, metric: str) -> np.ndarray:
        """No vector of the tile scores above this with a vector of the given length; a little is added for rounding."""
        most = lengths * self.high
        if metric == "l2":
            near = np.clip(lengths, self.low, self.high)
            most = lengths * near - 0.5 * near * near
        return most + 1e-9 * (1.0 + lengths * self.high + self.high * self.high)


@dataclass(frozen=True)
class Tiles:
    """Where the tiles of a table lie; the longest vectors come first."""

    folder: str
    dim: int
    tiles: tuple[Tile, ...]
    id_type: T.DataType

    @property
    def rows(self) -> int:
        return sum(tile.rows for tile in self.tiles)

    def drop(self) -> None:
        """Delete the tiles; nothing may read them any more."""
        drop_dir(self.folder)

    def reader(self) -> Callable[[Tile], tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        """A function that opens a tile: ids, matrix, and all its columns. For use inside one task."""
        held: OrderedDict[str, tuple] = OrderedDict()

        def read(tile: Tile) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
            if tile.name not in held:
                system, place = locate(posixpath.join(self.folder, tile.name))
                if isinstance(system, fs.LocalFileSystem):
                    source = pa.memory_map(place)
                else:
                    source = pa.BufferReader(system.open_input_file(place).read_buffer())
                batch = pa.ipc.open_file(source).get_batch(0)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                held[tile.name] = ids, batch.column(1).flatten().to_numpy().reshape(-1, self.dim), batch
                while len(held) > HELD:
                    held.popitem(last=False)
            held.move_to_end(tile.name)
            return held[tile.name]

        return read


def _stored(folder: str, ids: pa.Array, matrix: np.ndarray, rest: Sequence[pa.Array], names: Sequence[str]) -> tuple:
    """Write one tile; its line of the listing."""
    order = pa.compute.sort_indices(ids).to_numpy()
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(matrix[order].reshape(-1)), matrix.shape[1])
    columns = [ids.take(pa.array(order)), vectors, *[c.take(pa.array(order)) for c in rest]]
    batch = pa.RecordBatch.from_arrays(columns, ["id", "vec", *names])
    name = f"tile-{uuid.uuid4().hex}.arrow"
    with atomic_output(posixpath.join(folder, name)) as out, pa.ipc.new_file(out, batch.schema) as file:
        file.write_batch(batch)
    lengths = np.linalg.norm(matrix, axis=1)
    return name, len(matrix), matrix.shape[1], matrix.shape[1], float(lengths.min()), float(lengths.max())


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["name", "rows", "least", "most", "low", "high"])


def write_tiles(
    table: DataFrame, id_col: str, vector: str, extra: Sequence[str] = (), tile_bytes: int = TILE_BYTES
) -> Tiles:
    """The vectors of ``table`` as tiles of at most ``tile_bytes``; rows without a vector are left out.

    ``table`` is read once. A retried task writes tiles of other names, which no listing names. Very
    small tiles are put together by a second job.
    """
    spark = table.sparkSession
    folder = run_dir(spark, "tiles")
    slim = table.select(F.col(id_col).alias("id"), F.col(vector).alias("vec"), *extra).filter("vec IS NOT NULL")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, lines = [], 0, []

        def flush() -> None:
            nonlocal held, rows
            whole = pa.Table.from_batches(held).combine_chunks()
            matrix, _ = to_matrix(whole["vec"], dim)
            rest = [whole[c].combine_chunks() for c in extra]
            lines.append(_stored(folder, whole["id"].combine_chunks(), matrix, rest, extra))
            held, rows = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).value_lengths().to_numpy()
            dim = int(sizes[0])
            if (sizes != dim).any() or held and len(held[0].column(1)[0]) != dim:
                lines = [("", 0, int(sizes.min()), int(sizes.max()) + 1, 0.0, 0.0)]
                held = []
                break
            step = max(1, tile_bytes // (8 * max(1, dim)))
            while batch.num_rows:
                take = min(batch.num_rows, step - rows)
                held.append(batch.slice(0, take))
                rows += take
                batch = batch.slice(take)
                if rows == step:
                    flush()
        if held:
            flush()
        yield _listing(lines)

    listed = slim.mapInArrow(write, _LISTED).collect()  # a line per tile
    if not listed:
        raise ValueError("the reference table holds no vectors")
    low, high = min(r.least for r in listed), max(r.most for r in listed)
    if low != high:
        raise ValueError(f"reference vectors differ in length: {low} to {high}")
    kind = slim.schema["id"].dataType
    tiles = Tiles(folder, high, _ordered(listed), kind)
    step = max(1, tile_bytes // (8 * max(1, high)))
    if len(listed) > 8 and 4 * tiles.rows < step * len(listed):
        tiles = _merged(spark, tiles, step, extra)
    return tiles


def _ordered(listed: list) -> tuple[Tile, ...]:
    return tuple(sorted((Tile(r.name, r.rows, r.low, r.high) for r in listed), key=lambda t: (-t.high, t.name)))


def _merged(spark: SparkSession, tiles: Tiles, step: int, extra: Sequence[str]) -> Tiles:
    """Neighbours in the listing put together, up to ``step`` rows each."""
    groups: list[list[Tile]] = []
    for tile in tiles.tiles:
        if not groups or sum(t.rows for t in groups[-1]) + tile.rows > step:
            groups.append([])
        groups[-1].append(tile)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = tiles.reader()
        for batch in batches:
            for place in batch.column(0).to_pylist():
                whole = pa.Table.from_batches([read(tile)[2] for tile in groups[place]]).combine_chunks()
                matrix = whole["vec"].combine_chunks().flatten().to_numpy().reshape(-1, tiles.dim)
                rest = [whole[c].combine_chunks() for c in extra]
                yield _listing([_stored(tiles.folder, whole["id"].combine_chunks(), matrix, rest, extra)])

    places = spark.range(len(groups), numPartitions=len(groups))
    return Tiles(tiles.folder, tiles.dim, _ordered(places.mapInArrow(merge, _LISTED).collect()), tiles.id_type)
