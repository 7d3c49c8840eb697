"""Embedding archives (``.npz``) next to their metadata, and plain parquet for everything after that.

Row i of ``<stem>.npz`` belongs to row i of ``<stem>.parquet``. The metadata is scanned and filtered as any parquet, with the place
of every row; :func:`attach_vectors` then reads the vectors of the rows that are left, as byte ranges of the archive, inside
the task that has them. So no vector of a dropped row is made, nothing is shuffled, and a file of many
gigabytes is as many partitions as Spark splits its metadata into. A compressed archive cannot be entered in the
middle: its task reads from the start up to the rows it needs.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift import schema
from poolsift.functions.text import single_line
from poolsift.operators.sizing import spread
from poolsift.sources.storage import READ_AHEAD, atomic_output, open_input
from poolsift.sources.tables import list_files

#: Vectors per Arrow batch.
BATCH_ROWS = 4096
#: Bytes of vectors that one range of an archive holds.
RANGE_BYTES = 64 << 20


@dataclass(frozen=True)
class Member:
    """Where the array of an archive lies. ``offset`` is the first vector's byte, None in a compressed archive."""

    rows: int
    dim: int
    dtype: np.dtype
    offset: int | None

    @property
    def row_bytes(self) -> int:
        return self.dim * self.dtype.itemsize


class VectorFile:
    """The two-dimensional array ``key`` of an open archive, by rows. Half precision becomes single."""

    def __init__(self, path: str, key: str) -> None:
        self.file = open_input(path)
        self.archive = zipfile.ZipFile(self.file)
        self.info = self.archive.getinfo(f"{key}.npy")
        with self.archive.open(self.info) as member:
            version = np.lib.format.read_magic(member)
            header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, by_column, dtype = header(member)
            self.begin = member.tell()
        if len(shape) != 2 or by_column:
            raise ValueError(f"{path} holds an array of shape {shape} under {key!r}, not one row per vector")
        offset = None
        if self.info.compress_type == zipfile.ZIP_STORED:
            self.file.seek(self.info.header_offset)
            local = self.file.read(30)
            offset = self.info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + self.begin
        self.member = Member(shape[0], shape[1], dtype, offset)
        self.stream, self.at = None, 0

    def rows(self, low: int, high: int) -> np.ndarray:
        """Vectors ``low`` to ``high``; going on from the last read is cheap in any archive."""
        member = self.member
        if not 0 <= low <= high <= member.rows:
            raise ValueError(f"rows {low} to {high} of an archive of {member.rows}")
        size = (high - low) * member.row_bytes
        if member.offset is not None:
            self.file.seek(member.offset + low * member.row_bytes)
            raw = self.file.read(size)
        else:
            if self.stream is None or low < self.at:
                self.stream = self.archive.open(self.info)
                self.stream.read(self.begin)
                self.at = 0
            left = (low - self.at) * member.row_bytes
            while left:
                left -= len(self.stream.read(min(left, READ_AHEAD)))
            raw, self.at = self.stream.read(size), high
        return np.frombuffer(raw, member.dtype).reshape(high - low, member.dim).astype(np.float32, copy=False)

    def pick(self, places: np.ndarray) -> np.ndarray:
        """The vectors at increasing places; neighbours and short gaps are one read."""
        out = np.empty((len(places), self.member.dim), np.float32)
        gap = max(1, READ_AHEAD // max(1, self.member.row_bytes))
        most = max(1, RANGE_BYTES // max(1, self.member.row_bytes))
        start = 0
        while start < len(places):
            end = start + 1
            while end < len(places) and places[end] - places[end - 1] <= gap and places[end] - places[start] < most:
                end += 1
            low = int(places[start])
            out[start:end] = self.rows(low, int(places[end - 1]) + 1)[places[start:end] - low]
            start = end
        return out

    def close(self) -> None:
        self.archive.close()
        self.file.close()


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, dim = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(matrix).ravel()))


def _stem(path: str) -> str:
    return posixpath.basename(path).removesuffix(".npz")


def _members(spark: SparkSession, path: str, key: str, schema_: str, lines) -> DataFrame:
    """Rows that ``lines(path, member)`` gives of every archive; only headers are read."""
    names = list_files(spark, path, "*.npz").select("path")
    arrow = spark.createDataFrame([], schema_).toArrow().schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                archive = VectorFile(name, key)
                archive.close()
                yield pa.RecordBatch.from_pylist(list(lines(name, archive.member)), arrow)

    return names.mapInArrow(read, schema_)


def read_npz(spark: SparkSession, path: str, key: str = "l14_img") -> DataFrame:
    """``file_stem, row_idx, vec`` from the two-dimensional array ``key`` of every ``.npz`` file.

    Archives are cut into ranges of :data:`RANGE_BYTES` that are dealt to all tasks, so a large one is work for many. Only names
    and row numbers go through the plan; no file passes through the JVM as one value.
    """

    def ranges(name: str, member: Member) -> Iterator[dict]:
        step = max(1, RANGE_BYTES // max(1, member.row_bytes)) if member.offset is not None else max(1, member.rows)
        for low in range(0, member.rows, step):
            yield {"path": name, "low": low, "high": min(low + step, member.rows)}

    cut = spread(_members(spark, path, key, "path string, low long, high long", ranges), "path", "low")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                archive = VectorFile(part["path"], key)
                for low in range(part["low"], part["high"], BATCH_ROWS):
                    matrix = archive.rows(low, min(low + BATCH_ROWS, part["high"]))
                    columns = [pa.array([_stem(part["path"])] * len(matrix)), pa.array(np.arange(low, low + len(matrix))), _lists(matrix)]
                    yield pa.RecordBatch.from_arrays(columns, ["file_stem", "row_idx", "vec"])
                archive.close()

    return cut.mapInArrow(read, schema.EMBEDDINGS)


def npz_lengths(spark: SparkSession, path: str, key: str = "l14_img") -> DataFrame:
    """``file_stem, vector_rows`` of every archive, from the array's header alone."""
    return _members(
        spark, path, key, "file_stem string, vector_rows long", lambda name, member: [{"file_stem": _stem(name), "vector_rows": member.rows}]
    )


def attach_vectors(rows: DataFrame, key: str = "l14_img", output: str = "vec", path: str = "vector_path", place: str = "row_idx") -> DataFrame:
    """``rows`` with the vector at row ``place`` of the archive ``path``, which is read inside the task.

    Rows may be any part of the metadata; scans keep their order, so the places of a file increase and are read in a few ranges.
    """
    wanted = T.StructType([*[f for f in rows.schema.fields if f.name != output], T.StructField(output, T.ArrayType(T.FloatType()))])
    kept = [c for c in rows.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, opened = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column(kept.index(path)).dictionary_encode()
            codes, places = paths.indices.to_numpy(), batch.column(kept.index(place)).to_numpy()
            order = np.lexsort((places, codes))
            parts = []
            for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                name = unquote(paths.dictionary[int(codes[at[0]])].as_py())
                if name != opened:
                    if archive is not None:
                        archive.close()
                    archive, opened = VectorFile(name, key), name
                parts.append(_lists(archive.pick(places[at])))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            vectors = pa.concat_arrays(parts)
            if (order != np.arange(len(order))).any():
                vectors = vectors.take(pa.array(back))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*kept, output])
        if archive is not None:
            archive.close()

    return rows.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, wanted)


def write_with_vectors(rows: DataFrame, path: str, vec: str = "vec", key: str = "l14_img", half: bool = False) -> DataFrame:
    """Each task's rows as ``<number>.parquet`` and their vectors as ``<number>.npz``; returns ``file_stem, rows`` of the files.

    A retried task replaces its own files. A task holds its rows until they are written, so give it as many as one file should have.
    """
    kept = [c for c in rows.columns if c != vec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        stem = f"{TaskContext.get().partitionId():08d}"
        vectors = whole[vec].combine_chunks()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if vectors.null_count or (sizes != sizes[0]).any():
            raise ValueError("every row needs a vector, all of one length")
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1).astype(np.float16 if half else np.float32, copy=False)
        with atomic_output(posixpath.join(path, f"{stem}.npz")) as out:
            np.savez(out, **{key: matrix})
        with atomic_output(posixpath.join(path, f"{stem}.parquet")) as out:
            pq.write_table(whole.select(kept), out)
        yield pa.RecordBatch.from_arrays([pa.array([stem]), pa.array([len(sizes)], pa.int64())], ["file_stem", "rows"])

    return rows.sparkSession.createDataFrame(rows.select(*kept, vec).mapInArrow(run, "file_stem string, rows long").toArrow())


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors or centroids as parquet, the form every operator here reads."""
    df.write.mode("overwrite").parquet(path)


def embed_with(df: DataFrame, fn, output_schema: str) -> DataFrame:
    """Run a user function over batches: ``fn(iterator of pandas frames) -> frames``.

    ``fn`` loads its model once per task, before the first batch. The rows per batch are
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    return df.mapInPandas(fn, output_schema)


def detect_language(df: DataFrame, make_detector, text: str = "text", output: str = "lang") -> DataFrame:
    """Add a language code from a pluggable detector.

    ``make_detector()`` runs once per task and returns ``texts -> codes``. Texts come as
    single lines, NULL texts get NULL.
    """

    @F.pandas_udf("string")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = make_detector()
        for texts in batches:
            known = texts.notna()
            codes = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if known.any():
                codes[known] = list(detector(texts[known].tolist()))
            yield codes

    return df.withColumn(output, detect(single_line(F.col(text))))
