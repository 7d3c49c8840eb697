"""Subset files as a Spark data source.

A subset file is a run of 16-byte records, two little-endian unsigned 64-bit numbers
(upper and lower half of a sample id), sorted, either inside a ``.npy`` file or bare.

    register(spark)
    spark.read.format("subset_ids").load(path)            # uid string
    sorted_subset(ids).write.format("subset_ids").mode("overwrite").save(folder)

Reading cuts a file into ranges of records, one per partition, so a file of many
gigabytes is read by many tasks. Writing gives one part per partition plus a
``_parts.json`` that lists the parts in id order; bare parts (option ``raw``) put end to
end in that order are a valid bare subset file.

The listing is what makes parts a subset: the reader of a folder with a listing reads
the listed parts alone, so parts that a retried or speculative task left behind never count. A
new run replaces the listing in one move and then deletes what it does not name. Appending to a
subset is refused, and so is a folder whose parts have no listing (a run that broke off).
"""

from __future__ import annotations

import binascii
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from poolsift.operators.subsets import sorted_subset
from poolsift.sources.storage import atomic_output, delete_files, entries, files_under, open_input, write_text

RECORD = np.dtype("<u8,<u8")
MAGIC = b"\x93NUMPY"
SUFFIXES = (".npy", ".bin")
PARTS = "_parts.json"
PART_NAME = re.compile(r"part-[0-9]{6}-[0-9a-f]{8}\.(npy|bin)")
#: Records per input partition (64 MB) and per batch.
RECORDS_PER_PARTITION = 1 << 22
RECORDS_PER_BATCH = 1 << 16


def to_uids(records: bytes) -> pa.Array:
    """Hex ids of packed records."""
    halves = np.frombuffer(records, dtype="<u8").astype(">u8")
    text = binascii.hexlify(halves.tobytes())
    n = len(text) // 32
    offsets = np.arange(n + 1, dtype=np.int32) * 32
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text))


def to_records(uids: pa.Array) -> bytes:
    """Packed records of hex ids; every id must be canonical (32 digits)."""
    joined = "".join(uids.to_pylist())
    if len(joined) != 32 * len(uids):
        raise ValueError("ids must have exactly 32 hex digits; use canonical_uid first")
    return np.frombuffer(binascii.unhexlify(joined), dtype=">u8").astype("<u8").tobytes()


@dataclass
class RecordRange(InputPartition):
    path: str
    offset: int
    records: int


@dataclass
class PartWritten(WriterCommitMessage):
    partition: int
    name: str
    records: int


def _layout(path: str, size: int) -> tuple[int, int]:
    """Byte offset of the first record and number of records."""
    with open_input(path) as file:
        if file.read(6) != MAGIC:
            if size % RECORD.itemsize:
                raise ValueError(f"{path} is not a whole number of 16-byte records")
            return 0, size // RECORD.itemsize
        file.seek(0)
        version = np.lib.format.read_magic(file)
        read_header = {
            (1, 0): np.lib.format.read_array_header_1_0,
            (2, 0): np.lib.format.read_array_header_2_0,
        }[version]
        shape, _, dtype = read_header(file)
        if dtype != RECORD or len(shape) != 1:
            raise ValueError(f"{path} holds {dtype} of shape {shape}, not pairs of uint64")
        return file.tell(), shape[0]


def listed_files(path: str) -> list:
    """The file itself, the listed parts of a folder in order, or all files of a foreign folder."""
    found = files_under(path, SUFFIXES)
    if not any(entry.base_name == PARTS for entry in _folder(path)):
        if any(PART_NAME.fullmatch(posixpath.basename(f.path)) for f in found):
            raise ValueError(f"{path} holds parts without {PARTS}: the run that wrote them did not end")
        return found
    with open_input(posixpath.join(path, PARTS)) as listing:
        names = [part["name"] for part in json.load(listing)]
    by_name = {posixpath.basename(f.path): f for f in found}
    if missing := [n for n in names if n not in by_name]:
        raise FileNotFoundError(f"{path} lacks listed parts: {missing[:3]}")
    return [by_name[n] for n in names]


def _folder(path: str) -> list:
    return [] if path.endswith(SUFFIXES) else entries(path)


class SubsetReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[RecordRange]:
        ranges = []
        for file in listed_files(self.path):
            offset, records = _layout(file.path, file.size)
            for start in range(0, records, RECORDS_PER_PARTITION):
                count = min(RECORDS_PER_PARTITION, records - start)
                ranges.append(RecordRange(file.path, offset + 16 * start, count))
        return ranges or [RecordRange("", 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if not partition.records:
            return
        with open_input(partition.path) as file:
            file.seek(partition.offset)
            left = partition.records
            while left:
                count = min(left, RECORDS_PER_BATCH)
                yield pa.RecordBatch.from_arrays([to_uids(file.read(16 * count))], names=["uid"])
                left -= count


class SubsetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, raw: bool) -> None:
        self.path = path
        self.raw = raw

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartWritten:
        partition = TaskContext.get().partitionId()
        suffix = ".bin" if self.raw else ".npy"
        name = f"part-{partition:06d}-{uuid.uuid4().hex[:8]}{suffix}"
        body = f"{self.path}/{name}"
        # The .npy header states the number of records, so the part is held until its
        # end; a part is one sorted range of at most a few million 16-byte records.
        chunks, last, records = [], "", 0
        for batch in iterator:
            uids = batch.column("uid")
            if not len(uids):
                continue
            inside = pc.all(pc.less_equal(uids[:-1], uids[1:])).as_py() is not False
            if uids[0].as_py() < last or not inside:
                raise ValueError("subset ids must arrive sorted; use orderBy('uid')")
            last = uids[-1].as_py()
            chunks.append(to_records(uids))
            records += len(uids)
        if not records:
            return PartWritten(partition, "", 0)
        with atomic_output(body) as out:
            if not self.raw:
                header = {"descr": RECORD.descr, "fortran_order": False, "shape": (records,)}
                np.lib.format.write_array_header_1_0(out, header)
            for chunk in chunks:
                out.write(chunk)
        return PartWritten(partition, name, records)

    def commit(self, messages: list[PartWritten | None]) -> None:
        parts = sorted((m for m in messages if m and m.records), key=lambda m: m.partition)
        listing = [{"name": m.name, "records": m.records} for m in parts]
        write_text(posixpath.join(self.path, PARTS), json.dumps(listing))
        listed = {m.name for m in parts}
        delete_files(self.path, [e.base_name for e in entries(self.path) if PART_NAME.fullmatch(e.base_name) and e.base_name not in listed])

    def abort(self, messages: list[PartWritten | None]) -> None:
        """An earlier subset in the folder stays as it was."""
        delete_files(self.path, [m.name for m in messages if m and m.name])


class SubsetIds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subset_ids"

    def schema(self) -> str:
        return "uid string"

    def reader(self, schema: StructType) -> SubsetReader:
        return SubsetReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SubsetWriter:
        path = self.options["path"]
        if not overwrite and entries(path):
            raise FileExistsError(f"{path} is not empty; write a subset with mode overwrite")
        return SubsetWriter(path, self.options.get("raw", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SubsetIds)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """``uid`` of a subset file, or of a folder of parts."""
    register(spark)
    return spark.read.format("subset_ids").load(path)


def write_subset(ids: DataFrame, path: str, raw: bool = False) -> None:
    """Sort ids over all tasks and write them as parts in order; an earlier subset there is replaced."""
    register(ids.sparkSession)
    sorted_subset(ids).write.format("subset_ids").option("raw", str(raw)).mode("overwrite").save(path)
