"""Tar shards: reading their members and samples, and writing new shards.

Only file names, byte ranges and ids go through the plan. Sample bytes are read by the
task that writes them, so images pass neither the JVM nor a shuffle.
"""

from __future__ import annotations

import contextlib
import io
import json
import posixpath
import random
import re
import tarfile
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.sources.storage import atomic_output, open_input, write_text
from poolsift.sources.tables import list_files

MEMBER_NAME = re.compile(r"^((?:.*/|)[^.]+)[.]([^/]*)$")
#: Bytes of member data per batch that leaves a task.
BATCH_BYTES = 1 << 26
BATCH_ROWS = 1 << 14
#: Samples and their bytes that a mixed output shard holds back.
MIX_SAMPLES, MIX_BYTES = 4_096, 1 << 28
#: Input shards a copying task keeps open.
OPEN_SHARDS = 64

MEMBERS = (
    "path string, shard string, member_idx long, name string, prefix string, suffix string,"
    " size long, data binary, error string"
)
INDEX = (
    "path string, shard string, sample_idx long, key string, suffixes array<string>,"
    " data_at array<long>, sizes array<long>, bytes long, uid string, error string"
)
#: What a planned copy must know of its sample.
SOURCE = ("path", "suffixes", "data_at", "sizes")
WRITTEN = "shard_name string, successes long, bytes long, failed long"


def _members(file) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo, str, str]]:
    """Regular members with a usable name; others are stepped over."""
    with tarfile.open(fileobj=file, mode="r:") as archive:
        while (info := archive.next()) is not None:
            archive.members = []  # the archive would remember every header otherwise
            match = MEMBER_NAME.match(info.name)
            if info.isfile() and match:
                yield archive, info, match.group(1), match.group(2).lower()
        file.seek(0, io.SEEK_END)
        if 0 < file.tell() - archive.offset < tarfile.BLOCKSIZE:
            raise tarfile.ReadError("the shard ends inside a header")


def _data(archive: tarfile.TarFile, info: tarfile.TarInfo) -> bytes:
    return archive.extractfile(info).read()


def _padded(size: int) -> int:
    return -(-size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE


def read_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Every member of the shards under ``path``; data only for the given suffixes (default all).

    A shard that cannot be read to its end gives one row with ``error`` after its readable
    members; the job goes on.
    """
    names = list_files(spark, path, "*.tar").select("path")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MEMBERS.split(",")]
        rows, held = [], 0
        for frame in frames:
            for name in frame["path"]:
                shard, index = posixpath.basename(name), 0
                try:
                    with open_input(name) as file:
                        for archive, info, prefix, suffix in _members(file):
                            wanted = suffixes is None or suffix in suffixes
                            data = _data(archive, info) if wanted else None
                            rows.append((name, shard, index, info.name, prefix, suffix, info.size, data, None))
                            index += 1
                            held += len(data or b"")
                            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, held = [], 0
                except Exception as problem:  # noqa: BLE001 - any bad shard is reported, not fatal
                    rows.append((name, shard, index, None, None, None, None, None, repr(problem)))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return names.mapInPandas(read, MEMBERS)


def _group(members: Iterator[tuple[str, str, object]]) -> Iterator[tuple[str, list[tuple[str, object]]]]:
    """Samples: runs of one prefix, cut as well where a suffix repeats inside the run."""
    prefix, held, seen = None, [], set()
    for this, suffix, value in members:
        if this != prefix or suffix in seen:
            if prefix is not None:
                yield prefix, held
            prefix, held, seen = this, [], set()
        held.append((suffix, value))
        seen.add(suffix)
    if prefix is not None:
        yield prefix, held


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``shard, sample_idx, key, members`` (suffix to bytes), ``error``. Samples without ``json`` are kept.

    A shard that cannot be read to its end gives one row with ``error`` (and no key) after its
    readable samples; the job goes on.
    """
    names = list_files(spark, path, "*.tar").select("path")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shard", "sample_idx", "key", "members", "error"]
        rows, held = [], 0
        for frame in frames:
            for name in frame["path"]:
                shard, index = posixpath.basename(name), -1
                try:
                    with open_input(name) as file:
                        stream = ((p, s, _data(a, i)) for a, i, p, s in _members(file))
                        for index, (key, parts) in enumerate(_group(stream)):
                            rows.append((shard, index, key, dict(parts), None))
                            held += sum(len(d) for _, d in parts)
                            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, held = [], 0
                except Exception as problem:  # noqa: BLE001 - any bad shard is reported, not fatal
                    rows.append((shard, index + 1, None, None, repr(problem)))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return names.mapInPandas(
        read, "shard string, sample_idx long, key string, members map<string,binary>, error string"
    )


def shard_number(name: Column) -> Column:
    """The number at the end of a shard's name (NULL without one)."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+)\.tar$", 1), F.lit("")).try_cast("bigint")


def index_samples(
    spark: SparkSession, path: str, first_shard: int = 0, num_shards: int | None = None
) -> DataFrame:
    """One row per sample with its id and where its members lie; only JSON members are read.

    ``num_shards`` restricts it to the shards with these numbers in their names, from
    ``first_shard`` on; other shards are not opened.

    Worth writing to parquet once: every later subset of the same shards starts from it.
    ``error`` is set for samples without JSON or id, and for shards that break off.
    """
    names = list_files(spark, path, "*.tar").select("path")
    if first_shard or num_shards is not None:
        number = shard_number(F.col("path"))
        names = names.where(number >= first_shard)
        names = names if num_shards is None else names.where(number < first_shard + num_shards)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [
            "path", "shard", "sample_idx", "key", "suffixes", "data_at", "sizes", "bytes", "uid", "error",
        ]
        rows: list[tuple] = []
        for frame in frames:
            for name in frame["path"]:
                shard, index = posixpath.basename(name), -1
                try:
                    with open_input(name) as file:
                        stream = (
                            (p, s, (i.offset_data, i.size, _data(a, i) if s == "json" else None))
                            for a, i, p, s in _members(file)
                        )
                        for index, (key, parts) in enumerate(_group(stream)):
                            uid, error = _uid_of(parts)
                            places, sizes = [v[0] for _, v in parts], [v[1] for _, v in parts]
                            suffixes = [s for s, _ in parts]
                            rows.append(
                                (name, shard, index, key, suffixes, places, sizes, sum(sizes), uid, error)
                            )
                            if len(rows) >= BATCH_ROWS:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                except Exception as problem:  # noqa: BLE001
                    rows.append((name, shard, index + 1, None, None, None, None, None, None, repr(problem)))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return names.mapInPandas(read, INDEX)


def _uid_of(parts: list) -> tuple[str | None, str | None]:
    text = next((v[2] for s, v in parts if s == "json"), None)
    if text is None:
        return None, "no json member"
    try:
        uid = json.loads(text).get("uid")
    except (ValueError, AttributeError) as problem:
        return None, repr(problem)
    return (uid, None) if isinstance(uid, str) else (None, "no uid")


class ShardFile:
    """One output shard under a temporary name until it is closed."""

    def __init__(self, folder: str, name: str) -> None:
        self.name, self.folder = name, folder
        self.successes = self.bytes = self.failed = 0
        self._context = atomic_output(f"{folder}/{name}")
        self._out = self._context.__enter__()

    def add(self, key: str, members: dict[str, bytes]) -> None:
        blocks = []
        for suffix, data in members.items():
            info = tarfile.TarInfo(f"{key}.{suffix}")
            info.size = len(data)
            blocks += [info.tobuf(tarfile.GNU_FORMAT), data, bytes(_padded(len(data)) - len(data))]
        sample = b"".join(blocks)
        self._out.write(sample)
        self.bytes += len(sample)
        self.successes += 1

    def close(self) -> tuple[str, int, int, int]:
        ending = 2 * tarfile.BLOCKSIZE
        self._out.write(bytes(ending + -(self.bytes + ending) % tarfile.RECORDSIZE))
        self._context.__exit__(None, None, None)
        stats = posixpath.splitext(self.name)[0] + "_stats.json"
        write_text(f"{self.folder}/{stats}", json.dumps({"successes": self.successes}))
        return self.name, self.successes, self.bytes, self.failed

    def leave(self, problem: BaseException) -> None:
        """Give up: the temporary file goes."""
        with contextlib.suppress(type(problem)):
            self._context.__exit__(type(problem), problem, problem.__traceback__)


class MixedShard:
    """An output shard whose samples come in input order and are written in a drawn one.

    A buffer of bounded size holds samples; once it is full, each new one takes the place of a drawn one, which is written.
    The draws depend on the seed and the shard, so a repeated task writes the same file.
    """

    def __init__(self, shard: ShardFile, seed: str, most_bytes: int, most: int) -> None:
        self.shard, self.most_bytes, self.most = shard, most_bytes, most
        self.draw, self.held, self.size = random.Random(seed), [], 0

    def add(self, key: str, members: dict[str, bytes]) -> None:
        self.held.append((key, members))
        self.size += sum(map(len, members.values()))
        while len(self.held) > self.most or self.size > self.most_bytes and len(self.held) > 1:
            self._write()

    def _write(self) -> None:
        at = self.draw.randrange(len(self.held))
        self.held[at], self.held[-1] = self.held[-1], self.held[at]
        key, members = self.held.pop()
        self.size -= sum(map(len, members.values()))
        self.shard.add(key, members)

    def flush(self) -> None:
        while self.held:
            self._write()


def _shard_task(folder: str, name_format: str, members_of: Callable, mix: int | None = None) -> Callable:
    """A task body: rows sorted by shard in, one row of statistics per finished shard out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in WRITTEN.split(",")]
        current, shard, target = None, None, None

        def close() -> pd.DataFrame:
            if mix is not None:
                target.flush()
            return pd.DataFrame([shard.close()], columns=columns)

        with members_of() as fetch:
            try:
                for frame in frames:
                    for row in frame.itertuples(index=False):
                        if row.shard_id != current:
                            if shard is not None:
                                yield close()
                            current = row.shard_id
                            target = shard = ShardFile(folder, name_format.format(int(current)))
                            if mix is not None:
                                target = MixedShard(shard, f"{mix}-{int(current)}", MIX_BYTES, MIX_SAMPLES)
                        try:
                            members = fetch(row)
                        except Exception:  # noqa: BLE001 - an unreadable sample is counted
                            shard.failed += 1
                            continue
                        target.add(row.key, members)
                if shard is not None:
                    yield close()
            except BaseException as problem:
                if shard is not None:
                    shard.leave(problem)
                raise

    return run


def _by_shard(df: DataFrame, shards: int, max_tasks: int, *order: str) -> DataFrame:
    """Whole shards per task, by ranges of their numbers: neighbours in a task, no task without any."""
    tasks = max(1, min(shards, max_tasks))
    ranged = df.repartition(1) if tasks == 1 else df.repartitionByRange(tasks, "shard_id")
    return ranged.sortWithinPartitions("shard_id", *order)


class _InRow:
    """Members that are already a column."""

    def __enter__(self):
        return lambda row: dict(row.members)

    def __exit__(self, *_):
        return False


class _FromTar:
    """Members read from their places in a shard; keeps the last shards open."""

    def __init__(self, edit: Callable | None) -> None:
        self.edit, self.files = edit, OrderedDict()

    def __enter__(self):
        return self.fetch

    def __exit__(self, *_):
        for file in self.files.values():
            file.close()
        return False

    def _open(self, path: str):
        if path not in self.files:
            self.files[path] = open_input(path)
            while len(self.files) > OPEN_SHARDS:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(path)
        return self.files[path]

    def _read(self, path: str, place: int, size: int) -> bytes:
        file = self._open(path)
        file.seek(place)
        data = file.read(size)
        if len(data) != size:
            raise EOFError(f"{path} ends before {place + size}")
        return data

    def fetch(self, row) -> dict[str, bytes]:
        members = {
            suffix: self._read(row.path, int(place), int(size))
            for suffix, place, size in zip(row.suffixes, row.data_at, row.sizes)
        }
        boxes = getattr(row, "boxes_json", None)
        if boxes:
            fields = json.loads(members["json"])
            fields["face_bboxes"] = json.loads(boxes)
            members["json"] = json.dumps(fields).encode()
        return self.edit(members, boxes) if self.edit else members


def write_samples(
    samples: DataFrame, folder: str, shards: int, name_format: str = "{:08d}.tar", max_tasks: int = 20_000
) -> DataFrame:
    """Write ``shard_id, position, key, members`` as shards; returns their statistics.

    ``shards`` is the number of output shards, so that every task gets about one. The
    statistics are kept in ``<folder>/_shards`` and read back from there.
    """
    rows = _by_shard(samples.select("shard_id", "position", "key", "members"), shards, max_tasks, "position")
    return _run(rows, folder, name_format, _InRow)


def copy_samples(
    plan: DataFrame,
    folder: str,
    shards: int,
    name_format: str = "{:08d}.tar",
    edit: Callable | None = None,
    max_tasks: int = 20_000,
    mix: int | None = None,
) -> DataFrame:
    """Write planned copies: ``shard_id, position, key``, the columns of ``SOURCE``, maybe ``boxes_json``.

    With a seed ``mix`` the samples of a shard are read in the order of their sources and written in a drawn one, through a
    buffer of bounded size; so a task opens a source once, however its samples are to be mixed.

    ``boxes_json`` is written into the JSON member as ``face_bboxes``. ``edit(members, boxes)`` may
    change the members of a sample (blur an image, say).
    """
    columns = ["shard_id", "position", "key", *SOURCE]
    columns += ["boxes_json"] if "boxes_json" in plan.columns else []
    order = ["position"] if mix is None else ["path", "position"]
    rows = _by_shard(plan.select(*columns), shards, max_tasks, *order)
    return _run(rows, folder, name_format, lambda: _FromTar(edit), mix)


def _run(rows: DataFrame, folder: str, name_format: str, members_of: Callable, mix: int | None = None) -> DataFrame:
    written = rows.mapInPandas(_shard_task(folder, name_format, members_of, mix), WRITTEN)
    written.write.mode("overwrite").parquet(f"{folder}/_shards")
    return rows.sparkSession.read.parquet(f"{folder}/_shards")
