"""CSV files with quoted line breaks, read by many tasks, and the records that do not parse.

A line break ends a record unless it stands in quotes, so where records begin in the middle of a file depends on all that comes
before. A first pass over the byte ranges of large files finds, for each range, how it changes the state (inside quotes or not,
behind a backslash or not) whatever that was at its start; states are then followed along each file, one short row per range.
A second pass cuts the records that begin in a range. They are parsed by Spark, column by column; a record with another number
of fields, or with a value that is not of its column's type, is rejected with its place and its text.

Dialect: fields in double quotes may hold anything, a backslash takes the next character as it is. The first record of a file
may be a header. Files of one range are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.operators.sizing import spread
from poolsift.session import saved
from poolsift.sources.storage import open_input
from poolsift.sources.tables import list_files

#: Bytes of one range, and of one read.
RANGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
#: Bytes of the first read behind a range, for the record that leaves it.
TAIL_BYTES = 1 << 14
#: Characters with a meaning (fixed values): quote, backslash, line feed, carriage return.
QUOTE, BACKSLASH, LINE, RETURN = 34, 92, 10, 13


def scan(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, bool, bool]:
    """Places of line breaks that end a record, and the state behind ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), inside, escaped
    # a character is taken as it is behind an odd run of backslashes; only the places with a meaning are looked at
    slash = np.flatnonzero(data == BACKSLASH)
    last = np.flatnonzero(np.append(np.diff(slash) != 1, True)) if len(slash) else slash
    run_end = slash[last]
    run = np.diff(np.concatenate([[-1], last]))
    if escaped and len(slash) and slash[0] == 0:
        run[0] += 1
    taken = run_end[run % 2 == 1] + 1
    if escaped and data[0] != BACKSLASH:
        taken = np.append(0, taken)
    behind = bool(len(taken)) and int(taken[-1]) == n
    quotes, ends = np.flatnonzero(data == QUOTE), np.flatnonzero(data == LINE)
    if len(taken):
        plain = np.ones(n + 1, bool)
        plain[taken] = False
        quotes, ends = quotes[plain[quotes]], ends[plain[ends]]
    ends = ends[(np.searchsorted(quotes, ends) + inside) % 2 == 0]
    return ends, bool((len(quotes) + inside) % 2), behind


def _chunks(file, low: int, high: int, size: int) -> Iterator[np.ndarray]:
    """The bytes from ``low`` to ``high``, then those up to ``size`` in pieces that grow: a record that leaves its range is short as a rule."""
    file.seek(low)
    piece = TAIL_BYTES
    while low < size:
        if low < high:
            wanted = min(READ_BYTES, high - low)
        else:
            wanted, piece = min(piece, size - low), min(2 * piece, READ_BYTES)
        raw = file.read(wanted)
        if not raw:
            return
        low += len(raw)
        yield np.frombuffer(raw, np.uint8)


def _effect(path: str, low: int, high: int) -> list[int]:
    """The state behind a range (inside + 2 * escaped) for each state at its start."""
    # a quote at the start turns the state in quotes around all the way, so it is followed from outside only
    found = [(False, False), (False, True)]
    with open_input(path, TAIL_BYTES) as file:
        for data in _chunks(file, low, high, high):
            after = {escaped: scan(data, False, escaped)[1:] for escaped in {state[1] for state in found}}
            found = [(inside ^ after[escaped][0], after[escaped][1]) for inside, escaped in found]
    return [int(found[s >> 1][0] ^ (s & 1 == 1)) + 2 * int(found[s >> 1][1]) for s in range(4)]


def _records(path: str, low: int, high: int, state: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the records that begin in a range: at the start of the file, or behind a line break in the range."""
    inside, escaped = state & 1 == 1, state & 2 == 2
    begun = 0 if low == 0 else None
    held: list[bytes] = []
    with open_input(path, TAIL_BYTES) as file:
        place = low
        for data in _chunks(file, low, high, size):
            ends, inside, escaped = scan(data, inside, escaped)
            raw, start = data.tobytes(), 0
            for end in ends.tolist():
                if begun is not None:
                    yield begun, b"".join([*held, raw[start:end]])
                held = []
                begun, start = place + end + 1, end + 1
                if place + end >= high:
                    return
            if begun is not None:
                held.append(raw[start:])
            elif place + len(raw) >= high:
                return
            place += len(raw)
    if begun is not None and begun < size:
        yield begun, b"".join(held)


def _states(rows: pa.Table) -> pa.Table:
    """The state at the start of each range of one file."""
    order = np.argsort(rows["low"].to_numpy())
    state, states = 0, np.zeros(len(order), np.int32)
    effects = rows["effect"].to_pylist()
    for i in order.tolist():
        states[i] = state
        state = effects[i][state]
    return pa.table([rows["path"], rows["low"], rows["high"], rows["size"], pa.array(states)], ["path", "low", "high", "size", "state"])


def read_records(spark: SparkSession, path: str, range_bytes: int | None = None, glob: str = "*.csv") -> DataFrame:
    """``path, place, record``: every record of the files under ``path`` as text, and the byte it begins at. Blank ones are left out."""
    step = range_bytes or RANGE_BYTES
    files = list_files(spark, path, glob).where("length > 0").select("path", F.col("length").alias("size"))
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(step).cast("bigint"))).alias("low")
    ranges = files.select("path", "size", low).withColumn("high", F.least(F.col("low") + step, "size"))
    alone = ranges.where(F.col("size") <= step).select("path", "low", "high", "size", F.lit(0).alias("state"))

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_effect(r["path"], r["low"], r["high"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "effect"])

    large = spread(ranges.where(F.col("size") > step).select("path", "low", "high", "size"), "path", "low")
    large = large.mapInArrow(effects, "path string, low long, high long, size long, effect array<int>")
    followed = saved(large.groupBy("path").applyInArrow(_states, "path string, low long, high long, size long, state int"), "csv-states")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places, records, held = [], [], 0
                for place, record in _records(r["path"], r["low"], r["high"], r["state"], r["size"]):
                    record = record[:-1] if record[-1:] == bytes([RETURN]) else record
                    if record:
                        places.append(place)
                        records.append(record.decode("utf-8", "replace"))
                        held += len(record)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(places)), pa.array(places), pa.array(records)], ["path", "place", "record"])
                        places, records, held = [], [], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(records, pa.string())], ["path", "place", "record"]
                )

    return spread(alone.unionByName(followed), "path", "low").mapInArrow(cut, "path string, place long, record string")


def parse_records(records: DataFrame, columns: T.StructType, header: bool = True) -> DataFrame:
    """``records`` as ``columns``, with ``_rejected``: the text of a record that does not parse, else null."""
    rows = records.where("place > 0") if header else records
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields] + ["_rejected string"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected", "quote": '"', "escape": "\\", "maxCharsPerColumn": "-1", "multiLine": "true"}
    parsed = rows.select("path", "place", F.from_csv("record", schema, options).alias("_row"))
    return parsed.select("path", "place", "_row.*")


def read_csv(spark: SparkSession, path: str, columns: T.StructType, range_bytes: int | None = None) -> DataFrame:
    """The rows of CSV files with a header; what does not parse is in :func:`rejected`."""
    parsed = parse_records(read_records(spark, path, range_bytes), columns)
    return parsed.where("_rejected IS NULL").select(*[f"`{f.name}`" for f in columns.fields])


def rejected(spark: SparkSession, path: str, columns: T.StructType, range_bytes: int | None = None) -> DataFrame:
    """``path, place, record``: the records that :func:`read_csv` leaves out."""
    parsed = parse_records(read_records(spark, path, range_bytes), columns)
    return parsed.where("_rejected IS NOT NULL").select("path", "place", F.col("_rejected").alias("record"))
