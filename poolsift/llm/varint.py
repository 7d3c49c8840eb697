"""Lists of small whole numbers as bytes, seven bits at a time, for whole Arrow columns at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _binary(ends: np.ndarray, body: np.ndarray) -> pa.BinaryArray:
    """Rows of bytes that end at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def packed(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Rows of ``values`` (at least 0); row i ends before place ``ends[i]``."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        size += more
    stops = np.cumsum(size)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    starts = stops - size
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        low = (values[at] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[starts[at] + k] = low | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return _binary(np.concatenate([[0], stops])[ends], out)


def joined(strings: list[bytes], ends: np.ndarray) -> tuple[pa.BinaryArray, pa.BinaryArray]:
    """Rows of strings, end to end, and their sizes as :func:`packed` rows."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    body = np.frombuffer(b"".join(strings), np.uint8)
    return _binary(np.concatenate([[0], np.cumsum(sizes)])[ends], body), packed(sizes, ends)


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of :func:`packed`, and where each row ends."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, offsets = _bytes(column)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - starts + 1
    values = np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        values[at] |= (data[starts[at] + k].astype(np.int64) & 127) << (7 * k)
    return values, np.searchsorted(last, offsets[1:])


def split(column: pa.BinaryArray, sizes: np.ndarray) -> list[bytes]:
    """The strings of all rows of :func:`joined`."""
    data, _ = _bytes(column)
    raw, stops = data.tobytes(), np.cumsum(sizes).tolist()
    return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]


def steps(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Increasing values of every row as distances, the first of a row from zero."""
    out = np.diff(values, prepend=0)
    heads = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    out[heads] = values[heads]
    return out


def from_steps(distances: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(distances)])
    heads = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return total[1:] - np.repeat(total[heads], np.diff(ends, prepend=0))
