"""Exact removal of repeated byte strings, by suffix arrays.

A byte is removed if it lies in a string of ``length`` bytes that starts anywhere else too, in the
same text or another. Corpora do not fit one suffix array, so windows that can be equal are brought
together first:

1. The key of a window (``length`` bytes) is the least hash of the 32-byte strings in it. Equal
   windows have equal keys. Neighbouring windows mostly take their key from the same place, so a
   text is a sequence of stretches: windows in a row with one such place. Only keys that occur
   twice matter.
2. Stretches with equal bytes are copies: all their windows are repeated. One of each goes on.
3. The different stretches of a key meet in one task, which builds a suffix array over them by
   two-stage sorting: suffixes smaller than their successors are sorted directly, the others are
   induced by a scan over the buckets of first bytes. Neighbours with a common prefix of ``length``
   bytes mark repeated windows.
4. Windows become byte ranges per text, which are cut out.

Keys with very many different stretches take another exact way: their windows are compared by
128-bit digests, counted before the shuffle.

Null and empty texts, and texts shorter than ``length``, lose nothing. Rows equal in id and text
repeat each other like any two texts. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.llm.common import saved, tasks, whole
from poolsift.llm.pieces import BASE, mixed

LENGTH = 200
GRAM = 32
#: Bytes of stretches over which one suffix array is built, at least.
ARRAY_BYTES = 2_000_000
#: Different stretches of a key from which on windows are compared by digest.
MOST_STRETCHES = 100_000
#: Bytes of texts that are hashed together.
BATCH_BYTES = 4_000_000

#: Low bits that tell places apart where the least hash occurs more than once: the first counts.
PLACE = np.uint64((1 << 20) - 1)

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _geometric(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place of ``data`` on."""
    count = len(data) - gram + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _geometric(BASE, len(data)), dtype=np.uint64)])
    return mixed((sums[gram:] - sums[:-gram]) * _geometric(_INVERSE, len(data))[:count])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row: minima from both ends of blocks of that width."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def stretches(body: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key) of the stretches of a text of at least ``length`` bytes."""
    hashes = gram_hashes(np.frombuffer(body, np.uint8), gram)
    place = np.arange(len(hashes), dtype=np.uint64) & PLACE
    least = sliding_minimum((hashes & ~PLACE) | place, length - gram + 1)
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = cut + ((least[cut] - cut.astype(np.uint64)) & PLACE).astype(np.int64)
    return cut, np.diff(np.append(cut, len(least))), hashes[at]


# ---------------------------------------------------------------- suffix array


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of ``data`` (0 ends every text) in the order of their next ``depth`` bytes, at least.

    With ``wanted``, a flag per place, only those places and the ones their order follows from.

    Two-stage sorting. Places whose suffix is smaller than its successor are sorted directly, eight
    bytes at a time. The others follow from them: going through the buckets of first bytes in
    order, the place before a sorted one belongs next in its own bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    wide = data.astype(np.int16)
    # smaller than the successor: the next different byte is larger
    change = np.flatnonzero(np.append(wide[1:] != wide[:-1], True))
    run_end = np.repeat(change, np.diff(np.concatenate([[-1], change])))
    after = np.where(run_end + 1 < n, wide[np.minimum(run_end + 1, n - 1)], -1)
    rising = after > wide
    kept = np.ones(n, bool) if wanted is None else _with_successors(wanted, rising)
    falling = ~rising & kept
    order = _sort_directly(data, np.flatnonzero(rising & kept), depth)
    bounds = np.searchsorted(wide[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if falling[n - 1]:
        waiting[int(data[n - 1])].append(np.array([n - 1]))  # the end is smaller than anything
    out = []
    for first in range(256):
        wave = np.concatenate(waiting[first]) if waiting[first] else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[(data[before] == first) & falling[before]]
            if len(wave):
                waves.append(wave)
        bucket = np.concatenate([*waves, order[bounds[first] : bounds[first + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[falling[before] & (data[before] > first)]
        if len(before):
            heads = data[before]
            by_head = np.argsort(heads, kind="stable")
            heads = heads[by_head]
            cuts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
            for part in np.split(before[by_head], cuts[1:]):
                waiting[int(data[part[0]])].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _with_successors(wanted: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """The places wanted, and those behind them up to the next one that is sorted directly."""
    at = np.arange(len(wanted))
    asked = np.maximum.accumulate(np.where(wanted, at, -1))
    sorted_before = np.maximum.accumulate(np.where(rising, at, -1))
    sorted_before = np.append(-1, sorted_before[:-1])
    return asked > sorted_before


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, in the order of the bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def _sort_directly(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    words = np.append(_words(data), np.uint64(0))
    n = len(data)
    first = words[places]
    by_word = np.argsort(first)
    order, first = places[by_word], first[by_word]
    tied = np.arange(len(order))
    group = np.cumsum(np.append(False, first[1:] != first[:-1])) if len(order) else tied
    for offset in range(8, depth, 8):
        # those alone in their group have their place
        same = group[1:] == group[:-1]
        more = np.append(False, same) | np.append(same, False) if len(group) else np.zeros(0, bool)
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        word = words[np.minimum(order[tied] + offset, n)]
        differs = (group[1:] == group[:-1]) & (word[1:] != word[:-1])
        if not differs.any():
            continue
        # groups of one word are in order
        mixed_up = np.zeros(int(group[-1]) + 1, bool)
        mixed_up[group[1:][differs]] = True
        part = np.flatnonzero(mixed_up[group])
        of, at, word = group[part], tied[part], word[part]
        inner = np.lexsort((word, of))
        word = word[inner]
        order[at] = order[at][inner]
        split = np.zeros(len(tied), bool)
        split[part[1:]] = (of[1:] == of[:-1]) & (word[1:] != word[:-1])
        group = group + np.cumsum(split)
    return order


def repeated_windows(data: np.ndarray, length: int) -> np.ndarray:
    """Flag per place of ``data``: its next ``length`` bytes start elsewhere too and hold no 0 end."""
    flags = np.zeros(len(data), bool)
    if len(data) < length:
        return flags
    ends = np.flatnonzero(data == 0)
    next_end = np.append(ends, len(data))
    room = np.repeat(next_end, np.diff(np.append(-1, next_end)))[: len(data)] - np.arange(len(data))
    # nothing begins so near to an end that a window does not fit: these places are not sorted
    order = suffix_array(data, length, room >= length)
    order = order[room[order] >= length]
    near = order[:-1], order[1:]
    # common prefix of neighbours, as far as length: words of eight bytes, then the rest
    words = np.append(_words(data), np.zeros(length, np.uint64))
    equal = np.arange(max(len(order) - 1, 0))
    offsets = [*range(0, length - 7, 8), length - 8]
    for offset in offsets:
        equal = equal[words[near[0][equal] + offset] == words[near[1][equal] + offset]]
    flags[near[0][equal]] = True
    flags[near[1][equal]] = True
    return flags


def _flag_batch(bodies: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each stretch the windows (from 0) that are repeated among all of them."""
    # text has no byte 255 in UTF-8: bytes move up by one, 0 ends a stretch
    joined = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8) + np.uint8(1)
    flags = repeated_windows(joined, length)
    out, at = [], 0
    for body, count in zip(bodies, counts):
        out.append(np.flatnonzero(flags[at : at + count]))
        at += len(body) + 1
    return out


def _ranges(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Window starts as byte ranges, end exclusive."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    first = places[np.append(0, cut + 1)]
    last = places[np.append(cut, len(places) - 1)]
    return list(zip(first.tolist(), (last + length).tolist()))


# ---------------------------------------------------------------- Spark

REF = "doc bigint, hash bigint, first bigint, windows bigint"


def _identified(docs: DataFrame) -> DataFrame:
    text = whole(F.col("text"))
    return docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("hash"), "doc_id", text.alias("text"))


def text_stretches(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, hash, first, windows, key, digest`` of all stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes, parts = [], [], []
            size = 0
            for doc, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                body = text.encode("utf-8", "replace")
                if len(body) < length:
                    continue
                first, count, key = stretches(body, length, gram)
                digest = [
                    xxhash.xxh3_64_intdigest(body[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist())
                ]
                parts.append((first, count, key.view(np.int64), np.array(digest, np.uint64).view(np.int64)))
                docs.append(doc)
                hashes.append(name)
                size += len(body)
                if size >= BATCH_BYTES:
                    yield _stretch_rows(docs, hashes, parts)
                    docs, hashes, parts, size = [], [], [], 0
            if parts:
                yield _stretch_rows(docs, hashes, parts)

    return rows.select("doc", "hash", "text").mapInArrow(run, f"{REF}, key bigint, digest bigint")


def _stretch_rows(docs: list[int], hashes: list[int], parts: list[tuple]) -> pa.RecordBatch:
    counts = [len(p[0]) for p in parts]
    columns = [np.repeat(np.array(docs, np.int64), counts), np.repeat(np.array(hashes, np.int64), counts)]
    columns += [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "hash", "first", "windows", "key", "digest"])


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most_stretches: int = MOST_STRETCHES) -> DataFrame:
    """``doc, hash, from, to``: byte ranges (end exclusive, may overlap) of repeated strings."""
    spark = rows.sparkSession
    found = text_stretches(rows, length, gram)
    # counts are written before they are joined, so that Spark can split a hot key in the join
    keys = saved(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "stretch-keys")
    alive = saved(found.join(keys, "key"), "stretches")
    kinds = alive.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "hash", "first", "windows")).alias("ref"))
    kinds = saved(kinds, "stretch-kinds")
    whole_ranges = alive.join(kinds.where("copies > 1").select("key", "digest"), ["key", "digest"]).select(
        "doc", "hash", F.col("first").alias("from"), (F.col("first") + F.col("windows") + length - 1).alias("to")
    )
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_kinds = kinds.join(several, "key").select("key", "copies", "ref.*", (F.col("n") > most_stretches).alias("hot"))
    wanted = open_kinds.groupBy("doc", "hash").agg(F.collect_list(F.struct("key", "copies", "first", "windows", "hot")).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for doc, name, text, wants in zip(*(c.to_pylist() for c in batch.columns)):
                body = text.encode("utf-8", "replace")
                for w in wants:
                    part = body[w["first"] : w["first"] + w["windows"] + length - 1]
                    for column, value in zip(columns, (doc, name, w["key"], w["copies"], w["first"], w["windows"], w["hot"], part)):
                        column.append(value)
            kinds_of = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds_of)], ["doc", "hash", "key", "copies", "first", "windows", "hot", "body"]
            )

    texts = rows.select("doc", "hash", "text").join(wanted, ["doc", "hash"]).dropDuplicates(["doc", "hash"]).select("doc", "hash", "text", "wanted")
    parts = texts.mapInArrow(cut_out, "doc bigint, hash bigint, key bigint, copies bigint, first bigint, windows bigint, hot boolean, body binary")
    parts = saved(parts, "stretch-bodies")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of: list[tuple] = []
        size, last = 0, None

        def finish() -> pa.RecordBatch:
            flagged = _flag_batch([r[4] for r in rows_of], [r[3] for r in rows_of], length)
            out = [(r[0], r[1], r[2] + a, r[2] + b) for r, places in zip(rows_of, flagged) for a, b in _ranges(places, length)]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["doc", "hash", "from", "to"])

        for batch in batches:
            for doc, name, key, first, windows, body in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size >= ARRAY_BYTES:
                    yield finish()
                    rows_of, size = [], 0
                last = key
                rows_of.append((doc, name, first, windows, body))
                size += len(body)
        if rows_of:
            yield finish()

    ranges = "doc bigint, hash bigint, `from` bigint, `to` bigint"
    cold = parts.where("NOT hot").select("doc", "hash", "key", "first", "windows", "body")
    cold = cold.repartition(4 * tasks(spark), "key").sortWithinPartitions("key", "doc", "first")
    marked = cold.mapInArrow(mark, ranges)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, name, first, windows, body in zip(*(c.to_pylist() for c in batch.columns)):
                names = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(windows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * windows), pa.array([name] * windows), pa.array(range(first, first + windows), pa.int64()), pa.array(names, pa.binary())],
                    ["doc", "hash", "from", "window"],
                )

    hot = parts.where("hot").select("doc", "hash", "first", "windows", "body")
    hot = hot.mapInArrow(windows_of, "doc bigint, hash bigint, `from` bigint, window binary")
    again = hot.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    dug = hot.join(again, "window").select("doc", "hash", "from", (F.col("from") + length).alias("to"))
    return whole_ranges.union(marked).union(dug)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_stretches: int = MOST_STRETCHES) -> DataFrame:
    """``doc_id``, ``kept`` (bytes), ``n_bytes``, ``n_removed``, ``n_spans`` of every row."""
    rows = _identified(docs)
    found = repeated_ranges(rows, length, gram, most_stretches)
    found = found.groupBy("doc", "hash").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            ranges = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                body = text.encode("utf-8", "replace")
                part = ranges[i].as_py()
                runs: list[list[int]] = []
                for a, b in sorted((r["from"], r["to"]) for r in part or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, left = 0, []
                for a, b in runs:
                    left.append(body[at:a])
                    at = b
                left.append(body[at:])
                kept.append(b"".join(left))
                sizes.append(len(body))
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans))],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    joined = rows.join(found, ["doc", "hash"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def repeats_report(docs: DataFrame) -> DataFrame:
    kept = without_repeats(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
