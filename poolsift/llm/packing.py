"""Packing documents into sequences of a fixed number of tokens, by linear grouping.

Token counts are small whole numbers, so the packing is worked out for lengths, not documents:
the histogram of piece lengths has at most ``capacity`` entries whatever the corpus. On it

1. large lengths are split into groups of equal cardinality and rounded up to the largest of
   their group, which leaves few sizes;
2. the fewest sequences for these sizes come from configurations (how many of each size fill a
   sequence), found by a linear program with column generation, rounded down;
3. every place of a configuration takes the actual lengths of its group, in order, so that a
   configuration becomes a few runs of equal sequences;
4. what is left over and the small lengths go, longest first, where they fit best.

The plan says where the n-th piece of each length goes. Pieces are numbered within their
length by counts per length and hash bucket, so nothing of the size of the corpus meets in one
task or the driver.

A null text is empty and is one piece: the closing token alone. Repeated rows are packed each
on its own. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsift.llm.bpe import read_ranks
from poolsift.llm.common import lean, saved, tasks, text_parts
from poolsift.llm.pieces import PieceIds, Splitter, class_table

CAPACITY = 2048
#: Id that closes a document.
END = 0
#: Lengths from this share of the capacity are large.
LARGE = 4
#: Groups of the large lengths.
GROUPS = 48
#: Rounds of column generation at most; every round is valid, further ones only improve.
ROUNDS = 400
BATCH_BYTES = 1_500_000


# ---------------------------------------------------------------- plan over lengths


class _Runs:
    """Counted pieces per length, handed out in order: (length, first ordinal, count)."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)

    def take(self, length: int, count: int) -> tuple[int, int]:
        first = self.used[length]
        self.used[length] += count
        self.left[length] -= count
        return length, first


def group_lengths(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths in descending order, cut into groups of about equally many pieces."""
    total = sum(counts.values())
    out: list[list[int]] = []
    seen = 0
    for length in sorted(counts, reverse=True):
        if not out or seen * groups >= total * len(out):
            out.append([])
        out[-1].append(length)
        seen += counts[length]
    return out


def configurations(sizes: list[int], needs: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations and how often to use each: a linear program's solution, rounded down."""
    kinds = len(sizes)
    size = np.array(sizes)
    basis = np.diag(capacity // size).astype(float)
    need = np.array(needs, float)
    inverse = np.diag(1.0 / np.diag(basis))
    for _ in range(ROUNDS):
        prices = inverse.sum(axis=0)
        pattern = _best_pattern(size, prices, capacity)
        if prices @ pattern <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        amounts = inverse @ need
        ratio = np.full(kinds, np.inf)
        up = direction > 1e-9
        ratio[up] = amounts[up] / direction[up]
        out = int(ratio.argmin())
        basis[:, out] = pattern
        inverse = np.linalg.inv(basis)
    amounts = np.floor(inverse @ need + 1e-9).astype(int)
    return [(basis[:, i].astype(int).tolist(), int(n)) for i, n in enumerate(amounts) if n > 0]


def _best_pattern(size: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the highest price: an unbounded knapsack."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(size)
    size_up, price_up = size[order], prices[order]
    for room in range(1, capacity + 1):
        fits = np.searchsorted(size_up, room, side="right")
        if not fits:
            continue
        gains = value[room - size_up[:fits]] + price_up[:fits]
        best = int(gains.argmax())
        if gains[best] > value[room - 1] + 1e-12:
            value[room], choice[room] = gains[best], order[best]
        else:
            value[room], choice[room] = value[room - 1], -2
    pattern = np.zeros(len(size))
    room = capacity
    while room > 0:
        if choice[room] == -2:
            room -= 1
        elif choice[room] < 0:
            break
        else:
            pattern[choice[room]] += 1
            room -= size[choice[room]]
    return pattern


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where pieces go: rows (length, first ordinal, count, first sequence, offset), and how many sequences.

    Piece number ``first + i`` of a length is at ``offset`` of sequence ``first sequence + i``.
    """
    runs = _Runs({length: n for length, n in counts.items() if n > 0})
    rows: list[tuple[int, int, int, int, int]] = []
    bins: list[tuple[int, int, int]] = []  # first sequence, count, used
    sequences = 0
    large = {length: n for length, n in runs.left.items() if length * LARGE >= capacity and length < capacity}
    if large:
        groups = group_lengths(large, GROUPS)
        sizes = [max(g) for g in groups]
        used = configurations(sizes, [sum(large[x] for x in g) for g in groups], capacity)
        ascending = sorted(runs.left)
        for pattern, times in used:
            places = [g for g, n in enumerate(pattern) for _ in range(n)]
            done = 0
            while done < times:
                # each place takes the longest length left in its group, the last one the longest
                # that fits at all; equal sequences make a run
                wish: dict[int, int] = {}
                chosen = []
                room = capacity
                for g in places[:-1]:
                    pick = next((x for x in groups[g] if runs.left[x] > wish.get(x, 0)), None)
                    if pick is not None:
                        wish[pick] = wish.get(pick, 0) + 1
                        chosen.append(pick)
                        room -= pick
                at = bisect_right(ascending, room) - 1
                while at >= 0 and runs.left[ascending[at]] <= wish.get(ascending[at], 0):
                    if not runs.left[ascending[at]]:
                        ascending.pop(at)
                    at -= 1
                if at >= 0:
                    wish[ascending[at]] = wish.get(ascending[at], 0) + 1
                    chosen.append(ascending[at])
                if not chosen:
                    break
                count = min([times - done, *(runs.left[x] // n for x, n in wish.items())])
                offset = 0
                for length in chosen:
                    length, first = runs.take(length, count)
                    rows.append((length, first, count, sequences, offset))
                    offset += length
                bins.append((sequences, count, offset))
                sequences += count
                done += count
    # best fit, longest first: bins with the same room are taken together
    rooms: dict[int, list[tuple[int, int]]] = {}
    for first, count, used_tokens in bins:
        rooms.setdefault(capacity - used_tokens, []).append((first, count))
    open_rooms = sorted(rooms)
    heap_of = {room: rooms[room] for room in open_rooms}
    for length in sorted((x for x, n in runs.left.items() if n > 0), reverse=True):
        while runs.left[length] > 0:
            at = int(np.searchsorted(open_rooms, length))
            if at < len(open_rooms):
                room = open_rooms[at]
                first, count = heap_of[room].pop()
                if not heap_of[room]:
                    del heap_of[room]
                    open_rooms.pop(at)
                fits = room // length
            else:
                room, fits = capacity, capacity // length
                count = -(-runs.left[length] // fits)
                first, sequences = sequences, sequences + count
            # whole sequences filled with as many as fit, then the rest one by one
            here = min(count, runs.left[length] // fits)
            if here:
                each = fits
            else:
                here, each = 1, runs.left[length]
            if here < count:
                _open(heap_of, open_rooms, room, (first + here, count - here))
            for i in range(each):
                _, ordinal = runs.take(length, here)
                rows.append((length, ordinal, here, first, capacity - room + i * length))
            if (left := room - each * length) > 0:
                _open(heap_of, open_rooms, left, (first, here))
    return rows, sequences


def _open(heap_of: dict[int, list[tuple[int, int]]], rooms: list[int], room: int, run: tuple[int, int]) -> None:
    if room not in heap_of:
        heap_of[room] = []
        rooms.insert(int(np.searchsorted(rooms, room)), room)
    heapq.heappush(heap_of[room], run)


# ---------------------------------------------------------------- pieces


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and the closing id.

    The rank file holds the vocabulary of the tokenizer file of the same name, so the ids are the
    same; distinct pieces of text are encoded once.
    """

    classes = docs.sparkSession.sparkContext.broadcast(class_table(pattern))  # a byte per code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = splitter = None
        for batch in batches:
            if store is None:
                codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
                splitter = Splitter(pattern, classes.value)

                def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
                    found = [codec._encode_single_piece(p) for p in pieces]
                    counts = np.fromiter(map(len, found), np.int64, len(found))
                    return np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum())), counts

                store = PieceIds(encode)
            for low, high, texts in text_parts(batch, 1, BATCH_BYTES):
                codes, starts, per_text = splitter.cuts([t or "" for t in texts])
                slot, counts = store.lookup(codes, starts)
                ids = store.gather(slot, counts)
                total = np.concatenate([[0], np.cumsum(counts)])
                ends = total[np.cumsum(per_text)]
                yield _cut(batch.column(0).slice(low, high - low), ids, ends, capacity)

    def _cut(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, capacity: int) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        body = ids.astype("<u4").tobytes()
        close = int(END).to_bytes(4, "little")
        begin = 0
        for i, end in enumerate(ends.tolist()):
            length = end - begin + 1
            first = length % capacity or capacity
            at = 0
            for piece in range(-(-length // capacity)):
                size = first if piece == 0 else capacity
                stop = min(at + size, length - 1)
                crc = zlib.crc32(body[4 * (begin + at) : 4 * (begin + stop)])
                if at + size == length:
                    crc = zlib.crc32(close, crc)
                rows.append((i, piece, at, size, crc))
                at += size
            begin = end
        columns = np.array(rows, np.int64).reshape(-1, 5)
        return pa.RecordBatch.from_arrays(
            [
                doc_ids.take(pa.array(columns[:, 0])),
                pa.array(columns[:, 1].astype(np.int32)),
                *[pa.array(columns[:, i]) for i in (2, 3, 4)],
            ],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any rows with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * tasks(spark))).cast("int")
    salted = saved(pieces.withColumn("_salt", salt), "pieces")
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    per_length = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(per_length), F.lit(0)))
    histogram = dict(salted.groupBy("length").count().collect())
    rows, _ = plan(histogram, capacity)
    # a row per run of the plan: bounded by the number of lengths, not by the pieces
    places = spark.createDataFrame(
        pa.Table.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["length", "_first", "_count", "_sequence", "offset"]
        )
    )
    by_salt = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    numbered = salted.withColumn("_row", F.row_number().over(by_salt))
    numbered = numbered.join(counts.select("length", "_salt", "_before"), ["length", "_salt"])
    numbered = numbered.withColumn("_at", F.col("_before") + F.col("_row") - 1)
    inside = (F.col("_at") >= F.col("p._first")) & (F.col("_at") < F.col("p._first") + F.col("p._count"))
    placed = numbered.alias("n").join(F.broadcast(places.alias("p")), (F.col("n.length") == F.col("p.length")) & inside)
    kept = [F.col(f"n.{c}") for c in pieces.columns]
    sequence = F.col("p._sequence") + F.col("_at") - F.col("p._first")
    return placed.select(*kept, sequence.alias("sequence_id"), F.col("p.offset").alias("offset"))


def packing_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return pack(token_pieces(docs, ranks_path, pattern))
