"""Byte-level BPE encoding and decoding by recursive queries inside each partition.

A task cuts its texts into pieces by the vocabulary's pattern, and hands the distinct ones to
DuckDB. A recursive query keeps one row of ids per piece; in every round the rows unfold into
token positions, those join the merge table, and the leftmost pair of minimum rank of each piece
is contracted, until no piece has a pair left. Decoding looks up the bytes of each id and joins
them in order.

Ids of pieces are kept for the rest of the task. The store, the batches and DuckDB's memory are
bounded. Null texts count as empty: no tokens. Rows are independent, so repeated rows, ties and
other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from poolsift.llm.common import text_parts
from poolsift.llm.pieces import PieceIds, Splitter

#: Bytes of texts that are encoded together.
BATCH_BYTES = 1_500_000
#: Pieces of more bytes are contracted by a heap, with the same rule: a query takes one round
#: per contraction, and each round costs some time however little is left.
LONG_PIECE = 256
#: Pieces encoded by one query.
QUERY_PIECES = 50_000

CONTRACT = """
WITH RECURSIVE state(piece, ids, round) AS (
    SELECT piece, ids, 0 FROM pieces
    UNION ALL
    SELECT s.piece, list_concat(s.ids[:best.spot - 1], list_concat([best.id], s.ids[best.spot + 2:])), s.round + 1
    FROM state s JOIN (
        SELECT piece, min(m.rank::BIGINT * 4294967296 + spot) AS pick,
               (pick // 4294967296)::INTEGER AS id, (pick % 4294967296)::INTEGER AS spot
        FROM (SELECT piece, unnest(ids)::BIGINT * 65536 + unnest(ids[2:]) AS pair, generate_subscripts(ids, 1) AS spot
              FROM state) t
        JOIN merges m ON m.pair = t.pair
        GROUP BY piece
    ) best ON best.piece = s.piece
)
SELECT piece, arg_max(ids, round) AS ids FROM state GROUP BY piece ORDER BY piece
"""

DECODE = """
SELECT doc, array_to_string(list_select(token, list_transform(ids, lambda id: id + 1)), '') AS body
FROM documents, tokens ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank in every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Every pair of tokens that makes a token, as left * 65536 + right, and the rank it makes."""
    pairs, made = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left * 65536 + right)
                made.append(rank)
    return pairs, made


def contract_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The same contraction for one long piece: leftmost pair of minimum rank first."""
    count = len(ids)
    following, before = list(range(1, count + 1)), list(range(-1, count - 1))
    alive = [True] * count
    heap = [(merges[p], i) for i in range(count - 1) if (p := ids[i] * 65536 + ids[i + 1]) in merges]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = following[i] if alive[i] else count
        if j >= count or merges.get(ids[i] * 65536 + ids[j]) != rank:
            continue
        ids[i], alive[j] = rank, False
        following[i] = after = following[j]
        if after < count:
            before[after] = i
            if (new := merges.get(rank * 65536 + ids[after])) is not None:
                heapq.heappush(heap, (new, i))
        if (left := before[i]) >= 0 and (new := merges.get(ids[left] * 65536 + rank)) is not None:
            heapq.heappush(heap, (new, left))
    return [ids[i] for i in range(count) if alive[i]]


class Codec:
    """The vocabulary inside one task, with a DuckDB connection of its own."""

    def __init__(self, path: str, pattern: str, memory: str = "400MB") -> None:
        ranks = read_ranks(path)
        if max(ranks.values()) >= 65536:
            raise ValueError("ids must be below 65536")
        pairs, made = merge_pairs(ranks)
        self.merges = dict(zip(pairs, made))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        token = [""] * (max(ranks.values()) + 1)
        for body, rank in ranks.items():
            # a character per byte; zero bytes move out of the way
            token[rank] = body.decode("latin-1").replace("\0", "Ā")
        self.connection = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self.connection.register("given", pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(made, pa.int32())}))
        self.connection.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.connection.unregister("given")
        self.connection.register("given", pa.table({"token": pa.array([token], pa.list_(pa.string()))}))
        self.connection.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.connection.unregister("given")
        self.splitter = Splitter(pattern)
        self.store = PieceIds(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and how many each has."""
        bodies = [p.encode("utf-8", "replace") for p in pieces]
        found: list[np.ndarray | None] = [None] * len(bodies)
        short = []
        for i, body in enumerate(bodies):
            if (rank := self.ranks.get(body)) is not None:
                found[i] = np.array([rank], np.int32)
            elif len(body) > LONG_PIECE:
                found[i] = np.array(contract_long(self.byte_id[np.frombuffer(body, np.uint8)].tolist(), self.merges), np.int32)
            else:
                short.append(i)
        for start in range(0, len(short), QUERY_PIECES):
            part = short[start : start + QUERY_PIECES]
            flat = self.byte_id[np.frombuffer(b"".join(bodies[i] for i in part), np.uint8)]
            ends = np.cumsum([0] + [len(bodies[i]) for i in part]).astype(np.int32)
            rows = pa.table({"piece": pa.array(range(len(part)), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})
            self.connection.register("pieces", rows)
            ids = self.connection.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
            self.connection.unregister("pieces")
            cuts = np.asarray(ids.offsets)
            values = np.asarray(ids.values)
            for i, low, high in zip(part, cuts[:-1], cuts[1:]):
                found[i] = values[low:high]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        codes, starts, pieces = self.splitter.cuts(texts)
        slot, counts = self.store.lookup(codes, starts)
        ids = self.store.gather(slot, counts)
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(pieces)
        return ids, total[ends] - total[ends - pieces]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text's ids."""
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
        self.connection.register("documents", pa.table({"doc": pa.array(range(len(counts)), pa.int32()), "ids": lists}))
        bodies = self.connection.sql(DECODE).to_arrow_table().column("body").to_pylist()
        self.connection.unregister("documents")
        return [b.replace("Ā", "\0").encode("latin-1") for b in bodies]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (the bytes the ids stand for) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path, pattern)
            for low, high, texts in text_parts(batch, 1, BATCH_BYTES):
                ids, counts = codec.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                decoded = codec.decode(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))),
                        pa.array(decoded, pa.binary()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def round_trip_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: number of tokens, digests of the ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, names = None, None
        for batch in batches:
            if codec is None:
                codec = Codec(path, pattern)
                names = np.array([str(i).encode() + b" " for i in range(65536)], "S6")
                width = np.char.str_len(names).astype(np.int64)
                table = names.view(np.uint8).reshape(65536, 6)
            for low, high, texts in text_parts(batch, 1, BATCH_BYTES):
                ids, counts = codec.encode([t or "" for t in texts])
                decoded = codec.decode(ids, counts)
                sizes = width[ids]
                written = table[ids][np.arange(6) < sizes[:, None]].tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                listed = [hashlib.sha256(written[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(counts, pa.int64()),
                        pa.array(listed),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
