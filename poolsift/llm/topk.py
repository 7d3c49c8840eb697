"""Exact top-k search by inner product: branch and bound over columns.

Vectors are whole numbers. Candidates lie in blocks, one row per dimension and one column per
vector; queries lie in blocks too, and every pair of blocks is a task of bounded size. A
query adds up a few dimensions at a time, strongest dimensions first. What the other dimensions
can still add is bounded by the lengths of what is left of both vectors; a candidate whose upper
bound is below the k-th lower bound is out, and the survivors move together.

Vectors that are null or hold a null, NaN or infinite component take no part. Vectors of fewer
dimensions count as filled up with zeros. Rows with the same id are different rows: a query
meets the others. Components must stay below 2**26 in size after scaling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsift.llm.common import saved, tasks

K = 20
#: Vectors of a candidate block and of a query block, on average.
CANDIDATES = 8_192
QUERIES = 2_048
#: Dimensions added at a time.
STEP = 16


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id``, ``row`` (number among rows of that id) and ``v``, floor(scale * x) of usable vectors."""
    usable = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(usable).select("vec_id", numbers.alias("v"))
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as columns: (dimensions x vectors)."""
    lists = column.combine_chunks()
    offsets = np.asarray(lists.offsets)
    values = np.asarray(lists.values).astype(np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((dims, len(sizes)), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes), owner] = values[offsets[0] : offsets[-1]]
    return out


def search_block(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, step: int = STEP):
    """For each query (a column) the places and scores of its best candidates; ``own`` is its own place or -1."""
    strong = np.argsort(-np.square(candidates.astype(float)).sum(1), kind="stable")
    queries, candidates = queries[strong], candidates[strong]
    dims = len(strong)
    cuts = list(range(0, dims, step)) + [dims]
    square_c = np.square(candidates.astype(float))
    square_q = np.square(queries.astype(float))
    rest_c = [np.sqrt(square_c[c:].sum(0)) for c in cuts[1:]]
    rest_q = [np.sqrt(square_q[c:].sum(0)) for c in cuts[1:]]
    everyone = np.arange(candidates.shape[1])
    for q in range(queries.shape[1]):
        alive = everyone[everyone != own[q]] if own[q] >= 0 else everyone
        score = np.zeros(len(alive), np.int64)
        for at, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            part = candidates[low:high] if len(alive) == len(everyone) else candidates[low:high, alive]
            score = score + queries[low:high, q] @ part
            if len(alive) <= k:
                continue
            slack = rest_q[at][q] * rest_c[at][alive] * (1 + 1e-9) + 1e-6
            least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            stays = score + slack >= least
            alive, score = alive[stays], score[stays]
        best = np.lexsort((ids[alive], -score))[:k]
        yield q, alive[best], score[best]


def top_k(vectors: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the best ``k`` other rows per query row; ties to the smaller id."""
    spark = vectors.sparkSession
    rows = saved(whole_vectors(vectors), "whole-vectors")
    queries = rows.where(is_query)
    count, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = queries.count()
    dims = dims or 0
    c_blocks, q_blocks = max(1, -(-count // CANDIDATES)), max(1, -(-asked // QUERIES))
    name = F.xxhash64("vec_id", "row")
    sides = (
        rows.select("*", F.pmod(name, F.lit(c_blocks)).cast("int").alias("c"), F.lit(0).alias("side"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        .unionByName(
            queries.select("*", F.pmod(name, F.lit(q_blocks)).cast("int").alias("q"), F.lit(1).alias("side")).withColumn(
                "c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
            )
        )
    )

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        parts = [table.filter(pa.array(side == s)) for s in (0, 1)]
        ids = [p.column("vec_id").fill_null((1 << 63) - 1).to_numpy() for p in parts]
        numbers = [p.column("row").to_numpy() for p in parts]
        places = {key: i for i, key in enumerate(zip(ids[0].tolist(), numbers[0].tolist()))}
        own = np.array([places.get(key, -1) for key in zip(ids[1].tolist(), numbers[1].tolist())], np.int64)
        c, q = (_matrix(p.column("v"), dims) for p in parts)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(ids[0]):
            for i, found, scores in search_block(q, c, own, ids[0], k):
                for column, value in zip(out, (np.full(len(found), ids[1][i]), np.full(len(found), numbers[1][i]), found, numbers[0][found], scores)):
                    column.append(value)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(
            {
                "query_id": pa.array(flat[0], pa.int64()),
                "query_row": pa.array(flat[1], pa.int32()),
                "vec_id": parts[0].column("vec_id").combine_chunks().take(pa.array(flat[2])),
                "vec_row": pa.array(flat[3], pa.int32()),
                "score": pa.array(flat[4], pa.int64()),
            }
        )

    pairs = sides.repartition(max(tasks(spark), c_blocks * q_blocks), "c", "q").groupBy("c", "q")
    found = pairs.applyInArrow(search, "query_id bigint, query_row int, vec_id bigint, vec_row int, score bigint")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
