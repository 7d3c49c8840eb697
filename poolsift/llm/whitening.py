"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are scaled to whole numbers and centred exactly. The bidiagonalisation of the centred rows ``X``
alternates ``p = X v`` and ``r = X' u``; ``v`` lives on the driver (as long as a vector has entries),
``u`` has an entry per row of the table and is never stored: every ``u`` is ``X w`` for a short ``w``, so a task
works its part of all former ``u`` out from ``W`` and its own rows. One pass over the table per step gives
``X' p``, ``U' p`` (against which ``p`` is made orthogonal, in full) and ``|p|``; partial sums meet in a Spark
aggregate. ``v`` is made orthogonal to all former ones twice. The small bidiagonal matrix is then taken apart by
its singular values. The steps end when the wanted components have converged or the space is used up; where
the recurrence breaks down (repeated deviations) it goes on with a direction it has not seen.

Vectors that are null or hold null or non-finite entries take no part. Vectors of different lengths, and
entries too large for exact whole numbers, raise an error. Components without any deviation are left
out, so fewer than asked for come back from a table of low rank; an empty table, or one of equal vectors,
gives no rows. Null or repeated ids are rows of their own. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.llm.common import saved

#: The scale of whole numbers and what is added to them.
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
#: Deviations below this part of the greatest one are rounding.
TINY = 1e-13
#: A component has converged when its residual is below this part of the greatest deviation.
CONVERGED = 1e-15
#: Vectors multiplied at a time.
ROWS = 4_096


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the vector as whole numbers, of the rows that take part."""
    entries = F.transform(F.col(column), lambda c: c.cast("double"))
    fit = F.forall(entries, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    floors = F.transform(entries, lambda c: F.floor(c * SCALE).cast("double") + SHIFT)
    exact = F.forall(entries, lambda c: F.abs(c) * SCALE + SHIFT < EXACT)
    checked = F.when(exact, floors).otherwise(F.raise_error(F.lit("an entry is too large for an exact whole number")))
    held = vectors.where(F.col(column).isNotNull() & fit & (F.size(column) > 0))
    return held.select("vec_id", F.transform(checked, lambda c: c.cast("bigint")).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(rows: DataFrame, width: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``of`` returns (``size`` numbers) for a part of their matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _matrices(batches, width):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "part"])

    parts = rows.select("x").mapInArrow(run, "at int, part double")
    found = parts.groupBy("at").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(size)
    for row in found:
        out[row.at] = row.total
    return out


class Centre:
    """Rows minus their mean: whole numbers first, then the rest of the mean, so nothing is lost."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        near = [(2 * s + n) // (2 * n) for s in sums]
        self.near = np.array(near, np.int64)
        self.rest = np.array([(s - n * m) / n for s, m in zip(sums, near)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of ``(n x - S) ** 2``, exact."""
        left = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.near)], object)
        apart = x - self.near
        most = self.n * int(np.abs(apart).max(initial=0)) + max(map(abs, left), default=0)
        if most**2 * x.shape[1] < 2**63:
            off = apart * self.n - left.astype(np.int64)
            return (off * off).sum(1).tolist()
        off = apart.astype(object) * self.n - left
        return (off * off).sum(1).tolist()


def moments(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Rows, entries of a vector and their exact sums; no rows give zeros."""
    least, most, n = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not n:
        return 0, 0, []
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} entries in one table")
    by_place = rows.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    sums = {r.at: int(r.s) for r in by_place.collect()}
    return n, most, [sums[i] for i in range(most)]


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(
    multiply: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], width: int, wanted: int, scale: float, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Deviations (singular values, falling) and their right vectors (columns) of a tall matrix ``X``.

    ``multiply(q, W)`` returns ``X'Xq``, ``(XW)'(Xq)`` and ``|Xq| ** 2`` in one pass. ``scale`` bounds the greatest
    singular value; what is far below it is rounding.
    """
    rng = np.random.default_rng(seed)
    vs, ws, alphas, betas = np.zeros((width, 0)), np.zeros((width, 0)), [], []
    us = np.zeros((width, 0))  # X'u of every former u
    v = rng.standard_normal(width)
    v /= np.linalg.norm(v)
    beta = 0.0
    while True:
        # p = X v - beta u, as X q
        q = v - beta * ws[:, -1] if ws.shape[1] else v
        back, against, square = multiply(q, ws)
        # what is left of the former u goes; X'p follows
        q = q - ws @ against
        back = back - us @ against
        alpha = np.sqrt(max(0.0, square - against @ against))
        vs = np.column_stack([vs, v])
        alphas.append(alpha)
        if alpha <= TINY * scale:
            # v is a direction without deviation of its own: an entry of zero, no u
            alphas[-1] = 0.0
            ws, us = np.column_stack([ws, np.zeros(width)]), np.column_stack([us, np.zeros(width)])
            rest = np.zeros(width)
        else:
            ws, us = np.column_stack([ws, q / alpha]), np.column_stack([us, back / alpha])
            rest = _orthogonal(back / alpha - alpha * v, vs)
        steps = vs.shape[1]
        beta = float(np.linalg.norm(rest))
        if beta <= TINY * scale:
            beta, rest = 0.0, np.zeros(width)
        small = np.diag(alphas) + np.diag(betas, 1) if steps > 1 else np.diag(alphas)
        left, deviations, right = np.linalg.svd(small)
        if steps == width:
            break
        if steps >= wanted and beta > 0 and (beta * np.abs(left[-1, :wanted]) <= CONVERGED * deviations[0]).all():
            break
        if beta == 0.0:
            rest = _orthogonal(rng.standard_normal(width), vs)
            v = rest / np.linalg.norm(rest)
        else:
            v = rest / beta
        betas.append(beta)
    return deviations[:wanted], (vs @ right.T)[:, :wanted]


def whitened(vectors: DataFrame, wanted: int = 32, column: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = saved(whole_vectors(vectors, column), "whole-vectors")
    n, width, sums = moments(rows)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    empty = rows.where("false").select("vec_id").mapInArrow(lambda batches: iter(()), f"vec_id {kind}, {schema}")
    if not n:
        return empty
    centre = Centre(n, sums)
    context = vectors.sparkSession.sparkContext

    def multiply(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        both = context.broadcast((centre, np.column_stack([q, w])))  # entries of a vector, squared, at most

        def products(x: np.ndarray) -> np.ndarray:
            centred, directions = both.value[0](x), both.value[1]
            along = centred @ directions
            p = along[:, 0]
            return np.concatenate([centred.T @ p, along.T @ p])

        total = summed(rows, width, width + 1 + w.shape[1], products)
        both.destroy()
        return total[:width], total[width + 1 :], total[width]

    trace = summed(rows, width, 1, lambda x: np.array([(centre(x) ** 2).sum()]))[0]
    if not trace:
        return empty
    deviations, directions = bidiagonalise(multiply, width, min(wanted, width), np.sqrt(trace))
    kept = deviations > TINY**0.5 * deviations[0]
    deviations, directions = deviations[kept], directions[:, kept]
    values = deviations**2 / n
    count = len(values)
    explained = deviations**2 / trace
    project = context.broadcast((centre, directions / np.sqrt(values)))

    def products(x: np.ndarray) -> np.ndarray:
        z = project.value[0](x) @ project.value[1]
        return np.concatenate([z.sum(0), (z.T @ z).reshape(-1)])

    total = summed(rows, width, count + count * count, products)
    mean = total[:count] / n
    # centred twice over: the rows are, and what rounding leaves of their mean goes as well
    error = float(np.abs(total[count:].reshape(count, count) / n - np.outer(mean, mean) - np.eye(count)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred, onto = project.value
        for part, x in _matrices(batches, width):
            far = centred.deviations(x)
            if max(far, default=0) >= 2**63:
                raise OverflowError("a deviation does not fit a long")
            z = centred(x) @ onto
            length = len(x)
            each = np.repeat(np.arange(length), count)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), length)),
                    pa.array(np.full(length * count, n, np.int64)),
                    pa.array(np.array(far, np.int64)[each]),
                    pa.array(z.reshape(-1)),
                    pa.array(np.tile(explained, length)),
                    pa.array(np.full(length * count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"vec_id {kind}, {schema}")
