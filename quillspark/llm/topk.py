"""Exact top-k inner products by Fagin's threshold algorithm.

Each block of candidates keeps one list a dimension, sorted by component. A query walks its lists
from their best end, deeper in those where its own component is larger, scores every vector it
meets, and stops when the bound, the score of a vector with the components at the present depths,
cannot beat its k-th result. The k-th result is carried from block to block, so later blocks stop
sooner. Where the next step would walk a quarter of the block, the rest of the block is scored
instead: that is cheaper, and the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


class Best:
    """The k best (score, id) of every query; higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def least(self, q: int) -> int | None:
        """What a score has to reach to matter, or None while there are fewer than k."""
        return int(self.score[q][-1]) if len(self.score[q]) >= self.k else None

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if (low := self.least(q)) is not None:
            use = score >= low
            score, ids = score[use], ids[use]
        if len(score):
            score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
            if score.dtype == object:
                top = sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[: self.k]
            else:
                top = np.lexsort((ids, -score))[: self.k]
            score = score[top]
            if score.dtype == object and all(-(1 << 63) < x < 1 << 63 for x in score):
                score = score.astype(np.int64)
            self.score[q], self.id[q] = score, ids[top]


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, where: np.ndarray) -> int:
    """Adds one block's results to ``best``; ``where`` numbers the queries in it. Returns the scores computed."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0)
    order, lists = np.ascontiguousarray(order.T), np.ascontiguousarray(lists.T)
    done = 0
    for q, own, at in zip(queries, query_ids, where, strict=True):
        active = np.flatnonzero(q)
        weight = np.abs(q[active])
        pace = weight / weight.max(initial=1)
        back = q[active] > 0
        seen, had, depth, step = np.zeros(n, bool), np.zeros(len(active), np.int64), 0, 16
        while True:
            depth += step
            upto = np.minimum(n, np.ceil(depth * pace).astype(np.int64))
            met = np.zeros(n, bool)
            if not len(active) or step >= n // 4 or depth >= n:
                met[:] = True
            else:
                for d, up, a, b in zip(active, back, had, upto, strict=True):
                    met[order[d, n - b : n - a] if up else order[d, a:b]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            keep = new[ids[new] != own]
            done += len(keep)
            best.add(at, vectors[keep] @ q, ids[keep])
            if met.all():
                break
            edge = lists[active, np.where(back, n - upto, upto - 1)]
            bound, low = int((edge * q[active]).sum()), best.least(at)
            if low is not None and bound < low:  # an equal score could still win by a smaller id
                break
            had, step = upto, step * 2
    return done


def search_large(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, where: np.ndarray) -> None:
    """As ``search_block``, in Python's integers, for components of any size.

    Scores in floating point, with a bound of their error, first tell which can be among the k best.
    """
    rough = vectors.astype(float)
    for q, own, at in zip(queries, query_ids, where, strict=True):
        other = np.flatnonzero(ids != own)
        with np.errstate(over="ignore", invalid="ignore"):
            near, far = rough[other] @ q.astype(float), np.abs(rough[other]) @ np.abs(q.astype(float)) * (len(q) + 4) * 2.0**-51
            least, most = near - far, near + far
        if len(other) > best.k and np.isfinite(least).all():
            other = other[most >= np.partition(least, -best.k)[-best.k]]
        mine = [int(x) for x in q]
        score = np.array([sum(x * int(y) for x, y in zip(mine, vectors[i], strict=True)) for i in other] + [None], object)[:-1]
        best.add(at, score, ids[other])


def finite(vector: F.Column) -> F.Column:
    """The components as doubles; null where one is null or not finite."""
    x = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, x))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component: as int64, or as Python's integers if one has 2^45 or more."""
    if np.abs(vectors).max(initial=0) < 2.0**45:
        return np.floor(vectors * 256.0).astype(np.int64)
    # From 2^53 on doubles are integers.
    large = [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256.0) for x in vectors.ravel().tolist()]
    return np.array([*large, None], object)[:-1].reshape(vectors.shape)


def _grouped(ids: np.ndarray, vectors: list) -> dict[int, list[tuple[bool, np.ndarray, np.ndarray]]]:
    """Rows by number of dimensions, those with small components and the others: whether large, ids, vectors.

    The inner product of two small ones fits in 63 bits.
    """
    sizes, out = np.fromiter(map(len, vectors), np.int64, len(vectors)), {}
    for d in map(int, np.unique(sizes)):
        of = np.flatnonzero(sizes == d)
        rows = np.array([vectors[i] for i in of], float).reshape(len(of), d)
        large = np.abs(rows).max(axis=1, initial=0) >= math.isqrt((1 << 62) // max(d, 1)) // 256 - 1
        out[d] = [(bool(x), ids[of[large == x]], whole(rows[large == x])) for x in (False, True) if (large == x).any()]
    return out


def fitting(score: np.ndarray) -> list[int | None]:
    """Scores for a bigint column; null if below it. One above it is among the results for certain, so it is an error."""
    out = [int(x) for x in score]
    if max(out) >= 1 << 63:
        raise ValueError("a score among the results doesn't fit in a bigint")
    return [x if x >= -(1 << 63) else None for x in out]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, queries_mb: int = 32) -> DataFrame:
    """Top k of every query among all other rows of ``vectors`` (vec_id, embedding).

    Queries are the rows whose id is divisible by ``every``. Returns query_id, rank (from 1), vec_id
    and score, the inner product of the vectors after floor(256 x); ties go to the smaller id. A
    query with fewer candidates gets all of them. Vectors that are null or hold a null or non-finite
    component, and rows without id, take no part; vectors of different lengths never meet. Rows
    that repeat an id are one candidate each, except for queries of that id, and one query each, so
    that an id of several rows has several lists of k. An empty vector scores 0 against other empty
    ones. An empty table gives no rows; other columns are not read. Scores are exact for components
    of any size; only a score in the result that doesn't fit in a bigint raises an error.

    The queries go to the executors in slices of at most ``queries_mb``, each slice against all
    candidates, so no broadcast grows with the data. A task returns its k best of each query.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", finite(F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = rows.where(F.col("vec_id") % every == 0)
    cells = asked.agg(F.sum(F.size("v") + 2)).first()[0] or 0
    slices = max(1, -(-cells * 8 // (queries_mb << 20)))
    found = None
    for i in range(slices):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == i).toPandas() if cells else None
        if part is None or not len(part):
            continue
        sent = spark.sparkContext.broadcast(_grouped(part["vec_id"].to_numpy(np.int64), list(part["v"])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            groups = sent.value
            owner = np.concatenate([own for parts in groups.values() for _, own, _ in parts])
            best, first, at = Best(len(owner), k), {}, 0
            for d, parts in groups.items():
                for large, own, _ in parts:
                    first[d, large] = at
                    at += len(own)
            held_ids, held = [], []

            def flush() -> None:
                for d, blocks in _grouped(np.array(held_ids, np.int64), held).items():
                    for big, ids, block in blocks:
                        for large, own, asked in groups.get(d, []):
                            search = search_large if big or large else search_block
                            search(asked, own, block, ids, best, np.arange(first[d, large], first[d, large] + len(own)))
                held_ids.clear()
                held.clear()

            for b in batches:
                held_ids += b.column(0).to_pylist()
                held += [x.values.to_numpy(zero_copy_only=False) for x in b.column(1)]
                if len(held) >= BLOCK:
                    flush()
            if held:
                flush()
            for at in range(0, len(owner), BLOCK):
                span = range(at, min(at + BLOCK, len(owner)))
                n = [len(best.id[i]) for i in span]
                if sum(n):
                    score = pa.array(fitting(np.concatenate([best.score[i] for i in span])), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(span, n)), pa.array(np.repeat(owner[at : at + BLOCK], n)), pa.array(np.concatenate([best.id[i] for i in span])), score],
                        names=["query", "query_id", "vec_id", "score"],
                    )

        each = rows.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score bigint")
        # By the query's number in its slice, since rows may share an id.
        order = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "vec_id")
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    low = F.raise_error(F.lit("a score among the results doesn't fit in a bigint")).cast("bigint")
    return found.select("query_id", "rank", "vec_id", F.when(F.col("score").isNull(), low).otherwise(F.col("score")).alias("score"))
