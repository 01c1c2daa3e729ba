"""Exact top-k inner products on an impact-ordered index, score at a time.

Vectors are integers, floor(scale * x). Each block of candidates has its own index: in every dimension the rows sorted by value. The
impact of a posting is what it adds to a query's score over the least that its dimension can add. Impacts are quantised to ``LEVELS``
levels, and the segments of all dimensions are processed by descending level, so that accumulators hold what a row has got from
its great impacts. A row may still get the level's impact from each dimension that it wasn't met in, or less where a dimension's
greatest impact is smaller. Once this proves that few rows can reach the bar, those are scored exactly and the search stops; else
it goes on to the last level, and what then may still belong is scored exactly. So the result is exact for any data.

The bar is the query's k-th best score so far: first among a few rows that all tasks know, then from block to block.

Rows and nulls: see ``vectors.clean``; zero vectors take part. Rows that share a query's id are the query itself. Repeated vectors are
rows of their own, ties to the smaller id. Vectors of different lengths are searched apart. Components so large that a score might
not fit 52 bits are an error, named before anything is searched. Other columns are not read. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, slices, table
from lectern.llm.vectors import PER_ROUND, SEED_ROWS, batch_arrays, best, by_length, clean, drawn, first_found, in_rounds, raised

BLOCK = 32768
LEVELS = 16
SCORE_BITS = 52  # accumulators are doubles


class ImpactIndex:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.rows = np.argsort(x.T, axis=1, kind="stable")
        self.values = np.take_along_axis(x.T, self.rows, axis=1).astype(np.float64)

    def top(self, qid: int, q: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of this block, as far as they reach ``bar``."""
        n, dim = self.x.shape
        qf = q.astype(np.float64)
        least, most = qf * self.values[:, 0], qf * self.values[:, -1]
        least, most = np.minimum(least, most), np.maximum(least, most)
        base, greatest = least.sum(), most - least
        others = self.ids != qid
        few = max(4 * k, n // 32)
        sums, met = np.zeros(n), np.zeros(n, np.int64)  # what a row got, and in how many dimensions
        may = others
        if bar > -np.inf and base + greatest.sum() < bar:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.where(q > 0, n, 0)  # up to here a dimension is processed, from above or from below
        for level in range(LEVELS - 1, -1, -1):
            impact = greatest.max() * level / LEVELS
            begun = (greatest > impact) & (q != 0)
            where, adds = [], []
            for d in np.flatnonzero(begun if level else q):
                line = self.values[d]
                to = int(line.searchsorted((impact + least[d]) / qf[d], "right" if q[d] > 0 else "left")) if level else (0 if q[d] > 0 else n)
                part = slice(min(to, at[d]), at[d]) if q[d] > 0 else slice(at[d], max(to, at[d]))
                if part.start < part.stop:
                    at[d] = to
                    where.append(self.rows[d, part])
                    adds.append(line[part] * qf[d])
                    adds[-1] -= least[d]
            if where:
                where = np.concatenate(where)
                sums += np.bincount(where, np.concatenate(adds), n)
                met += np.bincount(where, minlength=n)
            low = bar
            if bar == -np.inf and np.count_nonzero(others) > k:
                known = sums[others] + base
                low = np.partition(known, len(known) - k)[len(known) - k]
            # what a row may still get: in dimensions begun that it was not met in, and in those not begun; 1 is more than rounding
            may = others & (sums - met * impact >= low - base - impact * begun.sum() - greatest[~begun].sum() - 1)
            if np.count_nonzero(may) <= few:
                break
        rows = np.flatnonzero(may)
        score = self.x[rows] @ q
        high = score >= bar
        _, vec, score = best(np.zeros(np.count_nonzero(high), np.int64), self.ids[rows[high]], score[high], k)
        return vec, score


def scan(rows: DataFrame, dim: int, ids: np.ndarray, q: np.ndarray, bars: np.ndarray, k: int, scale: float) -> DataFrame:
    """Best k of each query among the rows of each partition."""
    asked = np.floor(scale * q).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = bars.copy()
        got = [np.empty(0, np.int64)] * 3  # place of the query, id, score

        def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
            vec, x = (np.concatenate(p) for p in zip(*parts))
            index = ImpactIndex(vec, np.floor(scale * x).astype(np.int64))
            found = [got]
            for at, (qid, v) in enumerate(zip(ids.tolist(), asked)):
                vec, score = index.top(qid, v, k, bar[at])
                found.append([np.full(len(vec), at), vec, score])
            got[:] = best(*(np.concatenate(y) for y in zip(*found)), k)
            raised(bar, got[0], got[2], k)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, BLOCK):
            held.append(batch_arrays(batch, dim))
            if sum(len(v) for v, _ in held) >= BLOCK:
                block(held)
                held = []
        if held:
            block(held)
        if len(got[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[got[0]]), pa.array(got[1]), pa.array(got[2])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(each, "query_id long, vec_id long, score long")


def search_one(rows: DataFrame, dim: int, n: int, most: float, chosen: Column, k: int, scale: float, per_round: int) -> DataFrame:
    if dim * 2 * (scale * most + 1) ** 2 >= 2.0**SCORE_BITS:
        raise ValueError(f"{dim} components up to {most}: scores may not fit {SCORE_BITS} bits")
    sample_ids, x = drawn(rows, n, SEED_ROWS)
    sample = np.floor(scale * x)
    bars = lambda ids, q: first_found(ids, np.floor(scale * q), sample_ids, sample, k)[0]
    with scratch(rows.sparkSession) as keep:
        return in_rounds(rows, chosen, k, "long", lambda ids, q: (scan(rows, dim, ids, q, bars(ids, q), k, scale), None), per_round, keep)


def search(vectors: DataFrame, chosen: Column, k: int = 5, scale: float = 256.0, per_round: int = PER_ROUND) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``chosen`` holds for, its k largest integer inner products."""
    rows = clean(vectors, zero=True)
    found = [search_one(rows.filter(F.size("vector") == dim), dim, n, most, chosen, k, scale, per_round) for dim, n, most in by_length(rows)]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty


def op4_topk(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
