"""What both vector searches share: clean vectors, bounded rounds of queries, first bars, the merge of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import work_path, written

PER_ROUND = 16384  # queries that one pass over the candidates answers; bounds what is broadcast
SEED_ROWS = 2048  # rows that give each query a first bar


def clean(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Out go rows without id or vector, with an empty vector, with a null or non-finite component and, unless ``zero``, with zeros only.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.coalesce(F.forall("vector", finite), F.lit(False))
    if not zero:
        ok = ok & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(ok)


def by_length(rows: DataFrame) -> list[tuple[int, int, float]]:
    """Length of vectors, how many have it, their greatest component; vectors of different lengths have no inner product, so
    each length is searched by itself."""
    most = F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    found = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), most.alias("most")).collect()  # one row a length
    return sorted((r["n"], r["rows"], r["most"]) for r in found)


def drawn(rows: DataFrame, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about ``wanted`` of the ``n`` rows, chosen by a hash of the id, in an order of their own."""
    share = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "vec_id"), 32) / F.lit(2**32)
    some = rows.filter(share < min(1.0, wanted / n)).limit(2 * wanted).collect() or rows.limit(1).collect()  # bounded by the parameter
    ids, x = np.array([r["vec_id"] for r in some], np.int64), np.array([r["vector"] for r in some], np.float64)
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order], x[order]


def first_found(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Among a few rows, the k best of each query (query, id, score) and the k-th score, which the query's k-th best row has at least:
    below that bar nothing needs to be looked at. No bar, where there are not k others."""
    bars, found = np.full(len(q), -np.inf), [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    for i in range(0, len(q) if len(sample) > k else 0, 1024):
        scores = q[i : i + 1024] @ sample.T
        scores[ids[i : i + 1024, None] == sample_ids[None]] = -np.inf
        lead = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        at = np.repeat(np.arange(i, i + len(lead)), k)
        row = lead.ravel()
        bars[i : i + 1024] = np.take_along_axis(scores, lead, axis=1).min(axis=1)
        other = scores[at - i, row] > -np.inf
        at, row = at[other], row[other]
        for kept, new in zip(found, (ids[at], sample_ids[row], np.einsum("ij,ij->i", q[at], sample[row]))):
            kept.append(new)
    # sums of another order may be a rounding greater
    return bars - 1e-9 * np.abs(np.where(np.isfinite(bars), bars, 0.0)), [np.concatenate(x) for x in found]


def query_rounds(rows: DataFrame, chosen: Column, per_round: int = PER_ROUND) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the chosen rows, ``per_round`` of them or about as many at a time; one vector an id, the smallest.

    They are written by round first, so that a round reads its own folder and not the table."""
    spark = rows.sparkSession
    asked = rows.filter(chosen).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rounds = -(-asked.count() // per_round)
    if not rounds:
        return
    path = work_path(spark, "asked")
    asked.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).cast("int")).write.partitionBy("round").parquet(path)
    every = written(spark, path, "vec_id long, vector array<double>, round int")
    for k in range(rounds):
        part = every.filter(F.col("round") == k).orderBy("vec_id").collect()  # a bounded round
        if part:
            yield np.array([r["vec_id"] for r in part], np.int64), np.array([r["vector"] for r in part], np.float64)


def batch_arrays(rows: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.column(1).flatten().to_numpy(zero_copy_only=False)
    return rows.column(0).to_numpy(zero_copy_only=False), flat.reshape(-1, dim)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: score descending, then id ascending."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.empty(0, int)
    keep = np.arange(len(query)) - start < k
    return query[keep], vec[keep], score[keep]


def raised(bars: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Raise each query's bar to its k-th score so far; ``query`` and ``score`` are the best, as ``best`` gives them."""
    if len(query) >= k:
        full = np.flatnonzero(query[k - 1 :] == query[: len(query) - k + 1])
        bars[query[full]] = np.maximum(bars[query[full]], score[full + k - 1])


def in_rounds(rows: DataFrame, chosen: Column, k: int, kind: str, answer: Callable[[np.ndarray, np.ndarray], tuple[DataFrame, list | None]], per_round: int, keep: Callable[[DataFrame], DataFrame], fill: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: what ``answer`` finds for each round of queries (and first found), written before the next round is read, so that
    the driver holds one round at a time. ``kind`` is the type of a score; ``keep`` is told of the table that the result reads."""
    spark = rows.sparkSession
    schema = f"query_id long, vec_id long, score {kind}"
    path = work_path(spark, "best")
    spark.createDataFrame([], schema).write.parquet(f"{path}/first=0/round=-1")
    for n, (ids, q) in enumerate(query_rounds(rows, chosen, per_round)):
        made, first = answer(ids, q)
        made.write.parquet(f"{path}/first=0/round={n}")
        if first is not None:
            spark.createDataFrame(pa.table(first, names=["query_id", "vec_id", "score"])).write.parquet(f"{path}/first=1/round={n}")
    found = keep(written(spark, path, f"{schema}, first int, round int"))
    # what was first found stands in where too little else was
    if fill:
        only = F.min("first").over(Window.partitionBy("query_id", "vec_id"))
        found = found.withColumn("only", only).filter(F.col("first") == F.col("only"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
