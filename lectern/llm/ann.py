"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted in numpy on a bounded sample (``sample`` rows). Every row is then indexed: list number, codes of
its residual, original vector; the index is written once, sorted by list, a large list dealt over several parts. A query
probes the lists whose centroids suit it best and scores their codes by its table of partial products (an inner product is the
centroid's part plus the codes' parts). Rows whose coded score comes within ``slack`` of the query's k-th best so far are scored
again on the original vectors in double precision.

Both bounds are measured on the index itself: for up to ``CALIBRATION`` queries the true neighbours among all rows are found by
brute force, with the rank of their list and the error of their coded score; probes and slack are the least that hold the asked
recall of them. As all lists and any slack are allowed, any recall below 1 can be met, if need be by scoring every row.

Rows and nulls: see ``vectors.clean``; a zero vector takes no part. Rows that share a query's id are the query itself and no candidates
of it. Rows with equal vectors share one code; all are found, ties to the smaller id. Vectors of different lengths are searched apart.
Other columns are not read. With no clean row the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize, scratch, slices, table
from lectern.llm.vectors import PER_ROUND, SEED_ROWS, batch_arrays, best, by_length, clean, drawn, first_found, in_rounds, raised

BLOCK = 5000  # rows that are searched at a time
ASKED = 512  # queries that they are scored for at a time
PAIRS = 1 << 16  # pairs that are scored exactly at a time
CALIBRATION = 256
EMPTY = "query_id long, rank int, vec_id long, score double"
LARGE = 1e15  # components that single precision has no room for the products of


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids; an empty cluster keeps its last centre."""
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centre)
        count = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        some = count > 0
        starts = np.concatenate([[0], np.cumsum(count)[:-1]])[some]
        centre[some] = np.add.reduceat(x[order], starts, axis=0) / count[some, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)


@dataclass
class Quantizer:
    centres: np.ndarray  # lists x dim
    books: list[np.ndarray]  # a codebook for each slice of dimensions
    slices: list[tuple[int, int]]
    kind: str = "f4"  # of coded scores

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int = 16, codes: int = 256, seed: int = 3, kind: str = "f4") -> Quantizer:
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        centres = kmeans(x, min(lists, len(x)), 12, rng)
        rest = x - centres[nearest(x, centres)]
        edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return cls(centres, [kmeans(rest[:, a:b], min(codes, len(x)), 8, rng) for a, b in cuts], cuts, kind)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.slices, self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Partial products, a row a code and a column a query."""
        return [(book @ q[:, a:b].T).astype(self.kind) for (a, b), book in zip(self.slices, self.books)]

    def coded(self, tables: list[np.ndarray], centred: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of rows of one list by their codes, a row each, a column a query; ``centred`` is the list's own part."""
        score = tables[0][codes[:, 0]]
        for t, col in zip(tables[1:], codes.T[1:]):
            score += t[col]
        score += centred.astype(self.kind)
        return score


def runs(lists: np.ndarray) -> list[tuple[int, int, int]]:
    """(list, from, to) of rows that follow one another."""
    edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
    return [(int(lists[a]), a, b) for a, b in zip(edges[:-1], edges[1:])]


def build(rows: DataFrame, dim: int, model: Quantizer) -> DataFrame:
    """The index: vec_id, vector, list, codes of every row, in parts sorted by list; written once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            _, x = batch_arrays(batch, dim)
            at, codes = model.encode(x)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), packed], ["vec_id", "vector", "list", "codes"])

    coded = rows.mapInArrow(each, "vec_id long, vector array<double>, list int, codes binary")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of (list, hash of id): a list longer than a part goes on in the next one
    dealt = coded.withColumn("h", F.xxhash64("vec_id")).repartitionByRange(n, "list", "h").sortWithinPartitions("list", "vec_id")
    return materialize(dealt.select("vec_id", "vector", "list", "codes"), "ivf")


def opened(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vec, x = batch_arrays(batch, dim)
    return vec, x, batch.column(2).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(vec), -1)


def calibrate(index: DataFrame, dim: int, model: Quantizer, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Probes and slack that hold ``recall`` of the true neighbours of these queries among all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables(q)
        centred = model.centres @ q.T
        for batch in slices(batches, BLOCK):
            vec, x, lists, codes = opened(batch, dim)
            exact = x @ q.T
            exact[vec[:, None] == ids[None]] = -np.inf
            lead = np.argpartition(-exact, k - 1, axis=0)[:k] if len(vec) > k else np.repeat(np.arange(len(vec))[:, None], len(q), 1)
            coded = np.concatenate([model.coded(tables, centred[c], codes[a:b]) for c, a, b in runs(lists)])
            at = np.repeat(np.arange(len(q))[None], len(lead), 0).ravel()
            row = lead.ravel()
            keep = exact[row, at] > -np.inf
            row, at = row[keep], at[keep]
            cols = [at.astype(np.int32), exact[row, at], coded[row, at].astype(np.float64), lists[row].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "score", "coded", "list"])

    near = index.mapInArrow(each, "query int, score double, coded double, list int")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    true = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).collect()  # k rows for each of CALIBRATION queries
    if not true:
        return 1, 0.0
    ranked = np.argsort(np.argsort(-(q @ model.centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    rank = ranked[[t["query"] for t in true], [t["list"] for t in true]]
    error = np.array([t["score"] - t["coded"] for t in true])
    slack = max(0.0, float(np.quantile(error, (1 + recall) / 2, method="higher")))
    share = np.cumsum(np.bincount(rank[error <= slack], minlength=len(model.centres))) / len(true)
    return int(np.argmax(share >= recall)) + 1, slack


def probe(index: DataFrame, dim: int, model: Quantizer, ids: np.ndarray, q: np.ndarray, bars: np.ndarray, k: int, probes: int, slack: float) -> DataFrame:
    """Best k of each query in each part of the index."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = bars.copy()
        asks = np.zeros((len(q), len(model.centres)), bool)
        for i in range(0, len(q), ASKED):
            coarse = q[i : i + ASKED] @ model.centres.T
            np.put_along_axis(asks[i : i + ASKED], np.argpartition(-coarse, probes - 1, axis=1)[:, :probes], True, axis=1)
        got = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)]  # place of the query, id, score

        def exact(members: list[np.ndarray], vec: np.ndarray, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
            score = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", q[at[i : i + PAIRS]], x[row[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)]])
            high = score >= bar[at]
            row, at, score = row[high], at[high], score[high]
            if members:
                size = np.array([len(members[r]) for r in row], np.int64)
                row, at, score = np.concatenate([np.empty(0, np.int64), *[members[r] for r in row]]), np.repeat(at, size), np.repeat(score, size)
            other = vec[row] != ids[at]
            return [at[other], vec[row][other], score[other]]

        for batch in slices(batches, BLOCK):
            vec, x, lists, codes = opened(batch, dim)
            heads, members = equal_rows(vec, x, k)
            found = [got]
            where = runs(lists[heads])
            for i in range(0, len(q), ASKED):
                mine = q[i : i + ASKED]
                tables, floor = model.tables(mine), (bar[i : i + ASKED] - slack).astype(model.kind)
                rows, cols = [], []
                for c, a, b in where:
                    who = np.flatnonzero(asks[i : i + ASKED, c])
                    if not len(who):
                        continue
                    few = 2 * len(who) < len(mine)
                    if not few:
                        who = np.arange(len(mine))
                    score = model.coded([t[:, who] for t in tables] if few else tables, mine[who] @ model.centres[c], codes[heads[a:b]])
                    row, col = np.nonzero((score >= floor[who]) & asks[i + who, c])
                    if len(row) > score.size // 8:  # rather all at once, but for what rounding may differ by
                        whole = x[heads[a:b]] @ mine[who].T
                        row, col = np.nonzero((whole >= bar[i + who] - 1e-9 * np.abs(whole)) & asks[i + who, c] & (score >= floor[who]))
                    col = who[col]
                    rows.append(row + a)
                    cols.append(col + i)
                    if sum(map(len, rows)) > PAIRS:
                        found.append(exact(members, vec, x, heads[np.concatenate(rows)], np.concatenate(cols)))
                        rows, cols = [], []
                if rows:
                    found.append(exact(members, vec, x, heads[np.concatenate(rows)], np.concatenate(cols)))
            got = list(best(*(np.concatenate(y) for y in zip(*found)), k))
            raised(bar, got[0], got[2], k)
        if len(got[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[got[0]]), pa.array(got[1]), pa.array(got[2])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(each, "query_id long, vec_id long, score double")


def equal_rows(vec: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row of each group of equal vectors, ascending, and by row the group's k + 1 rows with the smallest ids (the rest can't be
    among the k best of any query); no groups, if all vectors differ."""
    odd = np.random.default_rng(1).integers(1, 2**63, x.shape[1], dtype=np.uint64) | np.uint64(1)
    mark = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(axis=1)
    _, first, group = np.unique(mark, return_index=True, return_inverse=True)
    if len(first) == len(x):
        return np.arange(len(x)), []
    if not (x[first[group]] == x).all():  # marks that collide
        _, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
    members: list[np.ndarray] = [np.empty(0, np.int64)] * len(x)
    order = np.lexsort((vec, group))
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        members[first[group[rows[0]]]] = rows[: k + 1]
    return np.sort(first), members


def search_one(rows: DataFrame, dim: int, n: int, most: float, chosen: Column, k: int, sample: int, recall: float, per_round: int) -> DataFrame:
    spark = rows.sparkSession
    with scratch(spark) as keep:
        some = F.shiftrightunsigned(F.xxhash64(F.lit("asked"), "vec_id"), 1)
        asked = rows.filter(chosen).orderBy(some, "vec_id").limit(CALIBRATION).collect()  # bounded
        asked_ids, asked_q = np.array([r["vec_id"] for r in asked], np.int64), np.array([r["vector"] for r in asked], np.float64).reshape(-1, dim)
        if not asked:
            return spark.createDataFrame([], EMPTY)
        sample_ids, x = drawn(rows, n, sample)
        model = Quantizer.fit(x, lists=max(1, min(1024, int(n**0.5 / 4), len(x) // 8)), kind="f4" if most < LARGE else "f8")
        index = build(rows, dim, model)
        probes, slack = calibrate(index, dim, model, asked_ids, asked_q, k, recall)
        seeds = np.random.default_rng(5).permutation(len(x))[:SEED_ROWS]

        def answer(ids: np.ndarray, q: np.ndarray) -> tuple[DataFrame, list]:
            bars, first = first_found(ids, q, sample_ids[seeds], x[seeds], k)
            return probe(index, dim, model, ids, q, bars, k, probes, slack), first

        return in_rounds(rows, chosen, k, "double", answer, per_round, keep, fill=True)


def search(vectors: DataFrame, chosen: Column, k: int = 20, sample: int = 20000, recall: float = 0.97, per_round: int = PER_ROUND) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``chosen`` holds for, its k largest inner products found."""
    rows = clean(vectors, zero=False)
    found = [search_one(rows.filter(F.size("vector") == dim), dim, n, most, chosen, k, sample, recall, per_round) for dim, n, most in by_length(rows)]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], EMPTY)


def op1_ann(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
