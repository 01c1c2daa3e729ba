"""SimHash near-duplicates with Golay-code keys: fingerprints of 64 bits, links at 3 or fewer differing bits, components.

Keys. Four exact segments of 16 bits share at most 3 errors, so one of them has none. Of the 48 bits beside it, two halves of
23 bits (two bits stand aside) share the errors, so one half has at most one. A half is decoded with the perfect binary Golay
code: its nearest codeword is within 3 bits, and is within 4 of any word one bit away; a word has that codeword among its 1 or
6 codewords within 4. So two linked fingerprints share (segment, half, exact bits, codeword), where it is the nearest of one of
them: 8 pairs of segment and half, about 42 keys a fingerprint, each of 28 bits.

Only distinct fingerprints get keys, so exact copies never multiply. Inside a key, fingerprints are compared in numpy and what
leaves is a star for each component found, never all pairs. A key with more than ``BLOCK`` fingerprints leaves its task as rows
and is compared in blocks, one task for each pair of blocks. Components come from alternating large-star and small-star rounds
over written tables.

Rows and nulls: a text that is null or has no word has fingerprint 0, linked like any other; rows with one doc_id are rows of
their own; a null doc_id takes part, and is the component's id only if the component has no other. A very long text is hashed
whole, in parts. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_path, materialize, scratch, slices, table

BITS = 3  # differing bits that still link
BLOCK = 4096
SMALL = 16


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z lower-cased; of the whole sequence, if it is shorter."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(line[a:b], seed) for a, b in pairs), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray, at_once: int = 1 << 18) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), at_once):
        part = hashes[i : i + at_once].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (a signed 64-bit number) of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            made = [majority(shingle_hashes(t or b"", words, seed)) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(each, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of each 12-bit message; for each of 2,048 syndromes the error of weight 3 or less, and those of weight 4.

    The code is cyclic with generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1; all tables follow from it.
    """
    checks = np.zeros(4096, np.int64)
    for message in range(4096):
        rest = message << 11
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= 0b110001110101 << (k - 11)
        checks[message] = rest
    syndrome = lambda e: int(checks[e >> 11] ^ (e & 2047))
    leader = np.full(2048, -1, np.int64)
    fours = np.full((2048, 5), -1, np.int64)
    filled = [0] * 2048
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            s = syndrome(error)
            if weight < 4:
                leader[s] = error
            else:
                fours[s, filled[s]] = error
                filled[s] += 1
    return checks, leader, fours


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words: index of the nearest codeword; indices of those at distance 4, -1 where there are none."""
    checks, leader, fours = golay()
    s = checks[words >> 11] ^ (words & 2047)
    more = fours[s]
    return (words ^ leader[s]) >> 11, np.where(more < 0, -1, (words[:, None] ^ more) >> 11)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position in ``fps``, whether the codeword is the nearest) of all keys of the fingerprints."""
    found = []
    every = np.arange(len(fps))
    for segment in range(4):
        low = np.uint64(16 * segment)
        exact = ((fps >> low) & np.uint64(0xFFFF)).astype(np.int64)
        below = fps & np.uint64((1 << 16 * segment) - 1)
        above = (fps >> low >> np.uint64(16)) << low
        rest = below | above  # 48 bits
        for half in range(2):
            word = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            base = (np.int64(segment * 2 + half) << 28) | (exact << 12)
            nearest, more = codewords(word)
            found.append((base | nearest, every, np.ones(len(fps), bool)))
            which, col = np.nonzero(more >= 0)
            found.append((base[which] | more[which, col], which, np.zeros(len(which), bool)))
    return tuple(np.concatenate(x) for x in zip(*found))


def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest) of the components at ``BITS`` bits; each found fingerprint leaves the search at once,
    so a dense group costs about its size and only strangers cost their pairs."""
    left = np.unique(fps)
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        centre, members = todo[0], []
        while todo and len(left):
            near = np.bitwise_count(left.view(np.uint64) ^ np.uint64(int(todo.pop()) & 0xFFFFFFFFFFFFFFFF)) <= BITS
            if near.any():
                new = left[near]
                members.append(new)
                todo.extend(new)
                left = left[~near]
        if members:
            found = np.concatenate(members)
            a.append(found)
            b.append(np.full(len(found), centre))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def compare(key: np.ndarray, fp: np.ndarray, near: np.ndarray) -> tuple[list, list]:
    """Edges inside complete keys, sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    size = np.repeat(count, count)
    a, b = [], []
    small = (size > 1) & (size <= SMALL)
    k, f, n = key[small], fp[small], near[small]
    bits = f.view(np.uint64)
    for d in range(1, SMALL):
        same = (k[d:] == k[:-d]) & (n[d:] | n[:-d])
        same &= np.bitwise_count(bits[d:] ^ bits[:-d]) <= BITS
        if same.any():
            a.append(np.maximum(f[d:][same], f[:-d][same]))
            b.append(np.minimum(f[d:][same], f[:-d][same]))
    for i in np.flatnonzero(count > SMALL):
        x, y = stars(fp[first[i] : first[i] + count[i]])
        a.append(x)
        b.append(y)
    return a, b


def near_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, 4096):
        fps = rows.column(0).to_numpy(zero_copy_only=False)
        key, at, near = keys(fps.view(np.uint64))
        for i in range(0, len(key), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(fps[at[s]]), pa.array(near[s])], ["key", "fp", "near"])


def sorted_links(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: edges (a, b), or the rows of a key with more than ``block`` fingerprints as (a, key)."""
    held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
    hot = -1

    def edges(a: list, b: list) -> Iterator[pa.RecordBatch]:
        if a:
            pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.nulls(pair.shape[1], pa.int64())], ["a", "b", "key"])

    def aside(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key)], ["a", "b", "key"])

    def split(key: np.ndarray, fp: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([first, [len(key)]]))
        large = np.repeat(count > block, count)
        if large.any():
            yield aside(key[large], fp[large])
        if not large.all():
            yield from edges(*compare(key[~large], fp[~large], near[~large]))

    for rows in batches:
        new = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if hot >= 0:
            go = np.searchsorted(new[0], hot, "right")
            if go:
                yield aside(new[0][:go], new[1][:go])
                new = [x[go:] for x in new]
            if not len(new[0]):
                continue
            hot = -1
        held = [np.concatenate(x) for x in zip(held, new)]
        if not len(held[0]):
            continue
        last = np.searchsorted(held[0], held[0][-1])
        if last:
            yield from split(*(x[:last] for x in held))
            held = [x[last:] for x in held]
        if len(held[0]) > block:
            hot = int(held[0][0])
            yield aside(held[0], held[1])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield from split(*held)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges a > b that connect just what links of ``BITS`` bits connect; ``distinct`` has each fp once."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp").mapInArrow(near_keys, "key long, fp long, near boolean")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(lambda b: sorted_links(b, block), "a long, b long, key long"), "links")
    edges = found.filter("key is null").select("a", "b")
    hot = found.filter("key is not null").select("key", F.col("a").alias("fp"))
    if not hot.isEmpty():
        blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
        rows = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

        def cell(pdf):
            import pandas as pd

            a, b = stars(pdf["fp"].to_numpy())
            return pd.DataFrame({"a": a, "b": b})

        edges = edges.unionByName(cells.groupBy("key", "x", "y").applyInPandas(cell, "a long, b long"))
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node with an edge; large-star and small-star in turn.

    Each half-round is written, and so are the minima that it joins: both sides of the join are plain tables then, so that
    Spark can split a node with very many edges.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    spark = edges.sparkSession
    edges = materialize(edges.select("a", "b"), "edges")
    before = mark(edges)
    while before[0]:  # every round but the last one changes the edges, and they only get smaller, so there is a last one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last = edges
        first = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges, steps = materialize(small.select("e.*").filter("a <> b").distinct(), "edges"), (first, large, least)
        after = mark(edges)
        for old in (last, *steps):
            drop_path(spark, old._work_path)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach), one row a row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        of_rows = keep(materialize(fingerprints(docs, words, seed), "fps"))
        distinct = materialize(of_rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
        roots = components(links(distinct))
        named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        named = materialize(named, "named")
        ids = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
        of_fp = keep(materialize(named.join(ids, "root").select("fp", "component_id"), "of_fp"))
    return of_rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
