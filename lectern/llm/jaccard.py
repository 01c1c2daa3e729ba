"""Near-duplicates by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, components.

Each distinct set gets a fingerprint and keys once, so exact copies never multiply. First the fingerprints are searched by
``simhash.links``, with its Golay keys: sets of one fingerprint, and of two that are linked, are candidates, which the sets confirm.
Fingerprints miss many pairs at 0.8, so what they leave apart goes through an exact prefix filter. All shingles have one order there:
those that are common in a sample last, then by hash. Two sets at 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of
each, so those are the keys. The sample only sets the order: it decides what a search costs, never what it finds.

Each set of a key is paired with two pivots of the key that it is not yet joined to, which joins dense groups; a key of up to three
sets is done then. In larger keys, pairs that are not yet joined are taken, once for all keys that share a root; a key with more than ``BLOCK`` sets is compared in blocks. Parity bitmaps of about a bit a shingle rule out nearly all strangers: they
never differ in more bits than the sets differ in shingles. What is left is verified with the sets themselves.

Shingles are 64-bit hashes of A-Z lower-cased words between white space; a text of five words or fewer is one shingle. Rows and
nulls: texts without a word are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import few, materialize, scratch, settle, slices
from lectern.llm.simhash import components

WORDS = 5
LEAST = (4, 5)  # similarity 4 / 5
BLOCK = 4096
LOAD = 1 << 16  # rows of keys that are searched together, about
SEEN = 32  # of those keys, the largest whose pairs are known to be tested
PAIRS = 1 << 17  # that are looked at at a time
PIVOTED = 3  # so many sets in a key are all paired by its two pivots
BITMAP = 512  # least bits
COMMON = 1 << 17  # most shingles that the order puts last
_WORD_HASHES: dict[bytes, int] = {}


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes, sorted."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], np.uint64)
    if len(_WORD_HASHES) > 1 << 15:
        _WORD_HASHES.clear()
    for w in set(found).difference(_WORD_HASHES):
        _WORD_HASHES[w] = xxhash.xxh64_intdigest(w)
    of = np.fromiter(map(_WORD_HASHES.__getitem__, found), np.uint64, len(found))
    n = len(of) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + of[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set at ``LEAST`` has one among its own first; ``common`` is sorted."""
    n = len(found)
    if not n:
        return found
    last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(n, bool)
    return np.concatenate([found[~last], found[last]])[: n - -(-LEAST[0] * n // LEAST[1]) + 1]


def sketch(found: np.ndarray) -> bytes:
    """How many shingles there are, and their parity at each bit of a bitmap with a power of two of bits."""
    width = max(BITMAP, 1 << (len(found) - 1).bit_length())
    parity = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return len(found).to_bytes(8, "little") + np.packbits(parity.astype(np.uint8)).tobytes()


def opened(sketch: bytes) -> tuple[int, np.ndarray]:
    return int.from_bytes(sketch[:8], "little"), np.frombuffer(sketch, np.uint64, offset=8)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits, in 64-bit words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def within(apart, total):
    """Sets at similarity s differ in (1 - s) / (1 + s) of the sum of their sizes at most."""
    return (LEAST[1] + LEAST[0]) * apart <= (LEAST[1] - LEAST[0]) * total


def sketches_agree(x: bytes, y: bytes) -> bool:
    (n, a), (m, b) = opened(x), opened(y)
    words = min(len(a), len(b))
    return within(abs(n - m), n + m) and within(int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()), n + m)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted; those in 4 or more of the distinct texts of one in 16, the ``COMMON`` most frequent at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            for text in rows.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], ["s"])

    drawn = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(16)) == 0)).select("text").distinct()
    counts = drawn.select(F.col("text").cast("binary").alias("text")).mapInArrow(each, "s long").groupBy("s").count().filter("count > 3")
    found = counts.orderBy(F.desc("count"), "s").limit(COMMON).collect()  # bounded
    return np.sort(np.array([r["s"] for r in found], np.int64).view(np.uint64))


def keyed(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, row, sig (hash of the set), fp (its fingerprint), sketch, keys of each row of ``doc_id, row, text``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in slices(batches, 64):
            sets = [shingle_set(t or b"") for t in b.column(2).to_pylist()]
            sigs = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            made = [pa.array(sigs), pa.array([simhash.majority(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
            keys = pa.array([prefix(s, common).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, keys], ["doc_id", "row", "sig", "fp", "sketch", "keys"])

    schema = "doc_id long, row long, sig long, fp long, sketch binary, keys array<long>"
    return rows.select("doc_id", "row", F.col("text").cast("binary")).mapInArrow(each, schema)


def judged(pairs: DataFrame, sides: DataFrame, test, label: str, crowd: int = 256) -> DataFrame:
    """Those of the pairs ``a, b`` whose values pass; ``sides`` has sig, value. A ``b`` with many pairs is dealt over several tasks."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in slices(batches, 64):
            ok = pa.array([test(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / crowd).alias("cells")).filter("cells > 1")
    hubs = F.broadcast(materialize(hubs, "hubs"))  # one in ``crowd`` pairs at most
    cells = F.coalesce("cells", F.lit(1))
    put = pairs.join(hubs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), cells).alias("cell"))
    ends = sides.join(hubs, sides["sig"] == hubs["b"], "left").select(F.col("sig").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), F.col("value").alias("y"))
    both = put.join(sides.select(F.col("sig").alias("a"), F.col("value").alias("x")), "a").join(ends, ["b", "cell"])
    return materialize(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"), label)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()


def verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs of sigs whose sets are similar."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in slices(batches, 64):
            made = [shingle_set(t or b"").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["sig", "value"])

    wanted = materialize(distinct.join(ends_of(pairs), "sig", "left_semi").select("sig", "best.row"), "wanted")
    texts = rows.join(few(wanted), "row").select("sig", F.col("text").cast("binary").alias("text")).dropDuplicates(["sig"])
    sets = materialize(texts.mapInArrow(sets_of, "sig long, value binary"), "sets")
    return judged(pairs, sets, lambda x, y: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), "similar")


class Sketches:
    """Sets by their sketches, and the components that they are known to be in."""

    def __init__(self, root: np.ndarray, sketches: list[bytes]):
        self.root = root
        self.n, bits = np.array([opened(x)[0] for x in sketches], np.int64), [opened(x)[1] for x in sketches]
        self.words = np.array([len(x) for x in bits])
        self.narrow = {}
        for width in np.unique(self.words):
            # sizes of similar sets differ by less than a factor of two, and so do the widths by a factor of two at most
            rows = np.flatnonzero((self.words == width) | (self.words == 2 * width))
            place = np.full(len(bits), -1)
            place[rows] = np.arange(len(rows))
            self.narrow[width] = place, np.stack([folded(bits[k], width) for k in rows])

    def pairs(self, first: np.ndarray, second: np.ndarray, within_one: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places i in ``first`` and j in ``second``, each pair once, of different roots, that sizes and bitmaps don't exclude."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, PAIRS // max(1, len(second)))
        for at in range(0, len(first), step):
            i, j = first[at : at + step, None], second[None]
            may = (self.root[i] != self.root[j]) & within(np.abs(self.n[i] - self.n[j]), self.n[i] + self.n[j])
            row, col = np.nonzero(may & (i < j) if within_one else may)
            i, j = i[row, 0], j[0, col]
            least = np.minimum(self.words[i], self.words[j])
            for width, (place, table) in self.narrow.items():
                some = least == width
                p, q = place[i[some]], place[j[some]]
                near = (p >= 0) & (q >= 0)
                p, q, x, y = p[near], q[near], i[some][near], j[some][near]
                apart = np.bitwise_count(table[p] ^ table[q]).sum(axis=1, dtype=np.int64)
                ok = within(apart, self.n[x] + self.n[y])
                a.append(x[ok])
                b.append(y[ok])
        return np.concatenate(a), np.concatenate(b)


def near_fingerprints(distinct: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges a, b of similar sets that have one fingerprint, or two that ``simhash.links`` links.

    A set is verified with the smallest of those that its fingerprint and bitmap admit; the prefix filter looks at what that leaves apart.
    """
    heads = materialize(distinct.groupBy("fp").agg(F.min("sig").alias("head")), "heads")
    same = distinct.join(heads, "fp").filter("sig <> head").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    found = simhash.links(heads.select("fp"), block).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    found = found.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    sketches = distinct.select("sig", F.col("sketch").alias("value"))
    likely = judged(materialize(same.unionByName(found), "fingerprinted"), sketches, sketches_agree, "alike")
    return verified(materialize(likely.groupBy("a").agg(F.min("b").alias("b")), "nearest"), distinct, rows)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that are not in one component yet."""
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}")), end, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def links(distinct: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges a, b that connect just what pairs of similar sets connect; ``distinct`` has each sig once."""
    first = near_fingerprints(distinct, rows, block)
    joined = components(first)
    posted = distinct.select("sig", F.explode("keys").alias("key"))
    of_key = Window.partitionBy("key")
    shared = posted.withColumn("c", F.count("*").over(of_key)).filter("c > 1")
    shared = shared.withColumn("low", F.min("sig").over(of_key)).withColumn("high", F.max("sig").over(of_key))
    shared = materialize(shared, "shared")
    pairs = apart(shared.select(F.col("sig").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter("a <> b").distinct(), joined)
    sketches = distinct.select("sig", F.col("sketch").alias("value"))
    likely = judged(materialize(pairs, "pivoted"), sketches, sketches_agree, "likely")
    edges = materialize(first.unionByName(verified(likely, distinct, rows)), "found")
    large = shared.filter(F.col("c") > PIVOTED)
    if large.isEmpty():
        return edges
    roots = components(edges).withColumnRenamed("node", "sig")
    sides = distinct.select("sig", "sketch").join(large.select("sig").distinct(), "sig", "left_semi").join(roots, "sig", "left")
    sides = materialize(sides.select("sig", "sketch", F.coalesce("root", "sig").alias("root")), "sides")
    named = materialize(large.select("key", "sig", "c").join(sides.select("sig", "root"), "sig"), "named")
    open_keys = named.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.first("c").alias("n")).filter("r <> s").select("key", "r", "n")
    # keys of one dense group have about the same sets: those that share a root are searched together, so that a pair is tested once
    load = open_keys.groupBy("r").agg(F.ceil(F.sum("n") / LOAD).alias("parts"))
    parted = open_keys.join(load, "r").select("key", "r", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"))
    left = named.join(parted, "key").withColumn("blocks", F.ceil(F.col("c") / block)).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = left.select("key", "r", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "sig").join(sides, "sig")

    def cell(pdf):
        import pandas as pd

        sig, at, place = np.unique(pdf["sig"].to_numpy(), return_index=True, return_inverse=True)
        sets, x, y = Sketches(pdf["root"].to_numpy()[at], list(pdf["sketch"].iloc[at])), pdf["x"].iloc[0], pdf["y"].iloc[0]
        key, own = pdf["key"].to_numpy(), pdf["own"].to_numpy()
        order = np.lexsort((place, key))
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        pairs, seen, none = [], [], np.zeros(len(sig), bool)
        for rows in sorted(np.split(order, cuts), key=len, reverse=True):
            every, one = place[rows], own[rows] == x
            covers = max(seen, key=lambda m: np.count_nonzero(m[every]), default=none)
            new = ~covers[every]
            if x == y:
                pairs += [sets.pairs(every[new], every[new], True), sets.pairs(every[new], every[~new], False)]
            else:
                pairs += [sets.pairs(every[new & one], every[~one], False), sets.pairs(every[~new & one], every[new & ~one], False)]
            if len(seen) < SEEN:
                seen.append(none.copy())
                seen[-1][every] = True
        a, b = (sig[np.concatenate(side)] for side in zip(*pairs))
        found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pd.DataFrame({"a": found[0], "b": found[1]})

    more = left.groupBy("r", "part", "x", "y").applyInPandas(cell, "a long, b long")
    more = materialize(more.distinct(), "more")
    return edges.unionByName(verified(more, distinct, rows))


def representatives(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``row`` of one row of each component: that with the smallest doc_id, then the smallest row; rows without an id come last.

    ``rows`` has doc_id, row (a hash of the whole row) and text.
    """
    spark = rows.sparkSession
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    with scratch(spark) as keep:
        made = keyed(rows, common_shingles(rows)).groupBy("sig").agg(best, F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        distinct = materialize(made, "distinct")
        roots = materialize(components(links(distinct, rows, block)), "roots")
        named = distinct.select("sig", "best").join(roots, distinct["sig"] == roots["node"], "left").select(F.coalesce("root", "sig").alias("root"), "best")
        return keep(materialize(named.groupBy("root").agg(F.min("best").alias("best")).select("best.row"), "representatives"))
