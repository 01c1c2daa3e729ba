"""Packing documents into windows of a fixed number of tokens, online and with bounded space.

Each partition keeps a fixed number of open windows. A document longer than a window fills windows of its own; its
rest, as any shorter document, goes whole into the open window that it fits best. If it fits none and all windows are
open, the fullest is emitted. What stays open at the end of all partitions is merged: laid end to end in the order of the
partitions and cut into windows, so that one window at most of the whole corpus has a gap from this step.

Rows and nulls: a null text is empty and yields only the closing id; a null doc_id stays null; each of several rows
with one doc_id is packed as a document of its own, and ``row`` tells its pieces from those of the others. A very long text is
tokenized whole and cut into many windows. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import CACHES, materialize, settle, ship, shipped, slices, table, trim

#: Partition number times this plus the window's number is a sequence's id, and plus a document's number its row; those of merged windows follow MERGED.
SPAN = 1 << 32
MERGED = 1 << 61
CHARS = 1_500_000  # of texts that are looked up together
TOGETHER = 4096  # words that the tokenizer gets as one text
MARKS = ".,;:!?"
#: The normalizer and pre-tokenizer under which a word of small letters below U+0250 stays as it is and goes to the model in one piece.
LETTERS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
_RANDOM = np.random.default_rng(1).integers(1, 1 << 64, 256, np.uint64)  # of each byte, for the hashes
_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")
_BYTES = np.arange(256)
_MARK = np.isin(_BYTES, list(MARKS.encode()))
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_PRINTED = np.isin(_BYTES, [*range(33, 127), *range(161, 173), *range(174, 256)])  # bytes that the byte-level alphabet shows as themselves
_BYTE_LETTERS = np.where(_PRINTED, _BYTES, 255 + np.cumsum(~_PRINTED)).astype("<u4")
_BYTE_LETTERS[10] = 10


def _lowered(text: str) -> str | None:
    """The text in lower case, where the tokenizer surely makes the same of both: it composes first, then lowers letter by letter."""
    if "<" in text:
        return None
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if "Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low) else None


def _small(word: str) -> bool:
    """Whether it is small letters below U+0250 only."""
    return word.islower() and word.isalpha() and (word.isascii() or max(word) < "\u0250")


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and which of them is the first of each text, with the number of all at the end.

    In a text that was lowered a single closing mark is a word of its own after a digit or letter of ASCII or of U+00C0 to U+023F.
    """
    low = [_lowered(t) for t in texts]
    raw = [(t if small is None else small).encode() for t, small in zip(texts, low)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    begins = np.cumsum(sizes) - sizes  # each text has a blank before it
    data = np.frombuffer(b" ".join([b"", *raw]).translate(_BLANKS), np.uint8)
    starts = data == 32
    marks = np.flatnonzero(_MARK[data])
    marks = marks[np.append(starts, True)[marks + 1]]
    last, lead = data[marks - 1], data[marks - 2]
    alnum = _ALNUM[last] | ((last >= 128) & (lead >= 0xC3) & (lead <= 0xC8) & ((lead > 0xC3) | ((last != 0x97) & (last != 0xB7))))
    lowered = np.fromiter((small is not None for small in low), bool, len(low))
    marks = marks[alnum & lowered[np.searchsorted(begins, marks, "right") - 1]]
    bare = data[~starts]
    starts[marks] = True
    at = np.flatnonzero(starts)
    blank = data[at] == 32
    ends = np.append(at - np.cumsum(blank) + blank, len(bare))  # counted without blanks
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(bare)])
    return words, np.append(np.searchsorted(at, begins), len(at))


def laid(ids: list[list[int]], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids end to end, and where each begins, counted from ``base``, and how many it has."""
    sizes = np.fromiter(map(len, ids), np.int32, len(ids))
    return np.fromiter(chain.from_iterable(ids), "<u4"), base + np.cumsum(sizes, dtype=np.int64) - sizes, sizes


def hashed(words: pa.Array) -> np.ndarray:
    """64 bits of each word: its bytes' random numbers times powers of an odd number by place, added up."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    if ends[0] == ends[-1]:
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    powers = np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)], out=sums[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


class WordTokenizer:
    """Ids by a ``tokenizers`` file whose pre-tokenizer never crosses white space, so a word's ids can be kept.

    Texts are cut at blanks, tabs and line ends only, and before a closing mark that surely is a piece of its own; any other separator
    stays in its word, for the tokenizer to see. Kept words lie in Arrow and numpy arrays, about 60 bytes each, and are found by sorted
    hashes; their letters are compared, and of words with one hash only the first is kept. Beyond ``keep`` words the half that was met last stays.
    """

    _of: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, keep: int = 250_000, longest: int = 64, short: int = 12):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.known = pa.array([], pa.large_string())
        self.flat, self.begins, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int32)  # the ids of each
        self.met, self.turn = np.empty(0, np.int32), 0
        self.hashes, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)  # ascending, and whose each is
        self.keep, self.longest, self.short = keep, longest, short
        self.marks = {m: self.inner.encode(m, add_special_tokens=False).ids for m in MARKS}
        self.bar = self.inner.encode("|", add_special_tokens=False).ids
        self.steps = self._steps()
        self.model = self.inner.model

    def _steps(self) -> bool:
        """Whether the tokenizer gives a word of small letters to its model in one piece, as ``LETTERS`` says."""
        parts = [json.loads(p.__getstate__()) if p else None for p in (self.inner.normalizer, self.inner.pre_tokenizer)]
        return parts == LETTERS and not any(t.content.isalpha() for t in self.inner.get_added_tokens_decoder().values())

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The one of this process, with the words that earlier tasks met."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as unsigned 32-bit little-endian numbers; texts are looked up together, ``CHARS`` at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= CHARS:
                yield from self._ids(group)
                group, size = [], 0
        if group:
            yield from self._ids(group)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        words, firsts = _cut(texts)
        coded = words.dictionary_encode()
        flat, begins, sizes = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        length = sizes[word]
        at = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        raw = flat[np.repeat(begins[word] - at[:-1], length) + np.arange(at[-1])].tobytes()
        bounds = (4 * at[firsts]).tolist()
        for k in range(len(texts)):
            yield raw[bounds[k] : bounds[k + 1]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct words begin and how many they are."""
        self.turn += 2
        at = self._places(words)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new)).to_pylist()
        stems = [(w, "") if _small(w) else self._stem(w) for w in fresh]
        missing = [w for w, (stem, _) in zip(fresh, stems) if w == stem]
        named = list({stem for w, (stem, _) in zip(fresh, stems) if w != stem}.difference(missing))
        place = self._places(pa.array(named, pa.large_string())).tolist()
        missing += [stem for stem, k in zip(named, place) if k < 0]
        of = dict(zip(missing, self._encoded(missing)))
        of.update((stem, self.flat[self.begins[k] : self.begins[k] + self.sizes[k]].tolist()) for stem, k in zip(named, place) if k >= 0)
        made = [of[stem] + self.marks[mark] if mark else of[stem] for stem, mark in stems]
        begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int32)
        old = at >= 0
        begins[old], sizes[old] = self.begins[at[old]], self.sizes[at[old]]
        more, begins[new], sizes[new] = laid(made, len(self.flat))
        found = np.concatenate([self.flat, more])
        kept = {w: ids for w, (stem, _), ids in zip(fresh, stems, made) if w != stem and len(w) <= self.short}
        kept.update((stem, of[stem]) for stem in missing if len(stem) <= self.longest)
        self._keep(kept)
        return found, begins, sizes

    def _places(self, words: pa.Array) -> np.ndarray:
        """Of each word among those that are kept, -1 for others."""
        if not len(self.known) or not len(words):
            return np.full(len(words), -1)
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= 4 * self.longest)  # bytes; longer words are not kept
        hashes = hashed(words.take(pa.array(short)) if len(short) < len(words) else words)
        rank = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[rank] == hashes)
        number = self.number[rank[maybe]]
        maybe = short[maybe]
        same = pc.equal(words.take(pa.array(maybe)), self.known.take(pa.array(number))).to_numpy(zero_copy_only=False)
        at = np.full(len(words), -1)
        at[maybe[same]] = number[same]
        self.met[number[same]] = self.turn
        return at

    def _keep(self, kept: dict[str, list[int]]) -> None:
        words = pa.array(list(kept), pa.large_string())
        hashes, first = np.unique(hashed(words), return_index=True)
        rank = np.searchsorted(self.hashes, hashes)
        new = np.append(self.hashes, hashes[-1:])[rank] != hashes if len(self.hashes) else np.full(len(hashes), True)
        new |= rank == len(self.hashes)
        hashes, first, rank = hashes[new], first[new], rank[new]
        ids = list(kept.values())
        more, begins, sizes = laid([ids[k] for k in first.tolist()], len(self.flat))
        self.hashes = np.insert(self.hashes, rank, hashes)
        self.number = np.insert(self.number, rank, np.arange(len(self.known), len(self.known) + len(first)))
        self.known = pa.concat_arrays([self.known, words.take(pa.array(first))])
        self.flat = np.concatenate([self.flat, more])
        self.begins, self.sizes = np.concatenate([self.begins, begins]), np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.full(len(first), self.turn - 1, np.int32)])  # a word that was met again stays before new ones
        if len(self.known) > self.keep:
            last = np.sort(np.argsort(self.met, kind="stable")[-(self.keep // 2) :])
            self.known, self.met, sizes = self.known.take(pa.array(last)), self.met[last], self.sizes[last]
            ends = np.cumsum(sizes, dtype=np.int64)
            self.flat = self.flat[np.repeat(self.begins[last] - ends + sizes, sizes) + np.arange(sizes.sum())]
            self.begins, self.sizes = ends - sizes, sizes
            number = np.full(int(self.number.max()) + 1, -1, np.int32)
            number[last] = np.arange(len(last))
            stays = number[self.number] >= 0
            self.hashes, self.number = self.hashes[stays], number[self.number[stays]]

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """By the tokenizer. Words of small letters go to its model at once, others without a bar as one text with bars between: only a bar has a bar's id."""
        done = self._modelled([w for w in words if len(w) <= self.longest and _small(w)]) if self.steps else {}
        plain = [w for w in words if w not in done and "|" not in w and "<" not in w] if len(self.bar) == 1 else []
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.asarray(self.inner.encode_batch_fast([" | ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tolist(), np.flatnonzero(ids == self.bar[0]).tolist()
            if len(cuts) == len(some) - 1:
                done.update(zip(some, (raw[i:j] for i, j in zip([0, *[c + 1 for c in cuts]], [*cuts, len(raw)]))))
        rest = [w for w in words if w not in done]
        done.update((w, e.ids) for w, e in zip(rest, self.inner.encode_batch_fast(rest, add_special_tokens=False)))
        return [done[w] for w in words]

    def _modelled(self, words: list[str]) -> dict[str, list[int]]:
        """By the tokenizer's model, which gets a word's bytes as the letters that stand for them."""
        letters = _BYTE_LETTERS[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")
        tokenize = self.model.tokenize
        return {w: [t.id for t in tokenize(x)] for w, x in zip(words, letters)}

    def _stem(self, word: str) -> tuple[str, str]:
        """The word in lower case and without one closing mark, and that mark, where the tokenizer surely sees it so.

        It lowers letter by letter after composing, and a single mark after a letter or digit is a token run of its own.
        """
        low = _lowered(word)
        if low is None:
            return word, ""
        if len(low) > 1 and low[-1] in self.marks and low[-2].isalnum():
            return low[:-1], low[-1]
        return low, ""


CACHES.append(WordTokenizer._of)


def place(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, open_windows: int) -> Iterator[pa.RecordBatch]:
    """Pieces of one partition; those with window -1 are left over, their offset counting from the partition's first."""
    settle(WordTokenizer._of)
    tokenize = WordTokenizer.of(shipped(path))
    part = TaskContext.get().partitionId()
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "row", "part", "window", "offset"]
    out: list[tuple] = []
    size = 0
    numbered = 0
    row = part * SPAN - 1
    free: list[tuple[int, int]] = []  # (room, window), ascending
    held: dict[int, list[tuple]] = {}

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[] for _ in names]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        out.clear()
        return made

    def emit(pieces: list[tuple], number: int) -> None:
        nonlocal size
        offset = 0
        for piece in pieces:
            out.append((*piece, part, number, offset))
            offset += piece[2]
            size += len(piece[3])

    for rows in slices(batches, 1024):
        texts = [(x or b"").decode("utf-8", "replace") for x in rows.column(1).to_pylist()]
        for doc_id, ids in zip(rows.column(0).to_pylist(), tokenize(texts)):
            ids += end
            row += 1
            total = len(ids) // 4
            start = 0
            while total - start >= window:
                emit([(doc_id, start, window, ids[4 * start : 4 * (start + window)], total, row)], numbered)
                numbered += 1
                start += window
            if rest := total - start:
                piece = (doc_id, start, rest, ids[4 * start :], total, row)
                at = bisect.bisect_left(free, (rest, -1))
                if at < len(free):
                    room, best = free.pop(at)
                else:
                    if len(free) >= open_windows:
                        _, fullest = free.pop(0)
                        emit(held.pop(fullest), fullest)
                    room, best = window, numbered
                    numbered += 1
                    held[best] = []
                held[best].append(piece)
                if room == rest:
                    emit(held.pop(best), best)
                else:
                    bisect.insort(free, (room - rest, best))
            if size > 4_000_000:
                yield batch()
                size = 0
        trim()
    emit([p for _, w in free for p in held[w]], -1)
    yield batch()


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, open_windows: int = 64) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset, row (the same of
    all pieces of a row of ``docs``).

    The placed pieces are written once to the shared folder: a rerun of a lost task could not renumber windows, and
    left-over pieces need the totals of all partitions before theirs.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, row long, part long, window long, offset long"
    name = ship(docs.sparkSession, tokenizer_path)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    placed = materialize(texts.mapInArrow(lambda b: place(b, name, window, end_id, open_windows), schema), "pack")
    done = placed.filter("window >= 0").select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("part") * F.lit(SPAN) + F.col("window")).alias("sequence_id"), "offset", "row")
    rest = placed.filter("window < 0")
    sums = rest.groupBy("part").agg(F.sum("length").alias("left"))  # one row a partition of the input
    sums = sums.select("part", F.coalesce(F.sum("left").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = rest.join(sums, "part").withColumn("at", F.col("base") + F.col("offset"))
    cut = at.withColumn("k", F.explode(F.expr(f"sequence(at div {window}, (at + length - 1) div {window})")))
    cut = cut.withColumn("from", F.greatest(F.col("k") * window, F.col("at"))).withColumn("to", F.least((F.col("k") + 1) * window, F.col("at") + F.col("length")))
    merged = cut.select(
        "doc_id", (F.col("start") + F.col("from") - F.col("at")).alias("start"), (F.col("to") - F.col("from")).alias("length"),
        F.expr("substring(ids, cast(4 * (from - at) + 1 as int), cast(4 * (to - from) as int))").alias("ids"), "doc_tokens",
        (F.col("k") + F.lit(MERGED)).alias("sequence_id"), (F.col("from") - F.col("k") * window).alias("offset"), "row",
    )
    return done.unionByName(merged)


def op2_pack(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
