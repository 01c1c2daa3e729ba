"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled documents (``per_language`` of
each language), on windows of their whole texts: a batch draws a document of each language, then one of its windows. It labels every
byte position of every whole text; a document's probabilities are the mean over its positions. Texts are run in windows of ``core`` bytes, with ``edge``
bytes of the neighbouring windows on each side to warm the state up, so that a long text costs no more per byte than a short one
and no memory beyond a block of windows.

Rows and nulls: a text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn
from. Rows without a doc_id are predicted, never learned from, and not held out. Repeated rows get the same prediction. Every
label of the table is learned. Other columns are ignored by ``identify`` and kept by ``label``, whose own column must not be among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, table

PAD = 256


@dataclass
class ByteGRU:
    """Two directions of gated recurrent units over bytes, and a softmax over languages at each position.

    Bytes enter by a table of gate inputs, one row a byte value; the reset gate acts on the recurrent part of the candidate.
    """

    languages: list[str]
    hidden: int = 8
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng, h, k = np.random.default_rng(self.seed), self.hidden, len(self.languages)
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.3, (257, 3 * h))
            self.p[f"U{d}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            self.p[f"c{d}"] = np.zeros(h)
        self.p["V"], self.p["v"] = rng.normal(0, 0.3, (2 * h, k)), np.zeros(k)
        self.p = {n: x.astype(np.float32) for n, x in self.p.items()}

    def run(self, x: np.ndarray, d: str, keep: bool = False):
        """States (time, batch, hidden) in reading order of ``d``; with ``keep`` what the way back needs."""
        h, n = self.hidden, x.shape[1]
        E, U, c = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        state = np.zeros((n, h), np.float32)
        out = np.empty((len(x), n, h), np.float32)
        kept = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates, part = E[x[t]], state @ U
            rz = gates[:, : 2 * h]
            rz += part[:, : 2 * h]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            s = part[:, 2 * h :]
            s += c
            r, z = rz[:, :h], rz[:, h:]
            cand = np.tanh(gates[:, 2 * h :] + r * s)
            new = cand + z * (state - cand)
            if keep:
                kept.append((t, state, r, z, s, cand))
            out[t] = state = new
        return (out, kept) if keep else out

    def states(self, x: np.ndarray, d: str, lo: int, hi: int) -> np.ndarray:
        """As ``run`` for positions lo to hi only, laid out (time, hidden, batch) and without temporaries."""
        h, n, steps = self.hidden, x.shape[1], len(x)
        E, U, c = (np.ascontiguousarray(self.p[k + d].T) for k in "EUc")
        state, out = np.zeros((h, n), np.float32), np.empty((hi - lo, h, n), np.float32)
        gates, part = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        rz, r, z, cand, s = gates[: 2 * h], gates[:h], gates[h : 2 * h], gates[2 * h :], part[2 * h :]
        for t in range(hi) if d == "f" else range(steps - 1, lo - 1, -1):
            np.take(E, x[t], axis=1, out=gates, mode="clip")
            np.matmul(U, state, out=part)
            rz += part[: 2 * h]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            s += c[:, None]
            s *= r
            cand += s
            np.tanh(cand, out=cand)
            state -= cand
            state *= z
            state += cand
            if lo <= t < hi:
                out[t - lo] = state
        return out

    def probabilities(self, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Of each language at positions lo to hi: (hi - lo, languages, batch)."""
        h = self.hidden
        logits = self.p["V"][:h].T @ self.states(x, "f", lo, hi)
        logits += self.p["V"][h:].T @ self.states(x, "b", lo, hi)
        logits += self.p["v"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h = self.hidden
        (hf, kf), (hb, kb) = self.run(x, "f", True), self.run(x, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        logits = both @ self.p["V"] + self.p["v"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        total = max(1, valid.sum())
        cols = np.arange(x.shape[1])
        loss = -(np.log(prob[:, cols, y] + 1e-9) * valid).sum() / total
        prob[:, cols, y] -= 1
        prob *= (valid / total)[:, :, None]
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        k = prob.shape[2]
        g["V"] = both.reshape(-1, 2 * h).T @ prob.reshape(-1, k)
        g["v"] = prob.sum((0, 1))
        back = prob @ self.p["V"].T
        for d, kept, dh_at in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            U, carry = self.p[f"U{d}"], np.zeros((x.shape[1], h), np.float32)
            gates = np.empty((*x.shape, 3 * h), np.float32)
            for t, prev, r, z, s, cand in reversed(kept):
                dh = dh_at[t] + carry
                da = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (prev - cand) * z * (1 - z)
                dr = da * s * r * (1 - r)
                gates[t] = np.concatenate([dr, dz, da], axis=1)
                rec = np.concatenate([dr, dz, da * r], axis=1)
                carry = dh * z + rec @ U.T
                g[f"U{d}"] += prev.T @ rec
                g[f"c{d}"] += rec[:, 2 * h :].sum(0)
            np.add.at(g[f"E{d}"], x.reshape(-1), gates.reshape(-1, 3 * h))
        return float(loss), g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 240, batch: int = 192, length: int = 64, rate: float = 0.02) -> ByteGRU:
        """Adam on random batches with as many documents of each language, a window of ``length`` bytes of each."""
        rng = np.random.default_rng(self.seed)
        windows = np.array([max(1, -(-len(t) // length)) for t in texts])
        first = np.cumsum(windows) - windows
        every = np.full((int(windows.sum()), length), PAD, np.int16)
        for text, at, n in zip(texts, first, windows):
            every[at : at + n].reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        s = {n: np.zeros_like(v) for n, v in self.p.items()}
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(o, -(-batch // len(of))) for o in of if len(o)])
            at_window = first[at] + rng.integers(0, windows[at])
            xs = np.ascontiguousarray(every[at_window].T.astype(np.int64))
            _, g = self.gradients(xs, labels[at], (xs != PAD).astype(np.float32))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            slow = rate * min(1, (steps - step + 1) / (0.5 * steps))
            for n, v in g.items():
                v *= min(1, 1 / (norm + 1e-9))
                m[n] += 0.1 * (v - m[n])
                s[n] += 0.01 * (v * v - s[n])
                self.p[n] -= slow * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.99**step)) + 1e-8)
        return self

    def document_probabilities(self, texts: list[bytes], core: int = 112, edge: int = 8, block: int = 2048) -> np.ndarray:
        """Mean over all byte positions of each text; zeros for an empty one."""
        sums = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []
        waiting = 0

        def flush() -> None:
            x = np.ascontiguousarray(np.concatenate([w for _, w in held]).T)
            doc = np.repeat([i for i, _ in held], [len(w) for _, w in held])
            prob = self.probabilities(x, edge, edge + core)
            prob *= (x[edge : edge + core] != PAD)[:, None, :]
            np.add.at(sums, doc, prob.sum(axis=0, dtype=np.float64).T)
            held.clear()

        for i, text in enumerate(texts):
            for start in range(0, len(text), core * block):
                lead = min(edge, start)
                part = np.frombuffer(text[start - lead : start + core * block + edge], np.uint8)
                windows = -(-min(len(text) - start, core * block) // core)
                line = np.full(edge + windows * core + edge, PAD, np.int64)
                take = part[: len(line) - edge + lead]
                line[edge - lead : edge - lead + len(take)] = take
                view = np.lib.stride_tricks.sliding_window_view(line, core + 2 * edge)[::core][:windows]
                held.append((i, view))
                waiting += windows
                if waiting >= block:
                    flush()
                    waiting = 0
        if held:
            flush()
        length = np.array([[len(t)] for t in texts])
        return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)


def train(docs: DataFrame, per_language: int = 400, hidden: int = 8, **fit) -> ByteGRU | None:
    """Learn from the documents with a non-null lang whose crc32(doc_id as text) mod 3 is not 1: of each of their languages about
    ``per_language`` documents, drawn by a hash of the id, with their whole texts."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row a language
    if not counts:
        return None
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 32) / F.lit(2**32)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    rows = own.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64(F.lit("order"), "doc_id").alias("o"))
    sample = rows.limit(2 * per_language * len(counts)).collect()  # about half as many rows, bounded by the parameter
    sample.sort(key=lambda r: (r["o"], r["lang"], bytes(r["text"])))  # whatever the order they came in
    names = sorted(r["lang"] for r in counts)
    at = {name: k for k, name in enumerate(names)}
    return ByteGRU(names, hidden).fit([bytes(r["text"]) for r in sample], np.array([at[r["lang"]] for r in sample], np.int64), **fit)


def label(docs: DataFrame, model: ByteGRU | None, into: str = "language") -> DataFrame:
    """``docs`` with a struct of lang_pred and score; nothing but the text goes in."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into!r}: name the result otherwise")
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return docs.withColumn(into, und)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        settle()
        for texts in batches:
            prob = model.document_probabilities([t or b"" for t in texts])
            best = prob.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": [model.languages[b] for b in best], "score": np.minimum(prob.max(axis=1), 1.0)})

    lettered = F.when(has_letter, F.col("text").cast("binary"))
    return docs.withColumn(into, judge.asNondeterministic()(lettered)).withColumn(into, F.when(has_letter, F.col(into)).otherwise(und))


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    out = label(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


def op7_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
