"""Token counts without tokens: Viterbi over a unigram vocabulary that carries best score and piece count only.

An Aho-Corasick automaton finds every vocabulary piece that ends at a character. The best way to each position is a score and a
count; a way replaces the kept one only if its score is greater, and pieces that end at one place come longest first, which is
the tokenizer's tie rule. A character that no one-character piece covers may be taken as unknown, at the least score less 10, and counts
its UTF-8 bytes where the vocabulary has byte pieces. Scores add up in double precision.

White space becomes the vocabulary's mark, and one mark goes before the text. As no piece holds a mark after another
character (checked on loading), the best way of a text is those of its words laid end to end, so a word met before is looked up.

Rows and nulls: a null text counts null tokens, an empty one 0. Repeated rows count alike. A very long text costs in proportion: the memory of a
count is that of its longest word. An empty table gives an empty table. Other columns stay; one named as the result is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ship, shipped, table

MARK = "▁"


class CountViterbi:
    _of: dict[str, CountViterbi] = {}

    def __init__(self, pieces: dict[str, float], bytes_count: bool, keep: int = 1_000_000, longest: int = 64):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - 10.0
        self.bytes_count = bytes_count
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.keep, self.longest = keep, longest

    @classmethod
    def of(cls, path: str) -> CountViterbi:
        """The one of this process for a ``sentencepiece`` model file, its pieces read as a unigram vocabulary."""
        if path not in cls._of:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
            cls._of[path] = cls({sp.id_to_piece(i): sp.get_score(i) for i in plain}, any(map(sp.is_byte, range(sp.vocab_size()))))
        return cls._of[path]

    def best(self, marked: str) -> tuple[int, float]:
        """Pieces and score of the best way through a text whose white space is marked."""
        n = len(marked)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        at = 0  # positions up to here are final

        def close(upto: int) -> None:
            """Take characters that no one-character piece covers as unknown."""
            nonlocal at
            while at < upto:
                if not single[at]:
                    other = score[at] + self.unknown
                    if score[at + 1] is None or other > score[at + 1]:
                        score[at + 1] = other
                        count[at + 1] = count[at] + (len(marked[at].encode("utf-8", "surrogatepass")) if self.bytes_count else 1)
                at += 1

        single = bytearray(n)
        for last, (length, value) in self.automaton.iter(marked):
            close(last)
            end = last + 1
            if length == 1:
                single[last] = 1
            start = end - length
            new = score[start] + value
            if score[end] is None or new > score[end]:
                score[end], count[end] = new, count[start] + 1
        close(n)
        return count[n], score[n]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.by_word:
            return self.best(MARK + text.replace(" ", MARK))
        words = text.replace(MARK, " ").split(" ")
        # a run of blanks belongs to the word after it
        if "" in words:
            joined, run = [], 0
            for w in words[:-1]:
                if w:
                    joined.append(" " * run + w)
                    run = 0
                else:
                    run += 1
            words = [*joined, " " * run + words[-1]]
        known = self.counts
        if new := set(words).difference(known):
            if len(known) > self.keep:
                known.clear()
                self.scores.clear()
                new = set(words)
            for w in new:
                known[w], self.scores[w] = self.best(MARK + w.replace(" ", MARK))
        result = sum(map(known.__getitem__, words)), sum(map(self.scores.__getitem__, words))
        for w in new:
            if len(w) > self.longest:
                del known[w], self.scores[w]
        return result


def count_tokens(docs: DataFrame, model_path: str, into: str = "token_count") -> DataFrame:
    """``docs`` with a struct of tokens and score."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into!r}: name the result otherwise")
    name = ship(docs.sparkSession, model_path)

    @F.pandas_udf("tokens long, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = CountViterbi.of(shipped(name))
        for texts in batches:
            made = [(None, None) if t is None else count(t.decode("utf-8", "replace")) for t in texts]
            yield pd.DataFrame({"tokens": pd.array([m[0] for m in made], "Int64"), "score": pd.array([m[1] for m in made], "Float64")})

    return docs.withColumn(into, judge(F.col("text").cast("binary")))


def op9_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "token_count.tokens", "token_count.score")
