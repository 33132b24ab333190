"""Operator 2, token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each
character; a Viterbi pass keeps, per place, the best score and the number of
pieces behind it. Ties follow the tokenizer: the automaton lists the pieces of one end
from the longest to the shortest, and only a strictly better one replaces the best.

Scores are whole multiples of 2**-16, so sums are exact and the best path of a
text is the join of the best paths between its hard boundaries: places that no
piece of the vocabulary spans. Counts of chunks between boundaries are kept in a
bounded cache, as most words are met again and again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = 1 << 16
UNKNOWN_PENALTY = 10 * UNIT
SPACE = "▁"
NEVER = -(1 << 62)
CACHE = 300_000   # chunks; the cache is emptied when it is full


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with whole scores; characters outside fall back to their bytes."""
    pieces: tuple[tuple[str, int], ...]

    @property
    def unknown(self) -> int:
        return min(s for _, s in self.pieces) - UNKNOWN_PENALTY


def load_vocabulary(path: str = VOCABULARY, scores: str = "zipf") -> Vocabulary:
    """Read the pieces of a model file with byte pieces, on the driver.

    ``scores="file"`` takes the scores of the file; ``"zipf"`` gives the piece of
    rank r (from 1, in the order of the file) the log of r**-1, for files whose
    scores are ranks and no log-probabilities.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if not any(sp.is_byte(i) for i in range(sp.get_piece_size())):
        raise ValueError(f"{path} has no byte pieces")
    ids = [i for i in range(sp.get_piece_size())
           if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    of = (lambda r, i: sp.get_score(i)) if scores == "file" else (lambda r, i: -math.log(r))
    return Vocabulary(tuple((sp.id_to_piece(i), round(of(r, i) * UNIT)) for r, i in enumerate(ids, 1)))


class Counting:
    """Counts pieces of texts; built once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.unknown
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        alphabet = set("".join(p for p, _ in vocabulary.pieces))
        line = "" if "\n" in alphabet else "\n"
        # no piece has a blank after another character: each blank run starts a chunk
        splits = not any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary.pieces)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + "|\n" * bool(line)) if splits else re.compile("(?s).+")
        self.cache: dict[str, int] = {}

    def viterbi(self, chunk: str) -> int:
        """Pieces on the best path over one chunk."""
        n = len(chunk)
        best, count = [NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0
        if self.single.issuperset(chunk):  # pieces alone reach every place
            for end, (length, score) in self.automaton.iter(chunk):
                start = end + 1 - length
                if (score := score + best[start]) > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[start] + 1
            return count[n]
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(chunk):
            ends[end].append((length, score))
        for end, c in enumerate(chunk):
            for length, score in ends[end]:
                if (score := score + best[end + 1 - length]) > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[end + 1 - length] + 1
            if c not in self.single and (score := best[end] + self.unknown) > best[end + 1]:
                best[end + 1], count[end + 1] = score, count[end] + len(c.encode("utf-8", "surrogatepass"))
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for chunk, times in Counter(self.chunks.findall(SPACE + text.replace(" ", SPACE))).items():
            n = self.cache.get(chunk)
            if n is None:
                n = self.viterbi(chunk)
                if len(chunk) <= 64:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    self.cache[chunk] = n
            total += n * times
        return total


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Number of tokens of a text column, in Arrow batches."""
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = Counting(vocabulary)
        for s in batches:
            yield pd.Series([count(t) for t in s], dtype="int64")
    return counted(text)


def count_tokens(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``, the tokens of each whole text; 0 for null and empty ones.

    Every row is counted by itself, without a shuffle; repeated rows and other
    columns stay as they are.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    return df.withColumn(out, token_count(F.col(f"`{text}`"), vocabulary))


def op2_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Token count of every row of ``documents``, with its characters."""
    d = count_tokens(docs.select("doc_id", "text"), load_vocabulary(path))
    return d.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "n_tokens")
