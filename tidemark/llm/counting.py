"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the pieces that occur in a text; a dynamic programme over their ends carries the
best score, the number of pieces of the best segmentation, and nothing else. The rules are those of the sentencepiece
library's unigram model: a space counts as the piece character U+2581 and one is put in front; of segmentations of
equal score the one whose last piece begins first wins at every position; a character that is no piece by itself may
be read as unknown at the least score less ten, and counts as its UTF-8 bytes.

No piece holds a space mark after another character (``Vocabulary`` refuses a file where one does), so a text falls apart
before each run of marks into words that are counted for themselves; words seen are remembered, in a memory of bounded
size. Scores are summed exactly. The counts equal the first path of the library's lattice search (``nbest_encode``) as long
as the library's sums, in single precision over a whole text, are exact; its quick ``encode`` departs from that path
for a few words of this vocabulary ("the" becomes one piece of score -13, where two pieces score -8).

Null texts count as empty, with no tokens. Ties follow the rule above; repeated rows are counted alike.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, LONGEST = 300_000, 40
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary(dict):
    """word -> (tokens, bytes of unknown characters), filled as words are met."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        bad = [p for p in pieces if MARK in p.lstrip(MARK)]
        if bad:
            raise ValueError(f"a piece has a space inside: {bad[0]!r}")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY

    def segment(self, word: str) -> tuple[int, int]:
        size = len(word)
        if self.single.issuperset(word):
            # every character is a piece, so every position is reached and nothing is unknown; longest matches come first
            top, pieces = [0.0] + [float("-inf")] * size, [0] * (size + 1)
            for end, (length, value) in self.automaton.iter(word):
                start = end + 1 - length
                if top[start] + value > top[end + 1]:
                    top[end + 1], pieces[end + 1] = top[start] + value, pieces[start] + 1
            return pieces[size], 0
        score, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        done = 0
        lowest = float("-inf")
        found = (lowest, 0, 0)

        def settle(upto: int, found: tuple[float, int, int]) -> None:
            """Close the positions before ``upto``: the next one with what was found, the rest by unknown characters."""
            nonlocal done
            while done < upto:
                done += 1
                c = word[done - 1]
                best = found if found[0] > lowest else (lowest, 0, 0)
                if c not in self.single:
                    n = len(c.encode("utf-8", "surrogatepass"))
                    other = score[done - 1] + self.unknown
                    if other > best[0]:
                        best = (other, count[done - 1] + n, unknown[done - 1] + n)
                score[done], count[done], unknown[done] = best
                found = (lowest, 0, 0)

        for end, (length, value) in self.automaton.iter(word):
            if end > done:
                settle(done + 1, found)
                if end > done:
                    settle(end, (lowest, 0, 0))
                found = (lowest, 0, 0)
            start = end + 1 - length
            total = score[start] + value
            if total > found[0]:
                found = (total, count[start] + 1, unknown[start])
        if done < size:
            settle(done + 1, found)
            settle(size, (lowest, 0, 0))
        return count[size], unknown[size]

    def __missing__(self, word: str) -> tuple[int, int]:
        counted = self.segment(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = counted
        return counted

    def count(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        marked = (MARK + text).replace(" ", MARK)
        n = unknown = 0
        for word in _CHUNK.findall(marked):
            a, b = self[word]
            n += a
            unknown += b
        return n, unknown


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]
    return Vocabulary({model.id_to_piece(k): model.get_score(k) for k in ids})


def token_counts(text: str | Column, model_file: str) -> Column:
    """Struct column (n_tokens, n_unknown_bytes) of a text column."""

    @F.arrow_udf("struct<n_tokens bigint, n_unknown_bytes bigint>")
    def counts(texts: pa.Array) -> pa.Array:
        words = vocabulary(model_file)
        found = [words.count(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["n_tokens", "n_unknown_bytes"])

    return counts(text_or_empty(text))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown_bytes of every whole text of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counted = docs.select("doc_id", token_counts("text", public_tokenizers.path("piece_bpe_32k.model")).alias("c"))
    return counted.select("doc_id", "c.n_tokens", "c.n_unknown_bytes")
