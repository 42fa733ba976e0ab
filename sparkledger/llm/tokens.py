"""Token counts of a unigram vocabulary: Viterbi that carries only score and count.

A public vocabulary file is read as it is: its pieces with their scores, taken as
unigram scores. Aho-Corasick finds every piece that ends at each place; dynamic
programming keeps, for each place, the best score and its number of pieces.

Tie rules are those of the public unigram tokenizers: of the segmentations that
reach a place, the one with the higher score stays, and among equal scores the one
whose last piece starts first. A character that is no piece costs the lowest score
less 10 and counts as its UTF-8 bytes, each a token. Spaces become U+2581, one of
them is put before the text, no other character changes. Scores are added in doubles.

No piece of such a vocabulary goes on past the start of a next word (this is checked),
so words are counted one by one, and each distinct word of a task once. A null text,
like an empty one, has no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pieces

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a task remembers; when full it forgets them all and goes on.
REMEMBERED = 400_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class UnigramCounter:
    """Counts the pieces of texts under one vocabulary."""

    def __init__(self, pieces_: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces_:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} runs over the start of a word")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces_), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> UnigramCounter:
        """Pieces that can match text: not the unknown, control, byte and unused ones."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in usable])

    def segment(self, word: str) -> int:
        """Number of pieces of the best segmentation of ``word``."""
        n = len(word)
        score, count, single = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ends[last + 1].append(match)
        for end in range(1, n + 1):
            best, pieces_ = None, 0
            matches = sorted(ends[end], reverse=True)  # the longest, so the first to start, comes first
            if not matches or matches[-1][0] > 1:
                matches.append((0, self.unknown))
            for length, value in matches:
                start = end - (length or 1)
                total = score[start] + value
                if best is None or total > best:
                    best = total
                    pieces_ = count[start] + (1 if length else len(word[start:end].encode("utf-8", "surrogatepass")))
            score[end], count[end] = best, pieces_
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, seen = 0, self.seen
        for word in _WORD.findall(SPACE + text.replace(" ", SPACE)):
            n = seen.get(word)
            if n is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                n = seen[word] = self.segment(word)
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(name: str) -> UnigramCounter:
    """One counter for each Python worker, from the file that Spark has sent."""
    return UnigramCounter.load(SparkFiles.get(name))


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``; ``vocabulary`` is a path of a sentencepiece file on the driver."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for batch in pieces(batches):
            yield pa.record_batch([batch.column(0), pa.array([counter.count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")
