"""Token counts of a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton over the vocabulary gives all pieces that end at a character, longest
first; dynamic programming carries the best score and its piece count.  A later,
shorter piece wins only by a strictly better score, which is the rule of the forward lattice in
unigram tokenizers, where the piece that starts first is tried first.  A character that no piece of one
character covers costs a fixed penalty below the least score; runs of such characters fuse and fall
back to their UTF-8 bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers, by number and by length; others are counted anew.
MEMO_WORDS = 1 << 18
MEMO_CHARS = 64

Vocabulary = list[tuple[str, float]]


def load_vocabulary(path: str) -> tuple[Vocabulary, bool]:
    """Pieces with scores of a sentencepiece model file, and whether it falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(map(model.is_byte, ids))


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, vocabulary: Vocabulary, bytes_: bool) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes_ = bytes_
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one pre-token."""
        found = self.memo.get(word)
        if found is None:
            found = self._best(word)
            if len(word) <= MEMO_CHARS and len(self.memo) < MEMO_WORDS:
                self.memo[word] = found
        return found

    def _best(self, word: str) -> int:
        size = len(word)
        score = [-math.inf] * (size + 1)
        count = [0] * (size + 1)
        fused = [False] * (size + 1)  # the best path to here ends in unknown characters
        score[0] = 0.0
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())  # an empty vocabulary: all is unknown
        ending, pieces = next(matches, (size, None))
        for at in range(size):
            end = at + 1
            best, pick, unknown = -math.inf, 0, False
            alone = word[at] in self.single
            while ending == at:
                length, value = pieces
                if (total := score[end - length] + value) > best:
                    best, pick, unknown = total, count[end - length] + 1, False
                ending, pieces = next(matches, (size, None))
            if not alone and (total := score[at] + self.unknown) > best:
                cost = len(word[at].encode()) if self.bytes_ else int(not fused[at])
                best, pick, unknown = total, count[at] + cost, True
            score[end], count[end], fused[end] = best, pick, unknown
        return count[size]

    def text(self, text: str) -> int:
        """Pieces of a text: a mark stands for each space and goes before the text; each mark begins a pre-token."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:  # a text that begins with a space gets no further mark
            del words[0]
        word = self.word
        return sum([word(MARK + w) for w in words])


def token_counts(docs: DataFrame, vocabulary: Vocabulary, bytes_: bool, column: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row of docs.

    Null and empty texts have no tokens.  doc_id may be null or repeat; rows are counted each by itself.
    The vocabulary, of bounded size, goes to the executors with the task.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, bytes_))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in slices(batches):
            counts = [counter.text(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, type=pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")
