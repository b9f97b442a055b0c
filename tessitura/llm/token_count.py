"""Token counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, to the node that the
unmatched rest of its string leads to, and the number of tokens popped on the
way there. Reading a word once, character by character, gives the number of
pieces that greedy longest-match-first would cut it into; no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONGEST, raw_texts, shipped

START = "▁"
NONE = -1


class LongestMatch:
    """``pieces``: those that begin a word start with :data:`START`."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                at = self.next[at][c]
            ends[at] = at != 0
        self.fail, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        # A word begins at START's node, a later piece at the root.
        self.first = self.next[0].get(START, NONE)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for c, child in self.next[at].items():
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    back, popped = self.fail[at], self.popped[at]
                    while back != NONE and c not in self.next[back]:
                        popped += self.popped[back]
                        back = self.fail[back]
                    if back != NONE:
                        self.fail[child], self.popped[child] = self.next[back][c], popped
                todo.append(child)

    def count(self, word: str) -> int:
        """Pieces of the word; 1, for the unknown piece, if it can't be cut."""
        at, tokens = self.first, 0
        if at == NONE:
            return 1
        step, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while c not in step[at]:
                if fail[at] == NONE:
                    return 1
                tokens += popped[at]
                at = fail[at]
            at = step[at][c]
        while at > 0:
            if fail[at] == NONE:
                return 1
            tokens += popped[at]
            at = fail[at]
        return tokens


class _Counts(dict):
    """Pieces by word, emptied at ``most`` words."""

    def __init__(self, automaton: LongestMatch, most: int = 200_000) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= LONGEST:
            self[word] = found
        return found


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of ``docs`` (doc_id, text).

    Words are what ASCII white space separates, over whole texts; null and
    empty texts have none. Other columns are ignored; rows may repeat.
    """
    load = shipped(docs.sparkSession, LongestMatch(pieces))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(load())
        for batch in batches:
            words, tokens = [], []
            for text in raw_texts(batch.column(1)):
                of = text.split() if text else []
                words.append(len(of))
                tokens.append(sum(map(counts.__getitem__, of)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
