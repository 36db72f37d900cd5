"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a task go into a trie.  A node's forward score is the best sum of log-probabilities of
pieces that spell the path to it; it depends on the path alone, so it is computed once, when the node is made, and
shared by all pre-tokens with that prefix.  The number of pieces on the best path is kept at each terminal node, and
a document's count is the sum over its pre-tokens.  Nothing is shuffled.

Piece scores are Zipf's: a piece of rank r (its place in the vocabulary file) has log-probability -log(r + 2.7).  A
character without a piece costs one token for each of its UTF-8 bytes, each scored below the last piece.  Of equal
scores, fewer pieces win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks a pre-token's start, as in the vocabulary file.
MARK = "▁"
#: Nodes a task's trie holds before it starts anew.
MAX_NODES = 800_000
SHIFT = 2.7


class Trie:
    """Forward scores by node.  children: (node, code point) packed in one integer -> node."""

    def __init__(self, scores: dict[str, float]):
        # Every ending of a piece, with the score of those that are pieces; scores are below 0.
        self.tails: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))}
        self.tails.update(scores)
        self.byte = min(scores.values(), default=0.0) - 1.0
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a pre-token."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(self.best) > MAX_NODES:
            self.clear()
        marked = MARK + word
        if len(marked) > 10_000:
            return self._walk(marked, keep=False)
        self.terminal[word] = n = self._walk(marked, keep=True)
        return n

    def _walk(self, marked: str, keep: bool) -> int:
        """Follow the trie as far as it reaches, then add nodes; a very long pre-token leaves none behind.

        A new node takes the best of the pieces that end there, found by growing the suffix while any piece ends in it.
        """
        children, best, pieces, get = self.children, self.best, self.pieces, self.tails.get
        n, node, j, scores, counts = len(marked), 0, 0, [0.0], [0]
        while j < n:
            child = children.get(node << 21 | ord(marked[j]))
            if child is None:
                break
            node = child
            scores.append(best[node])
            counts.append(pieces[node])
            j += 1
        while j < n:
            j += 1
            top, least, alone, i = -math.inf, 0, None, j
            while i:
                i -= 1
                p = get(marked[i:j], 0)
                if p == 0:
                    break
                if p is not None:
                    if i == j - 1:
                        alone = p
                    s, k = scores[i] + p, counts[i] + 1
                    if s > top or s == top and k < least:
                        top, least = s, k
            if alone is None:  # no piece of its own: its bytes
                size = len(marked[j - 1].encode())
                s, k = scores[j - 1] + size * self.byte, counts[j - 1] + size
                if s > top or s == top and k < least:
                    top, least = s, k
            scores.append(top)
            counts.append(least)
            if keep:
                children[node << 21 | ord(marked[j - 1])] = node = len(best)
                best.append(top)
                pieces.append(least)
        return counts[n]


def load_scores(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece vocabulary with their log-probabilities; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + SHIFT) for rank, i in enumerate(kept)}


def token_counts(df: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row.

    Pre-tokens are the runs without white space, which is what Unicode calls so (``str.split``).  Null and empty texts,
    and such of white space alone, count 0; repeated rows each give a row; very long texts count whole, and very long
    pre-tokens leave no nodes behind; an empty table gives no rows; further columns are dropped.
    """
    shared = df.sparkSession.sparkContext.broadcast(scores)  # a vocabulary file: a bound of a few MB

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in stream:
            values, words, tokens = batch.column(1), [], []
            distinct: set[str] = set()
            for i in range(len(values)):
                distinct.update((values[i].as_py() or "").split())
            counts = {w: trie.count(w) for w in sorted(distinct)}  # in order, neighbours share their way through the trie
            for i in range(len(values)):
                parts = (values[i].as_py() or "").split()
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint")
