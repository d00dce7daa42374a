"""Token counts by trie-shared dynamic programming.

A unigram model cuts a pre-token (a word with its word mark) into the pieces
whose scores add up to the most.  The best score of a prefix does not depend on
what follows, so the distinct pre-tokens of a worker are inserted in one trie
and each node's forward score is worked out once, from its ancestors, whatever
the number of words below it.  The node that ends a pre-token keeps the count.

The public piece vocabulary carries merge ranks; a piece of rank r gets the
Zipf log-probability ``-log(r + 2)``.  A character outside the vocabulary costs
one byte piece for each UTF-8 byte.  Ties go to fewer pieces.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import with_columns_of

#: Nodes of a worker's trie; a full trie is dropped and grown anew (no result changes).
TRIE_NODES = 400_000
WORD_MARK = "▁"
#: Log-probability of a byte piece.
BYTE_SCORE = -math.log(1e6)

FIELDS = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]

_tries: dict[str, PrefixTrie] = {}


def piece_scores(path: str) -> dict[str, float]:
    """Scores of the visible pieces of a sentencepiece file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            found[model.id_to_piece(i)] = -math.log(i + 2.0)
    return found


class PrefixTrie:
    """Forward scores of all prefixes seen, and the token counts of whole pre-tokens."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        #: Sizes of the pieces of three characters or more, by their last three.
        self.sizes: dict[str, list[int]] = {}
        for size, end in sorted({(len(p), p[-3:]) for p in scores if len(p) > 2}):
            self.sizes.setdefault(end, []).append(size)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The number of pieces of ``word``; new nodes get their scores on the way."""
        child, best, count, scores, sizes = self.child, self.best, self.count, self.scores, self.sizes
        path, node = [0], 0
        for end, char in enumerate(word, 1):
            key = (node, char)
            node = child.get(key, -1)
            if node < 0:
                own = scores.get(char)
                extra = 1
                if own is None:
                    extra = len(char.encode("utf-8", "surrogatepass"))
                    own = BYTE_SCORE * extra
                before = path[end - 1]
                top, pieces = best[before] + own, count[before] + extra
                for size in (2, *sizes.get(word[end - 3 : end], ())) if end > 2 else (2,):
                    if size > end:
                        break
                    own = scores.get(word[end - size : end])
                    if own is not None:
                        before = path[end - size]
                        total, n = best[before] + own, count[before] + 1
                        if total > top or total == top and n < pieces:
                            top, pieces = total, n
                node = len(best)
                child[key] = node
                best.append(top)
                count.append(pieces)
            path.append(node)
        self.terminal[word] = count[node]
        return count[node]

    def counts(self, words: list[str]) -> dict[str, int]:
        """Counts of distinct words, inserted in sorted order: a depth-first walk."""
        if len(self.best) > TRIE_NODES:
            self.clear()
        known = self.terminal
        return {w: known[w] if w in known else self.insert(w) for w in sorted(words)}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_pretokens`` and ``n_tokens``.

    Pre-tokens are runs of non-space characters, each behind a word mark; a
    newline is a pre-token of one byte piece.  No shuffle: the trie is a
    worker's own and bounded.  Null or empty texts count 0; an empty table gives
    an empty result.
    """

    def make():
        if vocabulary not in _tries:
            _tries[vocabulary] = PrefixTrie(piece_scores(vocabulary))
        trie = _tries[vocabulary]

        def work(texts: list[str]) -> list[pa.Array]:
            words = [Counter(t.split()) for t in texts]
            cost = trie.counts([WORD_MARK + w for w in set().union(*words)])
            lines = [t.count("\n") for t in texts]
            n_pre = np.array([c.total() for c in words], np.int64) + lines
            n_tok = np.array([sum(cost[WORD_MARK + w] * k for w, k in c.items()) for c in words], np.int64) + lines
            return [pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())]

        return work

    return with_columns_of(docs, text_col, FIELDS, make, [id_col])
