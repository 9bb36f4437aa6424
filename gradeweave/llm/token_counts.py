"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A text's distinct pre-tokens (its words, each marked as a word's start) go into
a trie. The forward step of the unigram model, the best score and the token
count of a prefix, is done once for each node, so words share it for the
prefix they share. A terminal's count is stored, and a document's count is the
sum over its words.

A Python worker holds its own trie and starts it anew at ``NODES`` nodes, which
bounds memory and changes no result. Spark keeps more workers than cores when
tasks are short, so a trie may take some 60 MB only. Nothing is shuffled.

Scores follow Zipf's law over the vocabulary's order, as whole millionths, so
ties are exact; equal scores take fewer tokens. A character outside the
vocabulary costs its UTF-8 bytes, each ``BYTE_PENALTY`` below the last piece.

Defined results: null and empty texts have 0 words and tokens; repeated rows count each; extra columns are dropped.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NODES, WORDS = 200_000, 100_000
COUNT_BITS = 32
COUNT_MASK = (1 << COUNT_BITS) - 1
#: Longer words are counted by the same recurrence outside the trie.
TRIE_WORD = 48
BYTE_PENALTY = 2_000_000
COUNT_TYPE = "struct<n_words:bigint,n_tokens:bigint>"


@lru_cache(maxsize=2)
def unigram_scores(model_file: str) -> dict[str, int]:
    """Log-probability in millionths of every piece of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {piece: round(1e6 * (-math.log(rank + 1) - total)) for rank, piece in enumerate(pieces)}


class ForwardTrie(dict):
    """Word to token count; a missing word is inserted into the trie and scored there.

    A node holds one number, its best score above and its token count, taken
    off, below: the larger number is the better score, or as good with fewer tokens.
    """

    def __init__(self, scores: dict[str, int]):
        super().__init__()
        # All endings of pieces, 0 for those that are none: an unknown ending says that no longer piece fits.
        self.endings = {piece[k:]: 0 for piece in scores for k in range(len(piece))}
        self.endings |= {piece: (score << COUNT_BITS) - 1 for piece, score in scores.items()}
        self.byte_step = ((min(scores.values(), default=0) - BYTE_PENALTY) << COUNT_BITS) - 1
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.value = [0]

    def forward(self, word: str, end: int, values: list[int]) -> int:
        """Value of word[:end], given those of its shorter prefixes."""
        ending, best = self.endings.get, None
        for begin in range(end - 1, -1, -1):
            step = ending(word[begin:end])
            if step is None:
                break
            if step and (best is None or values[begin] + step > best):
                best = values[begin] + step
        if not self.endings.get(word[end - 1]):
            spelt = values[end - 1] + len(word[end - 1].encode()) * self.byte_step
            best = spelt if best is None or spelt > best else best
        return best

    def __missing__(self, word: str) -> int:
        marked, values = MARK + word, [0]
        if len(marked) > TRIE_WORD:
            for end in range(1, len(marked) + 1):
                values.append(self.forward(marked, end, values))
            return -values[-1] & COUNT_MASK
        if len(self.value) > NODES or len(self) > WORDS:
            self.restart()
        child, value, node = self.child, self.value, 0
        for end, letter in enumerate(marked, 1):
            key = node << 21 | ord(letter)
            node = child.get(key)
            if node is None:
                node = child[key] = len(value)
                value.append(self.forward(marked, end, values))
            values.append(value[node])
        count = self[word] = -values[-1] & COUNT_MASK
        return count


@lru_cache(maxsize=1)
def _trie(model_file: str) -> ForwardTrie:
    return ForwardTrie(unigram_scores(model_file))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every document; words are what white space (as Unicode has it) separates."""

    @F.arrow_udf(COUNT_TYPE)
    def count(texts: pa.Array) -> pa.Array:
        trie = _trie(model_file)
        n_words, n_tokens = [], []
        for text in texts:
            found = (text.as_py() or "").split()
            n_words.append(len(found))
            n_tokens.append(sum(map(trie.__getitem__, found)))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["n_words", "n_tokens"])

    return docs.select("doc_id", count("text").alias("counted")).select("doc_id", "counted.*")
