"""Token counts under a unigram model, with one dynamic program over a trie of the distinct pre-tokens.

The model gives the vocabulary's token of rank r the probability proportional to 1 / (r + SHIFT) (Zipf's law with
Mandelbrot's shift), since rank files carry an order only. A pre-token's count is the number of tokens of its most
probable segmentation, and the smallest such number among equally probable ones. Scores are integers (micro-nats), so
ties are exact. Any text can be segmented as all single bytes are in the vocabulary.

Distinct pre-tokens are inserted into a trie by bytes; the forward scores of a node depend on its path alone, so they
are computed once for each shared prefix. Terminal nodes store the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import pretokens
from recordloom.llm.common import small_batches

#: Shift of the model, and the score of a nat.
SHIFT, UNIT = 2.7, 1_000_000
#: Characters of text whose pre-tokens share a trie, or an Arrow batch's more.
BLOCK_CHARS = 32 << 20


def costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Negative log-probability of each token in micro-nats."""
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {token: round(UNIT * (math.log(r + SHIFT) + total)) for token, r in ranks.items()}


def trie_counts(words: Iterable[bytes], cost: dict[bytes, int]) -> dict[bytes, int]:
    """The count of each word.

    The trie's nodes are visited in the order of sorted words; the visited node's path is kept as a stack with the
    forward value (score, count) of each depth. A word thus adds values for the nodes behind the prefix that it
    shares with the word before, which is the depth-first walk of the trie.
    """
    most = max(map(len, cost), default=1)
    out: dict[bytes, int] = {}
    forward: list[tuple[int, int]] = [(0, 0)]
    before = b""
    get = cost.get
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best: tuple[int, int] | None = None
            for start in range(max(0, end - most), end):
                c = get(word[start:end])
                if c is not None:
                    score, n = forward[start]
                    found = (score + c, n + 1)
                    if best is None or found < best:
                        best = found
            if best is None:
                raise ValueError("the vocabulary lacks a byte")
            forward.append(best)
        out[word] = forward[-1][1]
        before = word
    return out


def _count(ranks, pattern: str, block: int) -> Callable:
    def run(batches):
        import pyarrow as pa

        cost, split = costs(ranks.value), pretokens.splitter(pattern)
        index: dict[str, int] = {}
        waiting: list[tuple] = []  # ids and, for each text, its words' numbers
        chars = 0

        def counted():
            encoded = [w.encode() for w in index]
            found = trie_counts(encoded, cost)
            n = np.fromiter((found[w] for w in encoded), np.int64, len(encoded))
            for ids, rows in waiting:
                columns = ([int(n[r].sum()) for r in rows], [len(r) for r in rows], [len(np.unique(r)) for r in rows])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_tokens", "n_words", "n_distinct"])

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            waiting.append((batch.column(0), [np.fromiter((index.setdefault(w, len(index)) for w in split(t)), np.int32) for t in texts]))
            chars += sum(map(len, texts))
            if chars >= block:
                yield from counted()
                index, waiting, chars = {}, [], 0
        yield from counted()

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, block: int = BLOCK_CHARS) -> DataFrame:
    """id, n_tokens, n_words (pre-tokens) and n_distinct for each row of `docs`.

    A null text counts as empty, which has no tokens. Rows are independent, so repeated rows and an empty table need
    no rule. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(pretokens.load_ranks(path or pretokens.default_path()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(ranks, pattern or pretokens.default_pattern(), block), "id long, n_tokens long, n_words long, n_distinct long")
