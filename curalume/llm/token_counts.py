"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

Texts are cut into pre-tokens; the distinct ones of a batch are put in a byte trie. The best segmentation of a
pre-token up to byte i depends on its first i bytes only, so the forward score at a trie node serves all
pre-tokens that share the prefix: each node is scored once, and where a pre-token ends its token count is kept.
A document's count is the sum over its pre-tokens. Nothing is shuffled.

The public vocabularies carry ranks and no unigram scores, and tokenizers are not trained here, so scores follow from the
ranks (zipf_scores); a vocabulary with scores of its own is taken as it is.
"""

from __future__ import annotations

import base64
import functools
import math

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words with a leading space, numbers, marks and white space apart.
PRE_TOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Distinct pre-tokens whose counts a task remembers between batches, and nodes of their trie.
_MEMORY, _NODES = 400_000, 1_500_000
#: Bytes from which a pre-token is counted by itself and not kept in the trie.
_LONG = 256


def zipf_scores(lines) -> dict[bytes, float]:
    """Unigram log-probabilities of a ranked vocabulary (lines of base64 and rank), p ~ 1 / (rank + 2.7)."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    total = math.log(sum(1 / (r + 2.7) for r in ranks.values())) if ranks else 0.0
    return {piece: -math.log(r + 2.7) - total for piece, r in ranks.items()}


class Trie:
    """Byte trie of pre-tokens with forward scores; node 0 is the root."""

    def __init__(self, scores: dict[bytes, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.ends: set[bytes] | None = None
        self.children: list[dict[int, int]] = [{}]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.up: list[int] = [-1]

    def add(self, token: bytes) -> int:
        """Insert a pre-token and return the token count at its end; nodes on the way are scored when they are new."""
        node = 0
        for i, byte in enumerate(token):
            child = self.children[node].get(byte)
            if child is None:
                child = self._grow(node, byte, token[max(0, i + 1 - self.longest) : i + 1])
            node = child
        return self.count[node]

    def count_of(self, token: bytes) -> int:
        """The same count, for a token of any length, by the last scores alone: nothing is kept of it."""
        if self.ends is None:
            self.ends = {piece[i:] for piece in self.scores for i in range(len(piece))}
        get, ends, keep = self.scores.get, self.ends, self.longest
        best, count = [0.0], [0]
        for i in range(1, len(token) + 1):
            top, n = best[-1] + self.unknown, count[-1] + 1
            for size in range(1, min(keep, i) + 1):
                piece = token[i - size : i]
                if piece not in ends:  # no piece ends in these bytes, nor in more
                    break
                score = get(piece)
                if score is not None:
                    score += best[-size]
                    if score > top or (score == top and count[-size] + 1 < n):
                        top, n = score, count[-size] + 1
            best.append(top)
            count.append(n)
            if len(best) > 4 * keep + 1000:
                del best[: -keep - 1], count[: -keep - 1]
        return count[-1]

    def _grow(self, node: int, byte: int, tail: bytes) -> int:
        """A new node behind `node`: the best of all pieces that end here, more of fewer tokens among equals."""
        get, best, count, up = self.scores.get, self.best, self.count, self.up
        top, n, back = best[node] + self.unknown, count[node] + 1, node
        for size in range(1, len(tail) + 1):
            score = get(tail[-size:])
            if score is not None:
                score += best[back]
                if score > top or (score == top and count[back] + 1 < n):
                    top, n = score, count[back] + 1
            back = up[back]
        new = len(best)
        self.children[node][byte] = new
        self.children.append({})
        best.append(top)
        count.append(n)
        up.append(node)
        return new


@functools.lru_cache(2)
def _vocabulary(path: str) -> dict[bytes, float]:
    with open(path, "rb") as f:
        return zipf_scores(f.read().splitlines())


def token_counts(docs: DataFrame, vocabulary: dict[bytes, float] | str, id: str = "doc_id", text: str = "text", unknown: float = -30.0) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) per row of `docs`, by the segmentation of greatest score, fewest tokens among equals.

    `vocabulary` is pieces with log-probabilities, or the path of a ranked vocabulary file on the driver, which
    Spark hands to the executors. A byte that no piece covers is a token of score `unknown`. Very long pre-tokens are counted without the trie. A null or empty
    text has no tokens. Ids, also null and repeated ones, and other columns are not looked at; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    name = None
    if isinstance(vocabulary, str):
        spark.sparkContext.addFile(vocabulary)
        name = vocabulary.rsplit("/", 1)[-1]
    shared = None if name else spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        import regex

        scores = _vocabulary(SparkFiles.get(name)) if name else shared.value
        cut = regex.compile(PRE_TOKEN).findall
        known: dict[str, int] = {}
        trie = Trie(scores, unknown)
        for batch in batches:
            pre, out = [], []
            for value in batch.column(1):
                found = cut(value.as_py() or "")
                n = 0
                for x in found:
                    c = known.get(x)
                    if c is None:
                        token = x.encode()
                        if len(token) > _LONG:
                            c = trie.count_of(token)
                        else:
                            c = known[x] = trie.add(token)
                    n += c
                pre.append(len(found))
                out.append(n)
                if len(known) > _MEMORY or len(trie.best) > _NODES:
                    known, trie = {}, Trie(scores, unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre, pa.int64()), pa.array(out, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
