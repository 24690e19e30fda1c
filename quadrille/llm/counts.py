"""Token counts by a unigram model over the fixed vocabulary, on a shared trie.

Tokenizers are not trained here and the public vocabulary is a merge-type one, so piece
probabilities are a fixed rule: log p = -log(rank + 2), Zipf's law over the piece's place
in the vocabulary. A text is cut before every run of spaces and around line feeds (``_``
marks one space as in SentencePiece; other white space is a character as any); each
pre-token counts the pieces of its best segmentation (highest score, then fewest pieces).
Distinct pre-tokens go into a trie whose nodes hold the forward score of their prefix, so
a shared prefix is scored once; terminal nodes hold the count. Pre-tokens of over ``DEEP``
characters share nothing worth keeping: they are scored in a window of the last places,
so that memory does not grow with them. Characters without a piece cost one token per
UTF-8 byte. Null and empty text have 0 tokens; an empty table gives an empty result;
repeated rows are counted each. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, documents, kept, whole
from .pieces import MARK, MODEL, Vocabulary, model_bytes

#: Nodes a worker's trie may have before it begins anew: bounds memory, not results.
TRIE_NODES = 1_000_000
#: Characters of a pre-token up to which it enters the trie.
DEEP = 256
#: Log probability of one fallback byte: less than any piece.
BYTE = -20.0
_TOKEN = re.compile(rf"{MARK}*[^{MARK}\n]+|[{MARK}]+|\n")


def log_probabilities(vocabulary: Vocabulary) -> dict[str, float]:
    return {p: -math.log(i + 2) for p, i in vocabulary.id.items()}


class ForwardTrie:
    """Forward scores by prefix. A node's state depends only on its path from the root."""

    def __init__(self, logp: dict[str, float], limit: int = TRIE_NODES):
        self.limit, self.longest = limit, max(map(len, logp), default=1)
        # all ends of pieces: a lookup that finds none of them ends the search backwards
        self.logp: dict[str, float | None] = {p[i:]: None for p in logp for i in range(1, len(p))} | logp
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.score, self.number = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, token: str) -> int:
        known = self.terminal.get(token)
        if known is not None:
            return known
        if len(token) > DEEP:
            return self._windowed(token)
        if len(self.score) > self.limit:
            self.clear()
        child, score, number, logp = self.child, self.score, self.number, self.logp
        path, node = [0], 0
        for i, c in enumerate(token, 1):
            edge = node << 21 | ord(c)
            below = child.get(edge)
            if below is None:
                n_bytes = len(c.encode("utf-8", "surrogatepass"))
                best, fewest = score[node] + BYTE * n_bytes, number[node] + n_bytes
                for j in range(i - 1, -1, -1):
                    p = logp.get(token[j:i], 0)
                    if p == 0:
                        break
                    if p is not None:
                        at = path[j]
                        s, k = score[at] + p, number[at] + 1
                        if s > best or s == best and k < fewest:
                            best, fewest = s, k
                below = len(score)
                child[edge] = below
                score.append(best)
                number.append(fewest)
            node = below
            path.append(node)
        self.terminal[token] = number[node]
        return number[node]


    def _windowed(self, token: str) -> int:
        """The same sums, of which only those of the last places are kept."""
        logp, last = self.logp, [(0.0, 0)]
        for i, c in enumerate(token, 1):
            n_bytes = len(c.encode("utf-8", "surrogatepass"))
            best, fewest = last[-1][0] + BYTE * n_bytes, last[-1][1] + n_bytes
            for k in range(1, min(i, self.longest) + 1):
                p = logp.get(token[i - k : i], 0)
                if p == 0:
                    break
                if p is not None:
                    s, n = last[-k][0] + p, last[-k][1] + 1
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
            last.append((best, fewest))
            if len(last) > 2 * self.longest:
                del last[: -self.longest]
        return last[-1][1]


def _trie(proto: bytes) -> ForwardTrie:
    """A worker's trie, kept from task to task."""
    return kept(("trie", hash(proto)), lambda: ForwardTrie(log_probabilities(Vocabulary(proto))))


def pre_tokens(text: str) -> list[str]:
    return _TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens``, a row per input row; no shuffle."""
    proto = model_bytes(docs.sparkSession, model)

    def run(batches):
        trie = _trie(proto)
        for b in by_bytes(batches):
            words, tokens = [], []
            for text in b.column(1).to_pylist():
                found = pre_tokens(text)
                known, count = trie.terminal, trie.count
                counts = list(map(known.get, found))
                words.append(len(found))
                tokens.append(sum(count(t) if n is None else n for t, n in zip(found, counts, strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op2(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
