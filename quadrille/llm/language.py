"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary. A word (run
of letters, lower case, with the space mark before it) is scored by the forward
algorithm: the sum over all its segmentations. A text's score is the sum of its words'
log probabilities; the posterior of the best language, all being equally likely before,
is ``score``. Probabilities are fitted by expectation maximisation on a bounded sample
of labelled rows (about ``SAMPLE`` whole documents of each language), never on held-out
rows; only vocabulary x languages numbers reach the driver. Texts that are null or have
no letter are ``und`` with score 0, as are all when no labelled row exists. An empty
table gives an empty result; repeated rows are predicted each; ties go to the language
first by code point.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, documents, falls_below, free, held_out, kept, stored, temporary, text_key, whole, without
from .pieces import MARK, MODEL, Vocabulary, model_bytes

#: Documents of each language to learn from, and rounds of expectation maximisation.
SAMPLE, ROUNDS = 250, 2
SMOOTH = 0.05
#: Probability of a character without a piece, the same for every language.
UNKNOWN = 1e-7
#: Words remembered by a worker, and words of a text looked at together: bound memory,
#: not results.
REMEMBERED, PART = 250_000, 1_000_000
#: Letters up to which words are scored together, and how many words at a time.
LONG, TOGETHER = 64, 8192
#: Bits of a hash that name its bucket.
BUCKETS = 20
_BASE, _MIX, _LIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 100 * math.log(10)
REJECT = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


class Forward:
    """Log probabilities of words in each of ``n`` languages, summed over segmentations.

    Pieces are found by 64-bit polynomial hashes of their code points. ``many`` takes a
    place of all words at once; the sums of the last ``longest`` places are all it keeps,
    whatever the length of a word."""

    def __init__(self, p: dict[str, tuple[float, ...]], n: int):
        p = {s: q for s, q in p.items() if _LETTERS.fullmatch(s.removeprefix(MARK)) or s == MARK}  # no others are in words
        self.n, self.p = n, p
        self.longest = max(map(len, p), default=1)
        pieces = list(p)
        self.prob = np.array([p[s] for s in pieces], float).reshape(len(pieces), n)
        h = np.array([_hash(s) for s in pieces], np.uint64)
        order = np.argsort(_bucket(h), kind="stable")
        self.hashes, self.row = np.append(h[order], np.uint64(0)), np.append(order, 0)
        self.bucket = np.searchsorted(_bucket(h)[order], np.arange((1 << BUCKETS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max(initial=0))
        self.power = np.cumprod(np.full(self.longest + 1, _BASE)) * np.uint64(pow(int(_BASE), -1, 1 << 64))  # by exponent

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and the rows of their probabilities."""
        top = _bucket(h)
        at, end = self.bucket[top], self.bucket[top + 1]
        who = np.nonzero(at < end)[0]
        found, row = [who[:0]], [who[:0]]
        for _ in range(self.deepest):
            i = at[who]
            hit = self.hashes[i] == h[who]
            found.append(who[hit])
            row.append(self.row[i[hit]])
            who = who[~hit]
            at[who] += 1
            who = who[at[who] < end[who]]
        return np.concatenate(found), np.concatenate(row)

    def many(self, words: list[str]) -> np.ndarray:
        """Scores of words, a row for each."""
        out = np.zeros((len(words), self.n))
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(n, kind="stable")
        for at in range(0, len(words), TOGETHER):
            some = order[at : at + TOGETHER]
            if n[some[-1]] > LONG:
                for k in some[n[some] > LONG].tolist():
                    out[k] = self.score(words[k])
                some = some[n[some] <= LONG]
            if len(some):
                out[some] = self._together([words[k] for k in some.tolist()], n[some])
        return out

    def _together(self, words: list[str], n: np.ndarray) -> np.ndarray:
        """Words in order of length."""
        most, width = int(n[-1]), self.longest + 1
        code = np.zeros((len(words), most), np.uint64)
        code[np.arange(most) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        upto = np.zeros((len(words), most + 1), np.uint64)  # hashes of the prefixes
        for i in range(most):
            upto[:, i + 1] = upto[:, i] * _BASE + code[:, i] + np.uint64(1)
        ways = np.zeros((width, len(words), self.n))  # by place modulo width
        ways[0] = 1.0
        lift = np.zeros(len(words))
        out = np.zeros((len(words), self.n))
        for i in range(1, most + 1):
            first = int(np.searchsorted(n, i))  # shorter words are done
            acc = np.zeros((len(words) - first, self.n))
            for k in range(1, min(i, self.longest) + 1):
                who, row = self._find(upto[first:, i] - upto[first:, i - k] * self.power[k])
                acc[who] += ways[(i - k) % width, first + who] * self.prob[row]
            none = np.nonzero(~acc.any(axis=1))[0]
            acc[none] = ways[(i - 1) % width, first + none] * UNKNOWN
            ways[i % width, first:] = acc
            small = first + np.nonzero(acc.max(axis=1) < 1e-100)[0]
            if len(small):
                ways[:, small] *= 1e100
                lift[small] += 1
            done = slice(first, int(np.searchsorted(n, i, "right")))
            out[done] = np.log(np.maximum(ways[i % width, done], 1e-300)) - lift[done, None] * _LIFT
        return out

    def score(self, word: str) -> tuple[float, ...]:
        """The same sums, a word of any length."""
        p, n, longest = self.p, self.n, self.longest
        ways, lift = [(1.0,) * n], 0  # of the last places
        for i in range(1, len(word) + 1):
            acc = [0.0] * n
            for k in range(1, min(i, longest) + 1):
                q = p.get(word[i - k : i])
                if q is not None:
                    acc = [a + w * x for a, w, x in zip(acc, ways[-k], q, strict=True)]
            if not any(acc):
                acc = [w * UNKNOWN for w in ways[-1]]
            ways = [*ways[-longest:], tuple(acc)]
            if max(acc) < 1e-100:
                ways, lift = [tuple(x * 1e100 for x in w) for w in ways], lift + 1
        return tuple(math.log(max(x, 1e-300)) - lift * _LIFT for x in ways[-1])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * _MIX >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return h


class _Words(dict):
    """Numbers of words; new ones are noted."""

    def __init__(self):
        self.new: list[str] = []
        self.first = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = self.first + len(self.new)
        self.new.append(word)
        return n


class Scorer:
    """Scores of texts; those of words are remembered."""

    def __init__(self, p: dict[str, tuple[float, ...]], n: int):
        self.forward, self.n = Forward(p, n), n
        self._forget()

    def _forget(self) -> None:
        self.known, self.scores = _Words(), np.zeros((0, self.n))

    def texts(self, found: list[list[str]]) -> np.ndarray:
        """The sum of the scores of each text's words."""
        out = np.zeros((len(found), self.n))
        for k, words in enumerate(found):  # long texts by themselves, in parts
            if len(words) > PART:
                for at in range(0, len(words), PART):
                    out[k] += self._sums([words[at : at + PART]])[0]
        short = [k for k, words in enumerate(found) if 0 < len(words) <= PART]
        at = 0
        while at < len(short):
            end, total = at, 0
            while end < len(short) and total < PART:
                total += len(found[short[end]])
                end += 1
            out[short[at:end]] = self._sums([found[k] for k in short[at:end]])
            at = end
        return out

    def _sums(self, found: list[list[str]]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        self.known.first, self.known.new = len(self.scores), []
        n = np.fromiter(map(len, found), np.int64, len(found))
        got = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        if self.known.new:
            self.scores = np.concatenate([self.scores, self.forward.many([MARK + w for w in self.known.new])])
        return np.add.reduceat(self.scores[got], np.cumsum(n) - n, axis=0)


def expected(word: str, p: dict[str, float], longest: int) -> dict[str, float]:
    """Expected uses of each piece over all segmentations of a word; words over 64
    letters are cut, as products of more pieces would vanish."""
    if len(word) > 64:
        out: Counter = Counter()
        for at in range(0, len(word), 64):
            out.update(expected(word[at : at + 64], p, longest))
        return out
    n = len(word)
    a = [1.0] + [0.0] * n
    uses = []
    for i in range(1, n + 1):
        for j in range(max(0, i - longest), i):
            q = p.get(word[j:i])
            if q:
                a[i] += a[j] * q
                uses.append((j, i, q))
        if not a[i]:
            a[i] = a[i - 1] * UNKNOWN
            uses.append((i - 1, i, UNKNOWN))
    b = [0.0] * n + [1.0]
    for j, i, q in reversed(uses):
        b[j] += q * b[i]
    if not a[n]:
        return {}
    out = {}
    for j, i, q in uses:
        s = word[j:i]
        if s in p:
            out[s] = out.get(s, 0.0) + a[j] * q * b[i] / a[n]
    return out


def learn(docs: DataFrame, model: str = MODEL, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], dict[str, tuple[float, ...]]]:
    """Languages and the piece probabilities of each."""
    spark = docs.sparkSession
    proto = model_bytes(spark, model)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(size)
    if not langs:
        return [], {}
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(sample / size[k]))])
    picked = rows.where(falls_below(F.col("doc_id"), share[F.col("lang")], "lang"))

    def words(batches):
        total: Counter = Counter()
        for b in by_bytes(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(_LETTERS.findall(text.lower())).items():
                    total[lang, w] += k
            if len(total) > 300_000:
                yield pa.RecordBatch.from_pylist([{"lang": a, "word": w, "n": n} for (a, w), n in total.items()])
                total.clear()
        if total:
            yield pa.RecordBatch.from_pylist([{"lang": a, "word": w, "n": n} for (a, w), n in total.items()])

    with temporary(spark):
        counts = stored(picked.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
        pieces = Vocabulary(proto).id
        p = {k: dict.fromkeys(pieces, 1 / len(pieces)) for k in langs}
        for _ in range(rounds):

            def step(batches, p=p):
                longest = max(map(len, pieces))
                total: Counter = Counter()
                for b in batches:
                    for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                        for s, x in expected(MARK + word, p[lang], longest).items():
                            total[lang, s] += n * x
                if total:
                    yield pa.RecordBatch.from_pylist([{"lang": a, "piece": s, "x": float(x)} for (a, s), x in total.items()])

            found = counts.mapInArrow(step, "lang string, piece string, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).collect()
            uses = {k: dict.fromkeys(pieces, SMOOTH) for k in langs}
            for r in found:
                uses[r["lang"]][r["piece"]] += r["x"]
            p = {k: {s: x / total for s, x in u.items()} for k, u in uses.items() for total in [sum(u.values())]}
    return langs, {s: tuple(p[k][s] for k in langs) for s in pieces}


def identify(docs: DataFrame, fitted: tuple[list[str], dict], id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` (and ``keep``), a row per input row; no shuffle."""
    langs, p = fitted
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((p, len(langs)))  # vocabulary x languages

    def run(batches):
        for b in by_bytes(batches):
            found = [_LETTERS.findall(t.lower()) for t in b.column(1).to_pylist()] if langs else [[]] * b.num_rows
            named = np.fromiter(map(bool, found), bool, len(found))
            pred, score = np.full(len(found), "und", object), np.zeros(len(found))
            if named.any():
                total = kept(("scorer", name), lambda: Scorer(*shared.value)).texts(found)[named]
                best = total.argmax(axis=1)
                pred[named] = np.array(langs, object)[best]
                score[named] = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700.0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), *b.columns[2:]], ["doc_id", "lang_pred", "score", *keep])

    kinds = dict(docs.dtypes)
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), *keep).mapInArrow(run, ", ".join([f"doc_id {kinds[id_col]}, lang_pred string, score double", *(f"{k} {kinds[k]}" for k in keep)]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows whose language is known: not ``und``, and likelier than all others together."""
    key = free(docs, "key")
    keyed = docs.withColumn(key, text_key())
    named = identify(keyed, learn(docs), keep=(key,)).where(f"lang_pred = 'und' or score < {REJECT}")
    gone = stored(named.select("doc_id", key).distinct(), "lang-gone")
    return without(keyed, gone, key).select(docs.columns)


def op7(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
